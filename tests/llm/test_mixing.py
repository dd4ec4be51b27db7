import hashlib
import re
from collections import defaultdict

import pytest

from seqtally.llm.mixing import GOLDEN, RING, mix, schedule, source_targets


def brute(rows, weights=(5, 2, 1), repeats=3, seed="mix"):
    """taken per row by walking every source's repeated line word by word."""
    sized = [(d, s, len(re.findall("[^ \t-\r]+", t or ""))) for d, t, _, s in rows]
    size = defaultdict(int)
    for _, s, n in sized:
        size[s] += n
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, float(sum(size.values())), set(names)
    while open_ and left > 1e-9:
        share = sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + left * weight[s] / share >= repeats * size[s] - 1e-9}
        if not full:
            for s in open_:
                target[s] += left * weight[s] / share
            break
        for s in full:
            left -= repeats * size[s] - target[s]
            target[s] = float(repeats * size[s])
        open_ -= full
    taken = [0] * len(sized)
    for s in names:
        key = lambda i: (int(hashlib.md5((seed + ("null" if sized[i][0] is None else str(sized[i][0]))).encode()).hexdigest()[:15], 16), sized[i][0] is not None, sized[i][0] or 0, sized[i][2])
        line = [i for i in sorted((i for i, r in enumerate(sized) if r[1] == s), key=key) for _ in range(sized[i][2])]
        for k in range(round(target[s])):
            taken[line[k % len(line)]] += 1
    return sorted(((r[0] is None, r[0] or 0), r[2], size[r[1]], round(target[r[1]], 6), t) for r, t in zip(sized, taken))


def result(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_odd_rows_equal_brute_force(spark, docs_of, odd_rows):
    got, _ = mix(docs_of(odd_rows), block=7)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert [(r[0], *r[1:4]) for r in result(got)] == [(r[0], *r[1:4]) for r in brute(odd_rows)]
    assert sum(r[4] for r in result(got)) == sum(r[4] for r in brute(odd_rows))
    assert all(r[4] <= 3 * r[1] for r in result(got))


@pytest.mark.parametrize("block", [3, 64])
def test_taken_equals_brute_force_for_any_block(spark, docs_of, block):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", f"s{i % 5}" if i % 7 else "s0") for i in range(60)] + [(99, "w " * 400, "en", "s4")]
    got, pieces = mix(docs_of(rows), block=block)
    assert result(got) == brute(rows)
    per_slot = defaultdict(int)
    for p in pieces.collect():
        per_slot[p.slot] += p.words
    # only the last block of a source is shorter
    assert sum(n < block for n in per_slot.values()) <= 5
    assert max(per_slot.values()) <= block
    assert sum(per_slot.values()) == sum(r[4] for r in brute(rows))


def test_schedule_keeps_every_stretch_near_the_weights(spark):
    sizes = spark.createDataFrame([("a", 10_000), ("b", 10_000), ("c", 10_000)], "source string, size long")
    slots = [r.src for r in schedule(source_targets(sizes), 10).orderBy("slot").collect()]
    share = [slots.count(i) / len(slots) for i in range(3)]
    for begin in range(0, len(slots) - 300, 150):
        part = slots[begin : begin + 300]
        assert all(abs(part.count(i) / 300 - share[i]) < 0.03 for i in range(3))
    assert abs(GOLDEN / RING - 0.6180339887) < 1e-9 and GOLDEN % 2 == 1


def test_empty_and_reruns(spark, docs_of, odd_rows):
    none, pieces = mix(docs_of(odd_rows).where("false"))
    assert none.count() == 0 and pieces.count() == 0
    blank, _ = mix(docs_of([(1, None), (2, "")]))
    assert result(blank) == [((False, 1), 0, 0, 0.0, 0), ((False, 2), 0, 0, 0.0, 0)]
    assert result(mix(docs_of(odd_rows))[0]) == result(mix(docs_of(odd_rows).repartition(5))[0])
