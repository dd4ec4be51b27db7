import random

import numpy as np
import pytest

from seqtally.llm import jaccard_join
from seqtally.llm.jaccard_join import Settings, components, linked, near_duplicates, second_order, shingles


def sets_of(text, width=5):
    import re

    w = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows):
    """doc_id, n_shingles and component per row, from all pairs."""
    own = [(r[0], sets_of(r[1])) for r in rows]
    parent = {d: d for d, _ in own if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted((str(d), len(x), None if d is None else root(d)) for d, x in own)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


def varied(rnd, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"z{rnd.randrange(10_000)}"
    return " ".join(words)


def test_components_equal_brute_force(spark, docs_of, odd_rows):
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage = prose(40)
    rows = [(1000 + i, r[1]) if r[0] is not None else r for i, r in enumerate(odd_rows)]
    rows += [(r[0], r[1]) for r in odd_rows]
    ids = iter(rnd.sample(range(100), 90))
    for n in (30, 80, 200):
        base = prose(n)
        rows += [(next(ids), varied(rnd, base, k % max(2, n // 25))) for k in range(14)]
        rows += [(next(ids), base.upper())] * 2
    chain = prose(120)  # each links with the next only
    for _ in range(6):
        rows.append((next(ids), chain))
        chain = varied(rnd, chain, 2)
    rows += [(next(ids), f"{prose(40)} {passage} {prose(40)}") for _ in range(12)]
    rows += [(next(ids), t) for t in ("a b c", "A b c", "a b c d", "a b c d e", "a b c d e f")]
    assert result(near_duplicates(docs_of(rows))) == brute(rows)


def test_a_doc_id_on_several_texts_holds_them_together(spark, docs_of):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a), (5, b), (3, a), (4, b + " more"), (9, "alone in the world here we are")]
    assert result(near_duplicates(docs_of(rows))) == brute(rows) == sorted([("3", 46, 3), ("4", 47, 3), ("5", 46, 3), ("5", 46, 3), ("9", 3, 9)])


@pytest.mark.parametrize("chunk", [7, 512])
def test_large_group_of_near_copies(spark, docs_of, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rnd = random.Random(9)
    base = " ".join(f"v{i}" for i in range(150))
    rows = [(i, varied(rnd, base, 1 + i % 5)) for i in range(1, 150)] + [(500, base)]
    assert result(near_duplicates(docs_of(rows))) == brute(rows)


def test_filters_lose_no_link():
    s, rnd = Settings(), random.Random(2)
    for _ in range(300):
        n = rnd.choice([1, 2, 5, 19, 20, 21, 100, 333])
        x = {rnd.randrange(1 << 62) for _ in range(n)}
        y = set(rnd.sample(sorted(x), max(1, len(x) - rnd.randint(0, n // 5 + 1)))) | {rnd.randrange(1 << 62) for _ in range(rnd.randint(0, n // 6 + 1))}
        a, b = (np.array(sorted(v), np.uint64) for v in (x, y))
        want = 100 * len(x & y) >= 80 * len(x | y)
        assert linked(a, b, s) == want
        if want:
            for order in (lambda v: v, second_order):
                both = len(set(order(a)[: s.prefix(len(a))].tolist()) & set(order(b)[: s.prefix(len(b))].tolist()))
                assert both >= s.shared(len(a)) and both >= s.shared(len(b))


def test_shingles_and_empty(spark, docs_of, odd_rows):
    assert len(shingles(None)) == len(shingles(b" \t\n")) == 0 and len(shingles(b"a b")) == 1
    assert len(shingles(b"A b c d e f a b c d e")) == len(sets_of("a b c d e f a b c d e"))
    assert near_duplicates(docs_of(odd_rows).where("false")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    assert {r.comp for r in components(path).collect()} == {1}


def test_halves_of_tokens_lose_no_link():
    s, rnd = Settings(), random.Random(8)
    kept = 0
    for _ in range(300):
        n = rnd.choice([1, 2, 5, 20, 100, 333])
        x = {rnd.randrange(1 << 64) for _ in range(n)}
        y = set(rnd.sample(sorted(x), max(1, n - rnd.randint(0, n // 4)))) | {rnd.randrange(1 << 64) for _ in range(rnd.randint(0, n // 5))}
        a, b = (np.array(sorted(v), np.uint64) for v in (x, y))
        half = [(v >> np.uint64(32)).astype(np.uint32) for v in (a, b)]
        assert jaccard_join.may_link(*half, s) >= linked(a, b, s)
        kept += jaccard_join.may_link(*half, s)
    assert 0 < kept < 300
    same = np.array([1 << 40, (1 << 40) + 1], np.uint64)  # different tokens with equal halves
    assert jaccard_join.may_link(*[(same >> np.uint64(32)).astype(np.uint32)] * 2, s)


def test_prefixes_of_single_texts_are_not_shuffled(spark, docs_of):
    rnd = random.Random(1)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(400))) for i in range(300)]
    named = jaccard_join.stage(jaccard_join.summaries(docs_of([*rows, (900, rows[0][1])]), Settings()), "summaries").where("n > 0")
    copies = named.groupBy("digest").agg({"doc_id": "min", "n": "count"}).where("`count(n)` > 1").select("digest", "min(doc_id)").toDF("digest", "node")
    parts = jaccard_join.one_a_class(named, copies, Settings())
    assert parts[1][0].count() < 10  # all that was grouped: the one class of two, and what the filter let through
    classes = jaccard_join._each(parts)
    assert "Exchange" not in classes._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.node, r.n, len(r.tokens)) for r in classes.collect()) == sorted((i, 396, Settings().prefix(396)) for i, _ in rows)
