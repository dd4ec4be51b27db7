import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally.llm.decontamination import FmIndex, Phrases, ShardSearch, find_contamination, merged, removed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    own, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for k in range(len(own) - len(p) + 1):
                if own[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    ids.add(item)
    return len(own), len(hit), sorted(ids)


def test_index_search_and_locate_equal_a_scan():
    rnd = random.Random(3)
    for _ in range(40):
        seq = []
        for _ in range(rnd.randint(1, 8)):
            seq += [rnd.randint(1, 4) for _ in range(rnd.randint(1, 60))] + [0]
        index = FmIndex(np.array(seq), 4)
        phrases = np.array([[rnd.randint(1, 4) for _ in range(3)] for _ in range(30)])
        own, lo, hi = index.search(phrases)
        got = {}
        for p, a, b in zip(own, lo, hi):
            got[tuple(phrases[p])] = sorted(index.locate(np.arange(a, b)).tolist())
        want = {}
        for p in map(tuple, phrases):
            at = [i for i in range(len(seq) - 2) if tuple(seq[i : i + 3]) == p]
            if at:
                want[p] = at
        assert got == want


def test_shards_equal_brute_force():
    rnd = random.Random(5)
    vocab = ["a", "B", "c1", "é", "d"]
    items = [(str(i), " ".join(rnd.choice(vocab) for _ in range(rnd.choice([2, 3, 12])))) for i in range(12)] + [("x", ""), ("y", "...")]
    texts = [" ".join(rnd.choice([*vocab, "zz", "-"]) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    counts, found_items, found = ShardSearch(Phrases(items))([t.encode() for t in texts])
    for k, t in enumerate(texts):
        spans = merged(found.get(k, []))
        assert (counts[k], sum(b - a for a, b in spans), sorted(found_items.get(k, ()))) == brute(t, items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_tables_blocks_and_removal(spark, docs_of, odd_rows, block_bytes):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "of and to in the of and to in the of"), (10, item), (3, None), (None, "Une phrase courte"), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(20, "x " + item.upper() + ". y"), (21, "une PHRASE courte!"), (22, "alpha beta gamma delta epsilon zeta eta theta iota")]
    docs = docs_of(odd_rows + more)
    rows = find_contamination(docs, bench, block_bytes=block_bytes).select("doc_id", "text", "contamination.*", removed(F.col("text"), F.col("contamination.spans")).alias("left")).collect()
    assert len(rows) == len(odd_rows) + 3
    named = [("" if i is None else str(i), t) for i, t in items]
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, named)
    by = {r.doc_id: r for r in rows}
    assert by[20].left == "x \n. y" and by[20]["items"] == ["1", "10"]
    assert by[21].left == "\n!" and by[22].n_hit == 0 and by[22].left == by[22].text


def test_empty_tables(spark, docs_of, odd_rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs_of(odd_rows), bench).where("contamination.n_hit > 0").count() == 0
    assert find_contamination(docs_of(odd_rows).where("false"), bench).count() == 0
