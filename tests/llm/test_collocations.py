import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqtally.llm.collocations import Settings, Texts, Trie, collocations, counted_phrases


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split("[.,;:!?\n-\r]", text) if (w := re.findall("[^ \t]+", p))]


def counts_of(rows, most=3):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, s):
    f, n = counts_of(rows, s.max_words)
    out = []
    for lang, c in f.items():
        named = {p: a for p, a in c.items() if len(p) > 1 and a >= s.min_count}
        best = []
        for p, a in named.items():
            inside = [b for q, b in named.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= s.contained_percent * a for b in inside):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[: s.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts_of(rnd, n):
    words = ["the", "The", "of", "é", "z#", "new", "york", "\U0001f600", "x\x00", "a"]
    gaps = [" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n"]
    return [(rnd.choice(["en", "de", None]), "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60)))) for _ in range(n)]


def test_trie_counts_equal_a_scan():
    rnd = random.Random(1)
    rows = texts_of(rnd, 80)
    f, n = counts_of(rows)
    listed = [(lang, p) for lang in f for p in f[lang] if rnd.random() < 0.6] + [("fr", ("the",)), ("en", ("the", "nowhere", "a"))]
    trie = Trie(pa.array([x for x, _ in listed]), pa.array([" ".join(p) for _, p in listed]))
    texts = Texts(pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows]), "und")
    got = trie.count(texts, trie.symbols, 3)
    assert got.tolist() == [f[lang][p] if lang in f else 0 for lang, p in listed]
    assert (np.unique(trie.accept[trie.accept >= 0]) == np.arange(len(listed))).all()
    empty = Trie(pa.array([], pa.string()), pa.array([], pa.string()))
    assert empty.count(texts, empty.symbols, 3).tolist() == []


@pytest.mark.parametrize("settings", [Settings(min_count=5, shard_phrases=900, top=30), Settings(min_count=3, max_words=4, contained_percent=70)])
def test_equals_brute_force(spark, docs_of, odd_rows, settings):
    rows = odd_rows + [(i, text, lang, "s") for i, (lang, text) in enumerate(texts_of(random.Random(5), 200))]
    docs = docs_of(rows).withColumns({c: F.lit("x") for c in ("phrase", "f", "h", "at", "id", "rank", "a")})
    want = brute([(r[2] if len(r) > 2 else "en", r[1]) for r in rows], settings)
    assert sorted(tuple(r) for r in collocations(docs, settings=settings).collect()) == want
    assert len(want) > 60


def test_counts_are_whole_whatever_the_shards(spark, docs_of):
    rows = [(i, text, lang, "s") for i, (lang, text) in enumerate(texts_of(random.Random(6), 100))]
    f, n = counts_of([(r[2], r[1]) for r in rows])
    docs = docs_of(rows).select("lang", "text")
    counts, totals = counted_phrases(docs, Settings(min_count=2, shard_phrases=1500))
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()} == {(x, p): a for x in f for p, a in f[x].items() if a >= 2}
    assert {r.lang: r.n for r in totals.collect()} == dict(n)


def test_scores_past_64_bits(spark):
    counts = [("en", "a", 3 * 10**12), ("en", "b", 4 * 10**12), ("en", "a b", 2 * 10**12)]
    expr = "(cast({0} as decimal(19,0)) * cast({0} as decimal(19,0)) * 1000000) div (cast({1} as decimal(19,0)) * cast({2} as decimal(19,0)))"
    a, b, ab = (c for _, _, c in counts)
    assert spark.range(1).select(F.expr(expr.format(ab, a, b))).first()[0] == 10**6 * ab * ab // (a * b)


def test_empty_tables(spark, docs_of, odd_rows):
    assert collocations(docs_of(odd_rows).where("false")).count() == 0
    assert collocations(docs_of([(1, None, "en", "s"), (2, " .,\n", None, "s")])).count() == 0


def test_texts_are_read_twice_however_many_the_phrases(spark, docs_of):
    rows = [(i, text, lang, "s") for i, (lang, text) in enumerate(texts_of(random.Random(7), 100))]
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    docs = docs_of(rows).select("lang", F.udf(read, "string")("text").alias("text"))
    counts, totals = counted_phrases(docs, Settings(min_count=2, shard_phrases=100))
    assert counts.count() > 300 and totals.count() == 3
    assert seen.value == 2 * len(rows)
