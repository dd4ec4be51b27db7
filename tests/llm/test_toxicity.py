import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqtally.llm.common import ALNUM
from seqtally.llm.toxicity import Settings, fit, held_out, score, toxicity


def corpus(n=600):
    rnd = random.Random(7)
    plain = ["tree", "house", "walk", "blue", "river", "stone", "bread", "light", "paper", "cloud"]
    rude = ["scoundrel", "blockhead", "wretch"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(10, 60))]
        y = int(rnd.random() < 0.3)
        if y:
            words.insert(rnd.randint(0, len(words)), rnd.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    return rows, labels


def test_held_out_rows_are_scored_right(spark, docs_of):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = toxicity(docs_of(rows), lab)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    y = dict(labels)
    out = [r for r in got.collect() if r.held_out]
    assert len(out) > 100 and sum((r.predicted == 1) == (y[r.doc_id] == 1) for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_labels_of_the_held_out_fold_are_not_learned(spark, docs_of):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = lab.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = docs_of(rows)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(toxicity(docs, lab)) == key(toxicity(docs, turned))


def test_odd_rows_and_empty_tables(spark, docs_of, odd_rows):
    rows, labels = corpus(200)
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    docs = docs_of([(r[0] and r[0] + 10_000, *r[1:]) for r in odd_rows])
    model = fit(docs_of(rows), lab)
    assert model.fitted and len(model.places) < 5000
    got = toxicity(docs.unionByName(docs_of(rows)), lab).where("doc_id > 10000 or doc_id is null").collect()
    assert len(got) == len(odd_rows) and [r.held_out for r in got if r.doc_id is None] == [False]
    empty = {r.score for r in got if r.doc_id in (10_002, 10_003, 10_004)}
    assert len(empty) == 1 and 0 < empty.pop() < 1
    assert toxicity(docs.where("false"), lab).count() == 0
    none = toxicity(docs, lab.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    small = fit(docs_of(rows), lab, Settings(max_rows=1, epochs=1))
    assert small.fitted


def plain_places(text, log_size):
    """Hash places of words, pairs and pairs with one word between, one at a time."""
    top, words = (1 << 64) - 1, text.encode().translate(ALNUM).split()
    h = [((zlib.crc32(w) << 20) ^ zlib.adler32(w)) & top for w in words]
    out = {1 << log_size}
    for gap, k in ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        for i in range(len(h) - gap):
            x = h[i] * k & top
            if gap:
                x = ((x ^ (x >> 31)) + h[i + gap] * 0xD6E8FEB86659FD93) & top
            x = (x ^ (x >> 32)) * 0xFF51AFD7ED558CCD & top
            out.add(x >> (64 - log_size))
    return out


def test_learner_and_scores_equal_a_plain_one(spark):
    s = Settings(log_size=20, l1=0.2, epochs=2)
    rnd = random.Random(4)
    words = "you are a bad person what nice day the of Idiot and, so!".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))) for i in range(60)]
    labels = [(i, int("Idiot" in t or rnd.random() < 0.1)) for i, t in rows if i % 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), s)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= s.l1:
            return 0.0
        return (math.copysign(s.l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    texts, known = dict(rows), dict(labels)
    for _ in range(s.epochs):
        for i in sorted(known, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            places = plain_places(texts[i], s.log_size)
            w = {p: weight(p) for p in places}
            g = 1 / (1 + math.exp(-sum(w.values()))) - known[i]
            for p in places:
                before = n.get(p, 0.0)
                z[p] = z.get(p, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / s.alpha * w[p]
                n[p] = before + g * g
    want = {p: weight(p) for p in z if weight(p)}
    got = dict(zip(model.places.tolist(), model.values.tolist()))
    assert got.keys() == want.keys() | {1 << s.log_size} and 10 < len(want) < len(z)
    assert all(got[p] == pytest.approx(want[p], rel=1e-9) for p in want)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", score(docs, model).alias("s")).collect()}
    for i, t in rows:
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-sum(want.get(p, 0.0) for p in plain_places(t, s.log_size)))), abs=1e-5)
