"""Searches of shuffled copies; regions that hits meet."""

import random

import pytest
from pyspark.sql import functions as F

from seqtally.operators import hits as ht
from seqtally.operators import intervals as iv
from seqtally.operators import nullmodel, rollups, similarity
from seqtally.plans import sequence_queries
from seqtally.plans.registry import run


def _seqs(spark, rnd, n, prefix):
    rows = [(f"{prefix}{i}", rnd.choice([None, "", "ACGTACG", *["".join(rnd.choices("ACGTN", [8, 3, 3, 8, 1], k=rnd.randint(9, 400))) for _ in range(9)]])) for i in range(n)]
    return spark.createDataFrame(rows, "seq_id string, seq string").repartition(3)


def test_searched_copies_count_the_hits_of_a_search(spark, monkeypatch):
    rnd = random.Random(4)
    queries, subjects = _seqs(spark, rnd, 60, "q"), _seqs(spark, rnd, 12, "s")
    monkeypatch.setattr(similarity, "SLICE", 1500)
    found = nullmodel.searched_copies(queries, subjects, n=2, k=6, min_score=7)
    got = {tuple(r[:3]): r[3] for r in found.select("replicate", "length", "matches", "n").collect()}
    made = nullmodel.dinucleotide_shuffle(queries.where("seq is not null"), n=2).select("replicate", F.col("shuffled_id").alias("seq_id"), "seq")
    every = queries.select(F.lit(0).alias("replicate"), "seq_id", "seq").unionByName(made)
    want, stats = {}, {}
    for i in range(3):
        hits = similarity.search(every.where(F.col("replicate") == i).select("seq_id", "seq"), subjects, k=6, min_score=7)
        want |= {(i, r[0], r[1]): r[2] for r in hits.groupBy("length", "matches").count().collect()}
        stats[i] = ht.hit_statistics(hits.withColumnsRenamed({"q_id": "qseqid"})).first()
    assert got == want and len(want) > 20
    for r in ht.kind_statistics(found, ["replicate"]).collect():
        assert (r.total_hits, r.hits_hq) == (stats[r.replicate].total_hits, stats[r.replicate].hits_hq)
        assert (r.mean_pident, r.mean_length) == pytest.approx((stats[r.replicate].mean_pident, stats[r.replicate].mean_length))


def test_null_comparison_writes_kinds_and_not_hits(spark, monkeypatch):
    written = []
    stage = sequence_queries.stage
    monkeypatch.setattr(sequence_queries, "stage", lambda df, *a: written.append(df.columns) or stage(df, *a))
    rows = {r.metric: r for r in run("null_search_comparison", spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {"total_hits", "hits_hq", "mean_pident", "mean_length"} and rows["total_hits"].real > 0
    assert written == [["replicate", "length", "matches", "n"]]


def test_lists_of_regions_give_the_pairs_of_a_join(spark):
    rnd = random.Random(9)

    def spans(n, by):
        rows = []
        for _ in range(n):
            lo = rnd.choice([None, rnd.randint(-40, 900)])
            rows.append((rnd.choice([*by, None]), lo, rnd.choice([None, (lo or 0) + rnd.randint(-3, 120)]), rnd.choice(["x", "y", None])))
        return rows

    a = spark.createDataFrame([(i, *r) for i, r in enumerate(spans(150, "pq"))], "id int, by string, s int, e int, own string")
    # equal rows, more of them than a list holds
    b = spark.createDataFrame(spans(120, "pr") + [("p", 10, 300, "x")] * 23 + [("p", 10, 300, None)] * 9, "by string, bs long, be long, name string")
    want = iv.overlap_join(a, b, ["by"], ("s", "e"), ("bs", "be"), closed=False, bin_width=64)
    want = want.select("by", "id", "s", "e", "own", "name", (F.least("e", "be") - F.greatest("s", "bs")).alias("bp"))
    got = iv.listed_overlaps(a, b, ["by"], ("s", "e"), ("bs", "be"), ["name"], ["id"], "bp", bin_width=64, list_size=4)
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.select(want.columns).collect())) == rows and len(rows) > 300


def test_hits_meet_lists_of_regions(spark):
    h = spark.createDataFrame([(1, "f", 50, 5, 60), (2, "f", 30, 700, 730)], "id int, family string, length int, s_lo int, s_hi int")
    r = spark.createDataFrame([("r", "LTR", 10, 40)] * 700 + [("r", "CDS", 0, 20)] * 2, "region_id string, region string, reg_start long, reg_end long")
    m = spark.createDataFrame([("f", "r")], "family_key string, region_id string")
    found = rollups.region_overlap(h, r, m, ["id"])
    assert found.groupBy("id", "region", "region_bp").count().sort("id", "region").collect() == [(1, "CDS", 15, 2), (1, "LTR", 30, 700), (2, "intergenic", 30, 1)]
    # one hit, one bin: 702 regions are two rows of at most two lists
    assert "collect_list(" in found._jdf.queryExecution().optimizedPlan().toString()
