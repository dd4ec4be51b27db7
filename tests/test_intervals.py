import random

import pytest
from pyspark.sql import functions as F

from seqtally.operators import intervals as iv
from seqtally.operators import loci as lc


def brute_merge(rows, gap):
    out = []
    for k in sorted({r[0] for r in rows}):
        cur = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if cur and s <= cur[2] + gap:
                cur = (k, cur[1], max(cur[2], e), cur[3] + 1)
            else:
                if cur:
                    out.append(cur)
                cur = (k, s, e, 1)
        out.append(cur)
    return out


@pytest.mark.parametrize("gap", [0, 5, -1])
@pytest.mark.parametrize("chunk", [4, 64, 4096])
def test_collapse_matches_sequential_merge(spark, gap, chunk):
    rng = random.Random(gap * 100 + chunk)
    rows = []
    for _ in range(300):
        s = rng.randint(0, 900)
        rows.append((rng.choice("ab"), s, s + rng.choice([1, 3, 8, 200])))
    df = spark.createDataFrame(rows, "k string, s int, e int")
    got = iv.collapse(df, ["k"], "s", "e", gap, [iv.count_rows("n")], chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_merge(rows, gap))


def _two_tables(spark, seed):
    rng = random.Random(seed)
    a = [(i, rng.choice("xy"), s, s + rng.randint(0, 60)) for i in range(80) for s in [rng.randint(0, 500)]]
    b = [(j, rng.choice("xy"), s, s + rng.randint(0, 90)) for j in range(80) for s in [rng.randint(0, 500)]]
    return (
        a, b,
        spark.createDataFrame(a, "i int, c string, s1 int, e1 int"),
        spark.createDataFrame(b, "j int, c string, s2 int, e2 int"),
    )


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("width", [16, 1000])
def test_overlap_join_lists_each_pair_once(spark, closed, width):
    a, b, da, db = _two_tables(spark, 3)

    def meet(x, y):
        if closed:
            return x[2] <= y[3] and x[3] >= y[2]
        return max(x[2], y[2]) < min(x[3], y[3])

    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and meet(x, y))
    got = iv.overlap_join(da, db, ["c"], ("s1", "e1"), ("s2", "e2"), closed, bin_width=width)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    inside = iv.overlaps_any(da, db, ["c"], ("s1", "e1"), ("s2", "e2"), ["i"], closed=closed, bin_width=width)
    assert {r["i"] for r in inside.collect()} == {i for i, _ in want}


def test_coverage_and_interval_mean(spark):
    q = spark.createDataFrame([(1, "c", 10, 30), (2, "c", 100, 100), (3, "d", 0, 5)], "i int, c string, s int, e int")
    m = spark.createDataFrame([("c", 0, 15, "u"), ("c", 12, 20, "u"), ("c", 25, 90, "v")], "c string, bs int, be int, species string")
    got = {r["i"]: (r["cov_u"], r["cov_v"]) for r in iv.coverage_fraction(q, m, ["c"], ("s", "e"), ("bs", "be"), ["i"], ["u", "v"]).collect()}
    assert got == {1: (0.5, 0.25), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    seg = spark.createDataFrame([("c", 8, 12, 1.0), ("c", 20, 24, 3.0)], "c string, a int, b int, score double")
    r = iv.interval_mean(q, seg, ["c"], ("s", "e"), ("a", "b"), ["i"]).where("i = 1").collect()[0]
    assert (r["covered"], r["score_sum"], r["mean0"], r["mean"]) == (6, 14.0, 0.7, 14 / 6)


def test_minus_strand_coordinates(spark):
    tx = spark.createDataFrame([("t1", "2L", 101, 200, "+"), ("t2", "chrX", 101, 200, "-")], "fbtr string, chrom string, g_start int, g_end int, t_strand string")
    h = spark.createDataFrame([("t1", 1, 10), ("t2", 1, 10), ("t3", 1, 10)], "qseqid string, qstart int, qend int")
    got = {r["qseqid"]: (r["chrom"], r["bed_start"], r["bed_end"]) for r in iv.to_genomic(h, tx).collect()}
    assert got == {"t1": ("chr2L", 100, 110), "t2": ("chrX", 190, 200)}


def test_locus_keeps_first_of_equal_scores(spark):
    rows = [("t", "c", 5, 20, "x", "F", 1.0, 90.0, 10, 2, 1), ("t", "c", 1, 9, "y", "G", 1.0, 80.0, 12, 3, 2), ("t", "c", 31, 40, "y", "G", 0.5, 70.0, 9, 1, 3)]
    df = spark.createDataFrame(rows, "transcript string, chrom string, start int, end int, te_id string, te_family string, score double, pident double, length int, syntenic_species int, n int")
    out = {r["start"]: r for r in lc.collapse_loci(df, ties=["n"]).collect()}
    assert set(out) == {1, 31}
    assert (out[1]["end"], out[1]["best_pident"], out[1]["te_families"], out[1]["max_species"]) == (20, 80.0, ["F", "G"], 3)


def test_complexity_keeps_rows_without_sequence(spark):
    df = spark.createDataFrame([(1, "A" * 30), (2, "ACGTTGCAATCG"), (3, None), (4, "AT-ATTAAC")], "i int, qseq string")
    got = {r["i"] for r in lc.complexity_filter(df).collect()}
    assert got == {2, 3}
    assert {r["reason"]: r["hits"] for r in lc.complexity_counts(df).collect()}["low_entropy"] == 2


def test_best_match_prefers_score_then_order(spark):
    left = spark.createDataFrame([(1, "t", "e", 90.0, 100)], "i int, transcript string, te_id string, pident double, length int")
    right = spark.createDataFrame(
        [("t", "e", 90.0, 50, 5, 0.1), ("t", "e", 89.0, 100, 9, 0.2), ("t", "e", 91.0, 100, 7, 0.3)],
        "transcript string, te_id string, r_pident double, r_length int, no int, phylo double",
    )
    r = lc.best_match_join(left, right, ["transcript", "te_id"], ["i"], "no", ["phylo"]).collect()
    assert len(r) == 1 and r[0]["phylo"] == 0.3 and r[0]["match_score"] == pytest.approx(1.99)


def test_funnel_counts_removed_rows(spark):
    df = spark.range(10)
    got = [tuple(r) for r in lc.filter_funnel(df, {"a": F.col("id") > 2, "b": F.col("id") % 2 == 0}).orderBy("step").collect()]
    assert got == [(1, "a", 7, 3), (2, "b", 3, 4)]


@pytest.mark.parametrize("few,min_score", [(1, 1.5), (64, 1.5), (1, 0.8)])
def test_best_match_on_grids_equals_all_pairs(spark, few, min_score):
    rng = random.Random(few)
    shape = lambda: (round(rng.choice([rng.uniform(0, 100), rng.gauss(80, 3), 50.0]), 2), rng.choice([rng.randint(0, 5000), rng.randint(90, 110), 100]))
    left = [("hot" if i < 250 else f"k{i % 40}", i, *shape()) for i in range(330)] + [("hot", 900, None, 5), (None, 901, 1.0, 5)]
    right = [("hot" if i < 300 else f"k{i % 40}", i, *shape()) for i in range(380)] + [("hot", 950, None, 7), ("hot", 951, 80.0, None)]
    ldf = spark.createDataFrame(left, "k string, i int, pident double, length int")
    rdf = spark.createDataFrame(right, "k string, no int, r_pident double, r_length int").withColumn("tag", F.concat(F.lit("t"), F.col("no").cast("string")))
    got = {r["i"]: (r["match_score"], r["no"]) for r in lc.best_match_join(ldf, rdf, ["k"], ["i"], "no", ["no", "tag"], min_score, few=few).collect()}
    want = {}
    for k, i, p, n in left:
        scored = [((1 - abs(p - rp) / 100) + (1 - abs(n - rn) / max(n, rn, 1)), -no) for rk, no, rp, rn in right if rk == k and None not in (k, p, n, rp, rn)]
        if scored and max(scored)[0] > min_score:
            want[i] = (max(scored)[0], -max(scored)[1])
    assert got == want and len(want) > 150
