import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally.functions import stats as st
from seqtally.operators import enrichment as en
from seqtally.scale import join_per_value


def test_fisher_textbook_tables():
    assert st.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert st.fisher_p(8, 2, 1, 5) == pytest.approx(0.0349650350)
    assert st.fisher_p(0, 0, 4, 5) == 1.0


def test_odds_ratio_edges(spark):
    rows = [(2, 3, 4, 5), (2, 0, 4, 5), (0, 0, 4, 5), (0, 3, 4, 5)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = [r[0] for r in df.select(st.odds_ratio("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(10 / 12) and math.isinf(got[1]) and math.isnan(got[2]) and got[3] == 0


def test_exact_rank_test_equals_enumeration():
    x, y = [1.5, 4.0, 9.0], [2.0, 3.0, 5.0, 8.0]
    both = sorted(x + y)

    def u_of(sample):
        return sum(both.index(v) + 1 for v in sample) - len(sample) * (len(sample) + 1) / 2

    u = u_of(x)
    top = max(u, 12 - u)
    every = [u_of(c) for c in itertools.combinations(both, 3)]
    want = min(1.0, 2 * sum(v >= top for v in every) / len(every))
    assert st.mann_whitney_p(u, 3, 4, 0) == pytest.approx(want)


def test_normal_rank_test_published_example():
    assert st.normal_u_p(17, 5, 4, 0) == pytest.approx(0.1113469, abs=1e-6)
    assert st.mann_whitney_p(17, 5, 4, 0) == pytest.approx(0.1111111, abs=1e-6)


def test_mann_whitney_frame_against_brute_force(spark):
    rng = np.random.default_rng(4)
    genes = [(f"g{i}", float(v)) for i, v in enumerate(rng.integers(0, 25, 90))]
    sets = [(s, f"g{i}") for s, n in (("one", 30), ("two", 4), ("few", 2)) for i in rng.choice(90, n, replace=False)]
    got = {
        r["set_name"]: r
        for r in en.mann_whitney(
            spark.createDataFrame(sets, "set_name string, fbgn string"), spark.createDataFrame(genes, "fbgn string, v double"), "v"
        ).collect()
    }
    val = dict(genes)
    for s in ("one", "two", "few"):
        inside = [val[g] for k, g in sets if k == s]
        members = {g for k, g in sets if k == s}
        outside = [v for g, v in genes if g not in members]
        u = sum((a > b) + 0.5 * (a == b) for a in inside for b in outside)
        assert got[s]["median_in"] == np.median(inside)
        assert got[s]["median_out"] == np.median(outside)
        if s == "few":
            assert math.isnan(got[s]["u"]) and math.isnan(got[s]["mw_p"])
        else:
            assert got[s]["u"] == pytest.approx(u)
            assert 0 <= got[s]["mw_p"] <= 1


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.04, float("nan"), 0.2]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r["i"]: r["q"] for r in en.bh_adjust(df, "p").collect()}
    clean = [1.0 if math.isnan(x) else x for x in p]
    order = sorted(range(len(p)), key=lambda i: clean[i])
    q, best = {}, 1.0
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        best = min(best, clean[i] * len(p) / rank)
        q[i] = best
    assert got == pytest.approx(q)
    assert all(got[i] >= clean[i] for i in got)


def test_null_comparison_sample_and_population(spark):
    real = spark.createDataFrame([(220,)], "n int")
    reps = spark.createDataFrame([(90,), (100,), (110,)], "n int")
    a = en.null_comparison(real, reps, ["n"]).collect()[0]
    b = en.null_comparison(real, reps, ["n"], ddof=0).collect()[0]
    assert (a["fold"], a["null_sd"], a["z"]) == pytest.approx((2.2, 10.0, 12.0))
    assert b["null_sd"] == pytest.approx(math.sqrt(200 / 3))
    one = en.null_comparison(real, reps.limit(1), ["n"]).collect()[0]
    assert one["null_sd"] == 0 and one["z"] is None


def test_enrichment_drops_small_sets_and_corrects(spark):
    genes = [(f"g{i}", i % 7, i % 3, i % 7 - i % 3, 1000) for i in range(60)]
    hits = spark.createDataFrame(genes, "fbgn string, total_hits int, sense_hits int, anti_hits int, total_utr_len int")
    sets = [("go_a", f"g{i}") for i in range(0, 30)] + [("expr_b", f"g{i}") for i in range(25, 60)] + [("go_c", "g1")]
    out = {r["set_name"]: r for r in en.enrichment(spark.createDataFrame(sets, "set_name string, fbgn string"), hits).collect()}
    assert set(out) == {"go_a", "expr_b"}
    for r in out.values():
        assert r["fisher_q"] >= r["fisher_p"] - 1e-12 and r["mw_q"] >= r["mw_p"] - 1e-12
        assert r["a"] + r["b"] + r["c"] + r["d"] == 60


def test_effect_size_caps(spark):
    df = spark.createDataFrame([(float("inf"), 0.0), (0.0, 1e-300), (float("nan"), 1.0)], "o double, q double")
    got = df.select(st.log2_or_capped(F.col("o")), st.volcano_x(F.col("o")), st.volcano_y(F.col("q"))).collect()
    assert got[0][0] == pytest.approx(math.log2(100)) and got[0][2] == 200
    assert got[1][0] == pytest.approx(math.log2(0.01)) and got[1][1] is None and got[2][0] is None


def counted_tail(u, n1, n2):
    """P(U >= u) from the ways to reach every U, one value at a time."""
    ways = {(0, 0, 0): 1}
    for _ in range(n1 + n2):
        step = {}
        for (i, j, s), n in ways.items():
            if i < n1:
                step[i + 1, j, s + j] = step.get((i + 1, j, s + j), 0) + n
            if j < n2:
                step[i, j + 1, s] = step.get((i, j + 1, s), 0) + n
        ways = step
    return sum(n for (_, _, s), n in ways.items() if s >= u) / math.comb(n1 + n2, n1)


def test_exact_tail_equals_counting_for_all_small_sides():
    for n1, n2 in itertools.product(range(1, 7), range(1, 9)):
        for u in [x / 2 for x in range(-1, 2 * n1 * n2 + 3)]:
            assert st.exact_u_tail(u, n1, n2) == pytest.approx(counted_tail(u, n1, n2), rel=1e-15)
    assert st.exact_u_tail(0, 8, 40) == 1.0


def test_exact_tail_of_a_huge_side():
    n = 10**7
    half = st.exact_u_tail(4 * n, 8, n)
    assert half == pytest.approx(0.5, abs=1e-7) and half > 0.5
    assert st.exact_u_tail(8 * n, 8, n) == 1 / math.comb(n + 8, 8)
    u = 6.5 * n
    # eight places among so many are eight even shares: the sum of eight uniform numbers
    assert st.exact_u_tail(u, 8, n) == pytest.approx((1.5**8 - 8 * 0.5**8) / math.factorial(8), rel=1e-5)
    assert st.exact_u_tail(u, 8, n) + st.exact_u_tail(8 * n - u + 1, 8, n) == pytest.approx(1, abs=1e-15)


def test_crowded_values_are_joined_slab_by_slab(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, 1.0).otherwise(F.col("id") % 7 / 8).alias("p"), F.lit("x").alias("part"))
    table = df.select("p").distinct().where("p <> 0").withColumn("twice", F.col("p") * 2)
    got = join_per_value(df, table, "p")
    assert got.columns == ["p", "id", "part", "twice"]
    assert {(r["id"], r["p"], r["twice"]) for r in got.collect()} == {(r["id"], r["p"], 2 * r["p"]) for r in df.collect() if r["p"]}
    text = got._jdf.queryExecution().toString()
    assert "_part" in text
