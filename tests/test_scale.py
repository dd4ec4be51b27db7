import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally import scale


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how):
    left = spark.range(600).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, "k", how)
    salted = scale.skew_join(left, right, ["k"], how, hot_rows=20, force=True)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_skew_join_rejects_full_outer(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        scale.skew_join(df, df, ["k"], "full")


def test_row_numbers_cover_every_row_once(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = {r["id"]: r["row_no"] for r in scale.with_row_number(df, F.desc("v"), F.asc("id")).collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_quantiles_and_upper_median_match_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(str(g), float(v)) for g, n in (("a", 101), ("b", 40), ("c", 1)) for v in rng.integers(0, 30, n)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in scale.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    up = {r["g"]: r["m"] for r in scale.upper_median(df, ["g"], "v", "m").collect()}
    for g in "abc":
        vals = sorted(v for k, v in rows if k == g)
        for name, p in (("q1", 0.25), ("q2", 0.5), ("q9", 0.9)):
            assert got[g][name] == pytest.approx(np.quantile(vals, p))
        assert up[g] == vals[len(vals) // 2]


def test_conditional_upper_medians(spark):
    rows = [(i % 17, i) for i in range(100)]
    df = spark.createDataFrame(rows, "v int, i int")
    conds = {"all": F.lit(True), "big": F.col("i") >= 60, "none": F.col("i") > 1000}
    got = {r["label"]: r["m"] for r in scale.conditional_upper_medians(df, "v", conds, "m").collect()}
    big = sorted(v for v, i in rows if i >= 60)
    every = sorted(v for v, _ in rows)
    assert got == {"all": every[50], "big": big[20], "none": None}


def test_running_minimum_over_slabs(spark):
    vals = [(i, (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(vals, "i int, v int")
    got = {r["i"]: r["m"] for r in scale.running_over_slabs(df, [F.asc("i")], "v", F.min, "m").collect()}
    assert got == {i: min(v for j, v in vals if j <= i) for i, _ in vals}
