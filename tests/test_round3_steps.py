"""What the named queries of round 3 read once, drop early or keep small."""

from __future__ import annotations

import random

import duckdb
from oracle import connect

from seqtally.operators import enrichment, intervals, loci, rollups, signal
from seqtally.plans.registry import check_texts, run


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _counted(spark, df):
    """`df` with an accumulator that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def add(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(add, df.schema), made


def test_peaks_are_made_once(spark):
    rows = [("q", 3 * i, float(i % 7)) for i in range(40)]
    df, made = _counted(spark, spark.createDataFrame(rows, "qseqid string, pos int, combined double"))
    got = sorted(r["pos"] for r in signal.space_out(df, 10).collect())
    assert got == list(range(0, 120, 12))
    assert made.value == 40


def test_places_of_peaks_are_those_of_the_peaks(spark):
    rows = [("q", 5 * i, 5 * i + 5, 400, float(1 + i * 7 % 11)) for i in range(80)]
    runs = spark.createDataFrame(rows, "qseqid string, lo int, hi int, qlen int, combined double")
    counted, made = _counted(spark, runs)
    got = sorted(tuple(r) for r in signal.peak_places(counted).collect())
    assert got == sorted((r["qseqid"], r["pos"]) for r in signal.find_peaks(runs).collect()) and len(got) > 10
    assert made.value == 80


def test_genes_are_made_once_for_both_orders(spark):
    rows = [(f"g{i}", 100 + i, float(i % 5), float(i % 3)) for i in range(30)]
    df, made = _counted(spark, spark.createDataFrame(rows, "gene string, total_length long, max_signal double, signal_per_kb double"))
    got = {r["gene"]: (r["rank_signal"], r["rank_per_kb"]) for r in rollups.signal_ranking(df).collect()}
    for at, name in ((2, 0), (3, 1)):
        want = [r[0] for r in sorted(rows, key=lambda r: (-r[at], r[0]))]
        assert [g for g, _ in sorted(got.items(), key=lambda x: x[1][name])] == want
    assert made.value == 30


def test_bins_are_summed_where_they_lie(spark):
    """Long queries of several tiles, two lengths for one query, tiles without hits."""
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        q, qlen = rng.choice([("a", 130), ("b", 9000), ("b", 12345), ("c", None)])
        start = rng.randint(1, 120 if q == "a" else 4200)
        rows.append((q, qlen, start, start + rng.randint(0, 300), 50.0 + rng.random(), rng.random(), 1.0, 1, 2))
    hits = spark.createDataFrame(rows, "qseqid string, qlen int, qstart int, qend int, pident double, evalue double, bitscore double, sstart int, send int")
    df = signal.binned_signal(hits)
    assert "Join" not in _plan(df)
    got = {(r["qseqid"], r["bin"]): r["mean_signal"] for r in df.collect()}
    want = {}
    for q, size in (("a", 130), ("b", 12345)):
        line = [0.0] * size
        for r in rows:
            lo, hi = r[2] - 1, min(r[3], r[1] or r[3])
            for p in range(lo, min(hi, size)) if r[0] == q and lo < hi else ():
                line[p] += r[4] / 100 / r[5] / (hi - lo)
        want |= {(q, i): sum(line[50 * i : 50 * i + 50]) / len(line[50 * i : 50 * i + 50]) for i in range(-(-size // 50))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)


def test_cohort_hits_are_counted_once_and_may_come_in_many_rows(spark):
    rows = [("a", "x", 2), ("a", "x", 1), ("b", "x", 4), ("a", "y", 1), ("b", "z", 1)]
    df, made = _counted(spark, spark.createDataFrame(rows, "cohort string, family string, hits long"))
    got = sorted(tuple(r) for r in enrichment.family_contrast(df, "a", "b").collect())
    assert got == [("x", 3, 4, 75.0, 80.0, 0.9375), ("y", 1, 0, 25.0, 0.0, float("inf")), ("z", 0, 1, 0.0, 20.0, 0.0)]
    assert made.value == 5


def test_funnel_joins_no_hit_with_itself(spark):
    plan = _plan(run("filter_funnel", spark, "/root/testdata/sf0.001"))
    assert "Join [l_orderkey" not in plan


def test_overlapping_gives_each_key_once(spark):
    a = spark.createDataFrame([("c", 0, 5000, 1), ("c", 10, 10, 2), ("d", 0, 9, 3), ("c", 100, 120, 4)], "chrom string, s int, e int, k int")
    b = spark.createDataFrame([("c", 5, 30), ("c", 20, 40), ("c", 4000, 4100), ("c", 110, 110)], "chrom string, bs int, be int")
    found = intervals.overlapping(a, b, ["chrom"], ("s", "e"), ("bs", "be"), ["k"])
    assert [r["k"] for r in found.collect()] == [1]


def test_loci_without_details_carry_only_what_they_show(spark):
    rows = [("t", "c", 10 * i * (1 + i // 7), 10 * i * (1 + i // 7) + 8, f"f{i % 3}", i % 5 + 0.5) for i in range(30)]
    named = spark.createDataFrame(rows, "transcript string, chrom string, start long, end long, te_family string, score double")
    lean = loci.collapse_loci(named, details=False)
    extra = {"te_id": "te_family", "pident": "score", "length": "end", "syntenic_species": "start"}
    full = loci.collapse_loci(named.selectExpr("*", *[f"{v} as {k}" for k, v in extra.items()]))
    assert lean.count() > 3
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, full.select(*lean.columns).collect()))


def test_hits_that_share_their_keys_are_paired_as_the_sql_pairs_them(spark):
    """Some hits of the smallest tables share all four keys."""
    folder = "/root/testdata/sf0.001"
    con = connect(folder)
    for name in ("filter_funnel", "filtered_ranked_loci"):
        df = run(name, spark, folder)
        want = con.sql(check_texts()[name]).select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)


def _shuffled(spark) -> int:
    """Rows that the session's stages have shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


def test_pairs_of_hits_and_regions_are_not_shuffled(spark):
    rng = random.Random(3)
    hits = [(i, rng.choice(["fa", "Fb", "none", None]), 9, a, a + 300) for i in range(200) for a in [rng.randrange(600)]]
    hits += [(200, "fa", 9, 5000, 5010), (201, "fa", 9, None, 7), (202, "fb", 9, 4, 4), (203, "fc", 9, 10, 90)]
    regions = [(rng.choice(["r1", "r2"]), rng.choice(["LTR", "CDS"]), a, a + 400) for _ in range(400) for a in [rng.randrange(500)]]
    maps = [("fa", "r1"), ("fb", "r2"), ("fb", "r1"), ("fb", "r9"), ("fc", "r9")]
    h = spark.createDataFrame(hits, "id int, family string, length int, s_lo int, s_hi int").repartition(3)
    r = spark.createDataFrame(regions, "region_id string, region string, reg_start int, reg_end int")
    m = spark.createDataFrame(maps, "family_key string, region_id string")
    broadcast, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    got = sorted(map(str, rollups.region_overlap(h, r, m, ["id"]).select("id", "region", "region_bp").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    moved = _shuffled(spark) - before
    known, want = {x[0] for x in regions}, []
    for i, family, length, lo, hi in hits:
        ids = [rid for f, rid in maps if family is not None and f == family.lower() and rid in known]
        own = [(region, min(hi, e) - max(lo, b)) for rid in ids for x, region, b, e in regions if x == rid and lo is not None and max(lo, b) < min(hi, e)]
        if not own:
            own = [("intergenic", None if lo is None else hi - lo) for _ in ids] or [("unannotated", length)]
        want += [f"Row(id={i}, region='{region}', region_bp={bp})" for region, bp in own]
    assert got == sorted(want)
    assert moved < len(want) / 2
