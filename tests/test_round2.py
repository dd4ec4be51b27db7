"""Cases that once were wrong: crowded keys, large weights, missing rows, literal substrings."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqtally import scale, session
from seqtally.functions import names
from seqtally.operators import annotation, hits, rollups, signal
from seqtally.plans.shape import narrow


def test_key_with_most_rows_of_both_sides(spark):
    left = spark.range(400).select(F.when(F.col("id") < 360, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(200).select(F.when(F.col("id") < 180, 1).otherwise(F.col("id") + 180).alias("k"), (F.col("id") * 3).alias("v"))
    plain = left.join(right, "k")
    salted = scale.skew_join(left, right, ["k"], hot_rows=25, force=True)
    key = lambda df: sorted(map(tuple, df.select("k", "id", "v").collect()))
    assert key(salted) == key(plain) and plain.count() == 360 * 180 + 40 - 20


def test_scratch_folder_is_made_once_and_released(spark):
    before = session.scratch_path(spark, "a")
    made = len(list(Path("/tmp").glob("spark-*")))
    again = session.scratch_path(spark, "b")
    assert Path(before).parent == Path(again).parent and len(list(Path("/tmp").glob("spark-*"))) == made
    spark.range(3).write.parquet(again)
    mine = session._WRITTEN[spark.sparkContext.applicationId]
    kept, mine[:] = mine[:-2], mine[-2:]
    assert session.release(spark) == 2 and not Path(again).exists()
    session._WRITTEN[spark.sparkContext.applicationId] = kept


@pytest.mark.parametrize("evalue", [1e-60, 0.0])
def test_small_evalues_keep_their_peak(spark, evalue):
    one = [("q", "te1", 95.0, 20, 30, 49, 1, 20, evalue, 50.0, 200), ("q", "te2", 90.0, 20, 32, 47, 1, 20, 1e-3, 40.0, 200)]
    df = spark.createDataFrame(one, "qseqid string, sseqid string, pident double, length int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int")
    runs = signal.density_runs(df, ["combined"]).withColumn("combined", narrow(F.col("combined")))
    peaks = signal.run_maxima(runs).collect()
    assert len(peaks) == 1 and peaks[0].combined < float("inf")


def test_narrow_keeps_size_and_leading_bits(spark):
    values = [0.0, 1.5, 1e-20, 3.3e37, 4e38, 1.234567891e100, -7e179, 9e205]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", narrow(F.col("v")).alias("w")).collect()
    assert all(r.w == pytest.approx(r.v, rel=1e-7) for r in rows)


def test_replicates_without_hits_count_as_zero(spark):
    rows = [("q1", 90.0, 60, 1), ("q2", 70.0, 20, 1), ("q1", 85.0, 55, 3)]
    df = spark.createDataFrame(rows, "qseqid string, pident double, length int, replicate int")
    got = {r.replicate: (r.total_hits, r.hits_hq, r.mean_pident) for r in hits.replicate_statistics(df, 4).collect()}
    assert got == {1: (2, 1, 80.0), 2: (0, 0, 0.0), 3: (1, 1, 85.0), 4: (0, 0, 0.0)}


def test_unannotated_hits_count_overall_only(spark):
    rows = [("roo", "LTR", 60, 50), ("roo", "unannotated", 60, 60), ("x", "unannotated", 70, 70)]
    got = rollups.region_stats(spark.createDataFrame(rows, "family string, region string, length int, region_bp int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("roo", "LTR", 1, 50), (None, "LTR", 1, 50), (None, "unannotated", 2, 130)]))


def test_missing_tissues_are_zero(spark):
    rows = [("g1", "adult_ovary", 30.0), ("g1", "head_a", 30.0), ("g2", "ovary_b", 30.0), ("g2", "head_a", 2.0)]
    df = spark.createDataFrame(rows, "fbgn string, tissue string, rpkm double")
    universe = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "fbgn string")
    sets = {(r.set_name, r.fbgn) for r in annotation.expression_sets(df, universe=universe).collect()}
    # the two ovary samples average to 15 in both genes; heads to 30 and 2
    assert ("expr_ovary_high", "g1") in sets and ("expr_ovary_high", "g2") in sets
    assert ("expr_ovary_specific", "g2") in sets and ("expr_ovary_specific", "g1") not in sets
    assert ("expr_low", "g3") in sets and ("expr_low", "g1") not in sets


def test_substrings_are_no_patterns(spark):
    df = spark.createDataFrame([("g1", "a+b x"), ("g2", "aab")], "fbgn string, term string")
    got = {(r.set_name, r.fbgn) for r in annotation.localization_sets(df, {"plus": ["a+b"]}).collect()}
    assert got == {("flyfish_plus", "g1"), ("flyfish_any", "g1"), ("flyfish_any", "g2")}
    word = next(w for ws in names.LOCALIZATION_KEYWORDS.values() for w in ws)
    one = spark.createDataFrame([([word.upper()],)], "t array<string>").select(names.localization_categories(F.col("t")).alias("c"))
    assert len(one.first().c) >= 1


def test_candidate_samples_are_bounded_and_enough(spark):
    rows = [(f"s{i:04d}_ovary", 1.0) for i in range(300)] + [(f"t{i:04d}", 1.0) for i in range(300)] + [("adult_head", 1.0)]
    df = spark.createDataFrame(rows, "tissue string, rpkm double").withColumn("fbgn", F.lit("g"))
    few = sorted(r.tissue for r in annotation.candidate_samples(df).collect())
    assert len(few) < 120
    assert annotation.select_tissues(few) == annotation.select_tissues(sorted(t for t, _ in rows))
    assert {r.column_name for r in annotation.tissue_columns(df).collect()} >= {"ovary_rpkm", "head_rpkm"}


def test_expression_files_without_a_header(spark, tmp_path):
    from seqtally.sources.annotation import read_expression_long, read_expression_matrix

    (tmp_path / "empty.tsv").write_text("")
    for read in (read_expression_long, read_expression_matrix):
        got = read(spark, str(tmp_path / "empty.tsv"))
        assert got.columns == ["fbgn", "tissue", "rpkm"] and got.count() == 0


def test_tallies_take_the_newest_row_of_each_subject(spark, tmp_path):
    from seqtally.streaming import ingest

    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    line = "q\t{}\t90\t50\t0\t0\t1\t50\t1\t50\t0.001\t60\n"
    (tmp_path / "in" / "a.tsv").write_text(line.format("te1") + line.format("te2"))
    ingest.ingest(spark, folder, out, state).awaitTermination()
    (tmp_path / "in" / "b.tsv").write_text(line.format("te2") + line.format("te3"))
    ingest.ingest(spark, folder, out, state).awaitTermination()
    assert {r.te_id: r.total_hits for r in ingest.latest(spark, out).collect()} == {"te1": 1, "te2": 2, "te3": 1}
    assert spark.read.parquet(out).count() == 4  # changed subjects only


def test_compacted_tallies_survive_retries(spark, tmp_path):
    from seqtally.streaming import ingest

    out = str(tmp_path / "out")
    schema = "te_id string, total_hits long, sense_hits long, anti_hits long, total_bp long"

    def batch(number, **hits):
        rows = [(k, n, n, 0, 10 * n) for k, n in hits.items()]
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    def totals(upto=None):
        return {r.te_id: r.total_hits for r in ingest.latest(spark, out, upto).collect()}

    batch(0, a=1, b=1)
    batch(1, b=2)
    # stopped before its manifest entry: no reader looks at what it wrote
    spark.createDataFrame([("a", 99, 99, 0, 1)], schema).write.parquet(f"{out}/_compacted/upto=000000001")
    assert totals() == {"a": 1, "b": 2}
    for _ in range(2):  # done again, and again after it was finished
        ingest.compact(spark, out, 1)
        assert totals() == {"a": 1, "b": 2}
    batch(1, b=2)  # a batch that is retried after its compaction
    batch(2, c=5)
    assert totals() == {"a": 1, "b": 2, "c": 5} and totals(1) == {"a": 1, "b": 2}
    ingest.compact(spark, out, 2)
    batch(3, a=7)
    assert totals() == {"a": 7, "b": 2, "c": 5}
    ingest.compact(spark, out, 3)
    # what the entry before the last one names is still there, what is older is gone
    kept = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch"))
    assert kept == ["batch=000000003"] and totals() == {"a": 7, "b": 2, "c": 5}
    assert ingest._numbers(spark, f"{out}/_manifest", committed=True) == [2, 3]


def test_ingest_compacts_as_it_goes(spark, tmp_path):
    from seqtally.streaming import ingest

    (tmp_path / "in").mkdir()
    line = "q\tte{}\t90\t50\t0\t0\t1\t50\t1\t50\t0.001\t60\n"
    for i in range(6):
        (tmp_path / "in" / f"{i}.tsv").write_text(line.format(i % 4) + line.format("x"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 1, compact_every=2).awaitTermination()
    got = {r.te_id: r.total_hits for r in ingest.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {"te0": 2, "te1": 2, "te2": 1, "te3": 1, "tex": 6}
    assert ingest._numbers(spark, str(tmp_path / "out")) == [4, 5]
