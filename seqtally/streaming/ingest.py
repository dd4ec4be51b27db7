"""Incremental hit ingest with running strand tallies per subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.coords import is_plus
from ..operators.rollups import pct
from ..sources.hits import HIT_SCHEMA


def stream_hits(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Hit files as they arrive in a folder."""
    reader = spark.readStream.schema(HIT_SCHEMA).option("sep", "\t")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(folder)


def running_tallies(hits: DataFrame) -> DataFrame:
    """Counts per subject; state is one small row per subject, whatever the hit volume."""
    return hits.groupBy(F.col("sseqid").alias("te_id")).agg(
        F.count(F.lit(1)).alias("total_hits"),
        F.count_if(is_plus()).alias("sense_hits"),
        F.count_if(~is_plus()).alias("anti_hits"),
        F.sum("length").alias("total_bp"),
    )


def tally_report(tallies: DataFrame, min_hits: int = 10) -> DataFrame:
    """Subjects with enough hits and their strand shares."""
    total = F.col("total_hits")
    return tallies.where(total >= min_hits).withColumns(
        {"sense_pct": pct(F.col("sense_hits"), total), "anti_pct": pct(F.col("anti_hits"), total)}
    )


def ingest(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    files_per_trigger: int | None = None,
    compact_every: int | None = 50,
) -> StreamingQuery:
    """Process what is in `folder`, then stop; each batch adds its changed rows to the table at `out`.

    A batch writes the new tallies of the subjects it touched under its number, so one that
    is retried after a failure writes the same rows again, and `latest` takes each subject's
    row of the highest number. Every `compact_every` batches the table is compacted, so what
    `latest` reads does not grow with the number of batches.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")
        if compact_every and (number + 1) % compact_every == 0:
            compact(batch.sparkSession, out, number)

    return (
        running_tallies(stream_hits(spark, folder, files_per_trigger))
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str, committed: bool = False) -> list[int]:
    """Numbers of the folders `name=number` below `path`; only those with a finished write if `committed`."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place) if "=" in s.getPath().getName()]
    if committed:
        found = [p for p in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in found)


def compact(spark: SparkSession, out: str, upto: int) -> None:
    """Fold all batches up to number `upto` into one table, then name it in the manifest.

    Readers go by the manifest alone, and its entry is written last: a compaction that stops
    halfway changes nothing and is done again by whoever retries; one that has its entry is left
    as it is. Batches and tables that the entry before the new one already covered are removed,
    so those who have just read that entry still find what it names.
    """
    known = _numbers(spark, f"{out}/_manifest", committed=True)
    if known and known[-1] >= upto:
        return
    latest(spark, out, upto).write.mode("overwrite").parquet(f"{out}/_compacted/upto={upto:09d}")
    entry = spark.range(1).selectExpr(f"cast({upto} as long) as upto")
    entry.write.mode("overwrite").parquet(f"{out}/_manifest/entry={upto:09d}")
    covered = known[-1] if known else -1
    old = [f"{out}/batch={n:09d}" for n in _numbers(spark, out) if n <= covered]
    old += [f"{out}/_compacted/upto={n:09d}" for n in _numbers(spark, f"{out}/_compacted") if n < covered]
    old += [f"{out}/_manifest/entry={n:09d}" for n in known if n < covered]
    for path in old:
        files, place = _files(spark, path)
        files.delete(place, True)


def latest(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The newest tallies of every subject, or those after batch `upto`.

    Reads the table the manifest names and the batches after it.
    """
    known = [n for n in _numbers(spark, f"{out}/_manifest", committed=True) if upto is None or n <= upto]
    fields = "te_id string, total_hits long, sense_hits long, anti_hits long, total_bp long"
    every = spark.read.schema(f"{fields}, batch long").parquet(out)
    if upto is not None:
        every = every.where(F.col("batch") <= upto)
    if known:
        folded = spark.read.schema(fields).parquet(f"{out}/_compacted/upto={known[-1]:09d}")
        every = every.where(F.col("batch") > known[-1]).unionByName(folded.withColumn("batch", F.lit(known[-1]).cast("long")))
    values = [c for c in every.columns if c not in ("te_id", "batch")]
    newest = every.groupBy("te_id").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select("te_id", "v.*")
