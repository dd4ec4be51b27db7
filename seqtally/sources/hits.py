"""Hit tables as text: 17, 16, 14 or 12 columns, BED, conservation and synteny tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coords import strand, unpack_hit_name
from ..operators.hits import filter_hits
from ..operators.intervals import syntenic_count
from ..operators.nullmodel import systematic_sample

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
HIT_FIELDS = [
    ("qseqid", _S), ("sseqid", _S), ("pident", _D), ("length", _I), ("mismatch", _I),
    ("gapopen", _I), ("qstart", _I), ("qend", _I), ("sstart", _I), ("send", _I),
    ("evalue", _D), ("bitscore", _D), ("qlen", _I), ("slen", _I), ("qseq", _S),
    ("sseq", _S), ("strand", _S),
]
HIT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in HIT_FIELDS])


def read_hits(
    spark: SparkSession,
    path: str,
    add_strand: bool = True,
    min_length: int | None = None,
    min_pident: float | None = None,
    max_evalue: float | None = None,
) -> DataFrame:
    """Tab-separated hits of any prefix width; columns a file lacks are null.

    A missing or empty path gives an empty table with the full schema.
    """
    try:
        hits = spark.read.csv(path, sep="\t", schema=HIT_SCHEMA, mode="PERMISSIVE")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], HIT_SCHEMA)
    if add_strand:
        known = F.col("sstart").isNotNull() & F.col("send").isNotNull()
        hits = hits.withColumn("strand", F.coalesce("strand", F.when(known, strand())))
    return filter_hits(hits, min_length, min_pident, max_evalue)


def parse_hit_line(line: Column) -> dict[str, Column]:
    """Typed columns out of one text line; an empty number is 0, a missing column null."""
    parts = F.split(F.trim(line), "\t")
    out = {}
    for i, (name, kind) in enumerate(HIT_FIELDS):
        raw = F.get(parts, F.lit(i))
        if kind is not _S:
            raw = F.when(raw == "", F.lit(0).cast(kind)).otherwise(raw.try_cast(kind))
        out[name] = raw
    a, b = out["sstart"], out["send"]
    out["strand"] = F.coalesce(out["strand"], F.when((a != 0) & (b != 0), strand(a, b)))
    return out


BED_SCHEMA = "chrom string, start int, end int, name string, score string, strand string"


def read_bed_hits(spark: SparkSession, path: str, every: int = 1) -> DataFrame:
    """BED rows with category, transcript, subject, pident and length out of the name.

    every=n keeps lines 1, 1 + n, 1 + 2n ... in file order (files of a folder by name).
    """
    if every <= 1:
        return unpack_hit_name(spark.read.csv(path, sep="\t", schema=BED_SCHEMA))
    names = [c.split() for c in BED_SCHEMA.split(", ")]
    line = F.split("value", "\t")
    numbered = spark.read.text(path).select(
        *[F.get(line, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(names)],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_n"),
    )
    kept = systematic_sample(numbered, every, F.asc("_file"), F.asc("_block"), F.asc("_n"))
    return unpack_hit_name(kept.drop("_file", "_block", "_n", "row_no"))


def read_conservation(spark: SparkSession, path: str) -> DataFrame:
    """Averages per interval; the score is the sixth column (mean over covered bases)."""
    schema = "name string, size int, covered int, sum double, mean0 double, score double"
    return unpack_hit_name(spark.read.csv(path, sep="\t", schema=schema))


def read_synteny(spark: SparkSession, path: str) -> DataFrame:
    """Synteny table with header; adds transcript, subject and the species count at 0.5."""
    df = spark.read.csv(path, sep="\t", header=True)
    covs = [c for c in df.columns if c.endswith("_coverage")]
    casts = {c: F.col(c).cast("double") for c in ["pident", *covs]}
    casts |= {c: F.col(c).cast("int") for c in ["start", "end", "length"]}
    parts = F.split("name", "[|]")
    four = ["sim_coverage", "yak_coverage", "ere_coverage", "sec_coverage"]
    return df.withColumns(casts).withColumns(
        {
            "transcript": F.get(parts, F.lit(1)),
            "subject": F.get(parts, F.lit(2)),
            "syntenic_species": syntenic_count(four),
        }
    )


def read_strand_bias(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "fbtr string, fbgn string, utr_len long, total_hits long, sense_hits long, "
        "anti_hits long, sense_pct double, anti_pct double"
    )
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_gene_density(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "rank long, fbgn string, density double, hits long, hit_bp long, total_utr_len long, "
        "num_transcripts long, top_te_1 string, top_te_2 string, top_te_3 string"
    )
    return spark.read.csv(path, sep="\t", header=True, schema=schema)
