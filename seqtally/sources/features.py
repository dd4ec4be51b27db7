"""Genome features: GFF, repeat tables and multi-species alignment blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import empty_to_null

GFF_SCHEMA = (
    "chrom string, source string, type string, start int, end int, score string, "
    "strand string, phase string, attributes string"
)
# Assembly names in alignment files.
REFERENCE_ASSEMBLY = "dm6"
SPECIES = ("droSim1", "droYak2", "droYak3", "droEre2", "droSec1")


def read_gff(
    spark: SparkSession, path: str, feature: str, explode_parent: bool = True, chr_prefix: bool = False
) -> DataFrame:
    """Features of one type: chrom, start, end, strand, parent, attributes.

    Several parents become several rows unless explode_parent is off.
    """
    rows = (
        spark.read.csv(path, sep="\t", schema=GFF_SCHEMA, comment="#")
        .where((F.col("type") == feature) & F.col("attributes").isNotNull())
        .withColumn("parent", empty_to_null(F.regexp_extract("attributes", "(?:^|;)Parent=([^;]+)", 1)))
    )
    if explode_parent:
        rows = rows.withColumn("parent", F.explode_outer(F.split("parent", ",")))
    if chr_prefix:
        rows = rows.withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    return rows.select("chrom", "start", "end", "strand", "parent", "attributes")


def read_subject_regions(spark: SparkSession, path: str) -> DataFrame:
    """Structural regions of subjects: region_id, region, reg_start, reg_end, family_key.

    LTR in the type means LTR, CDS stays, whole elements are dropped, the rest is other.
    """
    kind = F.col("type")
    region = (
        F.when(kind.contains("LTR"), "LTR")
        .when(kind == "CDS", "CDS")
        .when(F.lower(kind).contains("transposon"), F.lit(None))
        .otherwise("other")
    )
    return (
        spark.read.csv(path, sep="\t", schema=GFF_SCHEMA, comment="#")
        .where(F.col("attributes").isNotNull())
        .select(
            F.col("chrom").alias("region_id"),
            region.alias("region"),
            F.col("start").alias("reg_start"),
            F.col("end").alias("reg_end"),
        )
        .where(F.col("region").isNotNull())
    )


def read_region_lengths(spark: SparkSession, path: str) -> DataFrame:
    """region_id and length from the ##sequence-region lines."""
    parts = F.split(F.trim("value"), "[ \t]+")
    return (
        spark.read.text(path)
        .where(F.col("value").startswith("##sequence-region"))
        .select(F.get(parts, F.lit(1)).alias("region_id"), F.get(parts, F.lit(3)).cast("int").alias("length"))
    )


def read_family_map(spark: SparkSession, path: str) -> DataFrame:
    """family_key (lower-case name attribute without species prefix) -> region_id."""
    name = F.replace(F.regexp_extract("attributes", "(?:^|;)name=([^;]+)", 1), F.lit("Dmel\\"), F.lit(""))
    return (
        spark.read.csv(path, sep="\t", schema=GFF_SCHEMA, comment="#")
        .select(F.lower(name).alias("family_key"), F.col("chrom").alias("region_id"))
        .where(F.col("family_key") != "")
        .groupBy("family_key")
        .agg(F.max("region_id").alias("region_id"))
    )


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Repeat table: three header lines and rows that do not parse drop out; chr is cut."""
    p = F.split(F.trim("value"), "[ \t]+")

    def col(i: int, kind: str | None = None):
        c = F.get(p, F.lit(i))
        return c.try_cast(kind) if kind else c

    rows = spark.read.text(path).select(
        col(0, "double").alias("score"),
        col(1, "double").alias("divergence"),
        col(2, "double").alias("deletion"),
        col(3, "double").alias("insertion"),
        F.regexp_replace(col(4), "^chr", "").alias("chrom"),
        col(5, "int").alias("r_start"),
        col(6, "int").alias("r_end"),
        col(8).alias("strand"),
        col(9).alias("repeat_name"),
        col(10).alias("repeat_class"),
        F.size(p).alias("_n"),
    )
    return rows.where(F.col("_n") >= 14).drop("_n").dropna(
        subset=["score", "divergence", "deletion", "insertion", "r_start", "r_end"]
    )


def read_maf_blocks(
    spark: SparkSession,
    path: str,
    reference: str = REFERENCE_ASSEMBLY,
    species: Sequence[str] = SPECIES,
) -> DataFrame:
    """Alignment blocks to one row per block and species: chrom, b_start, b_end, species.

    The span is the reference row's, 0-based half-open. Files are split at block borders
    and each block is handled inside its row, so nothing is shuffled.
    """
    block = spark.read.option("lineSep", "\na").text(path)
    rows = F.filter(F.split("value", "\n"), lambda x: x.startswith("s "))
    fields = F.transform(rows, lambda x: F.split(x, "[ \t]+"))
    ref = F.get(F.filter(fields, lambda f: F.split_part(f[1], F.lit("."), F.lit(1)) == reference), F.lit(0))
    names = F.array_distinct(F.transform(fields, lambda f: F.split_part(f[1], F.lit("."), F.lit(1))))
    start = F.get("r", F.lit(2)).cast("int")
    return (
        block.select(ref.alias("r"), names.alias("n"))
        .where(F.col("r").isNotNull())
        .select(
            F.regexp_replace(F.get("r", F.lit(1)), f"^{reference}[.]", "").alias("chrom"),
            start.alias("b_start"),
            (start + F.get("r", F.lit(3)).cast("int")).alias("b_end"),
            F.explode(F.filter("n", lambda s: s.isin(*species))).alias("species"),
        )
    )
