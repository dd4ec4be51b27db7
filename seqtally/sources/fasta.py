"""FASTA: splitting files at record borders so large files are read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import empty_to_null, family_class, family_name


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (first token), header, seq. Sequence lines are joined."""
    text = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    lines = F.split(record, "\n", 2)
    header = F.trim(F.get(lines, F.lit(0)))
    body = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    return (
        text.select(header.alias("header"), F.regexp_replace(body, "[ \t\r\n]", "").alias("seq"))
        .where(F.col("header") != "")
        .select(F.split_part("header", F.lit(" "), F.lit(1)).alias("seq_id"), "header", "seq")
    )


def read_fasta_attrs(spark: SparkSession, path: str) -> DataFrame:
    """read_fasta plus length, parent, fbgn and fbtr from the header attributes.

    A parent may list several ids; fbtr falls back to the record id when that is one.
    """
    parent = empty_to_null(F.regexp_extract("header", "(?:^|[ ])parent=([^; ]+)", 1))
    ids = F.split("parent", ",")

    def last_with(prefix: str):
        found = F.filter(ids, lambda p: p.startswith(prefix))
        return F.try_element_at(found, F.lit(-1))

    return (
        read_fasta(spark, path)
        .withColumns(
            {
                "length": empty_to_null(F.regexp_extract("header", "(?:^|[ ])length=([0-9]+)", 1)).cast("int"),
                "parent": parent,
            }
        )
        .withColumns(
            {
                "fbgn": last_with("FBgn"),
                "fbtr": F.when(F.col("seq_id").startswith("FBtr"), F.col("seq_id")).otherwise(last_with("FBtr")),
            }
        )
    )


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """te_id, family, te_class, te_length; a header without a name keeps the id as Unknown."""
    name = family_name(F.col("header"))
    return read_fasta(spark, path).select(
        F.col("seq_id").alias("te_id"),
        F.coalesce(name, "seq_id").alias("family"),
        F.when(name.isNull(), "Unknown").otherwise(family_class(name)).alias("te_class"),
        F.length("seq").alias("te_length"),
    )
