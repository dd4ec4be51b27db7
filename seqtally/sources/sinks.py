"""Writers. Every writer is a plain distributed save; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import wrap_lines
from ..operators.annotation import set_summary


def write_tsv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Tab-separated with header; lists joined by commas, booleans as yes/no."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = F.when(c, "yes").otherwise("no")
        elif digits is not None and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.format_string(f"%.{digits}f", c)
    df.withColumns(out).write.csv(path, sep="\t", header=True, emptyValue="")


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    """seq_id, seq as FASTA with lines of `width` letters."""
    df.select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), wrap_lines(F.col("seq"), width))).write.text(path)


def write_bed(df: DataFrame, path: str) -> None:
    """chrom, bed_start, bed_end, name, 0, t_strand."""
    df.select("chrom", "bed_start", "bed_end", "name", F.lit(0).alias("score"), "t_strand").write.csv(path, sep="\t")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, without the sequence column."""
    df.drop("sequence").write.json(path)


def write_gene_sets(sets: DataFrame, path: str, min_genes: int = 10, max_genes: int = 5000) -> DataFrame:
    """Distinct sorted ids, one folder per set inside the size limits; returns the summary."""
    summary = set_summary(sets, min_genes, max_genes)
    kept = sets.select("set_name", "fbgn").distinct().join(summary.select("set_name"), "set_name", "left_semi")
    (
        kept.repartitionByRange("set_name", "fbgn")
        .sortWithinPartitions("set_name", "fbgn")
        .write.partitionBy("set_name")
        .text(path)
    )
    return summary
