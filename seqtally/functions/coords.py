"""Strand, coordinate and hit-name columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strand(sstart: str | Column = "sstart", send: str | Column = "send") -> Column:
    """plus when the subject runs upwards; equal ends count as minus."""
    a = F.col(sstart) if isinstance(sstart, str) else sstart
    b = F.col(send) if isinstance(send, str) else send
    return F.when(a < b, F.lit("plus")).otherwise(F.lit("minus"))


def is_plus() -> Column:
    return F.col("sstart") < F.col("send")


def normalize_coords(hits: DataFrame) -> DataFrame:
    """Query and subject spans with start <= end, as q_lo, q_hi, s_lo, s_hi."""
    return hits.withColumns(
        {
            "q_lo": F.least("qstart", "qend"),
            "q_hi": F.greatest("qstart", "qend"),
            "s_lo": F.least("sstart", "send"),
            "s_hi": F.greatest("sstart", "send"),
        }
    )


def coverage_pct(hits: DataFrame) -> DataFrame:
    """Share of the query and of the subject that the alignment spans, in percent."""
    q = (F.col("qend") - F.col("qstart") + 1) / F.col("qlen") * 100
    s = (F.abs(F.col("send") - F.col("sstart")) + 1) / F.col("slen") * 100
    return hits.withColumns({"q_coverage": q, "s_coverage": s})


def identical_bp() -> Column:
    return F.col("pident") / 100 * F.col("length")


def quality() -> Column:
    return F.col("pident") * F.col("length")


def log_evalue(evalue: str = "evalue") -> Column:
    """log10 with zero replaced by 1e-300."""
    e = F.col(evalue)
    return F.log10(F.when(e == 0, F.lit(1e-300)).otherwise(e))


def pack_hit_name(
    category: Column, number: Column, transcript: Column, subject: Column, pident: Column,
    length: Column,
) -> Column:
    """category_n|transcript|subject|pident|length"""
    return F.concat_ws(
        "|",
        F.concat_ws("_", category, number.cast("string")),
        transcript,
        subject,
        pident.cast("string"),
        length.cast("string"),
    )


def unpack_hit_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Columns category, transcript, subject, pident, length out of a packed name.

    Names with fewer than three parts give a null transcript; missing numbers become 0.
    """
    parts = F.split(F.col(name), "[|]")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    return df.withColumns(
        {
            "category": F.split_part(part(0), F.lit("_"), F.lit(1)),
            "transcript": F.when(F.size(parts) >= 3, part(1)),
            "subject": F.when(F.size(parts) >= 3, part(2)),
            "pident": F.coalesce(part(3).try_cast("double"), F.lit(0.0)),
            "length": F.coalesce(part(4).try_cast("int"), F.lit(0)),
        }
    )


def locus_id(transcript: str, chrom: str, start: str, end: str) -> Column:
    """transcript|chrom|start-end"""
    span = F.concat_ws("-", F.col(start).cast("string"), F.col(end).cast("string"))
    return F.concat_ws("|", F.col(transcript), F.col(chrom), span)
