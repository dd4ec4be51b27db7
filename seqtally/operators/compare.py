"""Set operations and two-source comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import seq_hash
from ..scale import skew_join, stage, with_row_number


def set_partition(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values with where they occur: a_only, b_only or both. One shuffle."""
    tagged = a.select(column, F.lit(1).alias("_s")).unionByName(b.select(column, F.lit(2).alias("_s")))
    where = F.bit_or("_s")
    side = F.when(where == 3, "both").when(where == 1, "a_only").otherwise("b_only")
    return tagged.groupBy(column).agg(side.alias("side"))


def not_hit(subjects: DataFrame, hits: DataFrame) -> DataFrame:
    """Subjects without a single hit."""
    seen = hits.select(F.col("sseqid").alias("te_id")).distinct()
    return subjects.join(seen, "te_id", "left_anti")


def list_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genes in two ranked top/bottom tables (fbgn, rank, side), with both ranks."""
    pair = F.concat_ws("_", "a_side", "b_side")
    return (
        a.select("fbgn", F.col("rank").alias("a_rank"), F.col("side").alias("a_side"))
        .join(b.select("fbgn", F.col("rank").alias("b_rank"), F.col("side").alias("b_side")), "fbgn")
        .withColumn("pair", pair)
    )


def merge_sequences(tables: Sequence[DataFrame], key: str = "seq_id") -> DataFrame:
    """Union of sequence tables; for a repeated id the earliest table's row is kept.

    A table that repeats an id itself keeps its smallest row.
    """
    tagged = [t.withColumn("_source", F.lit(i)) for i, t in enumerate(tables)]
    rest = [c for c in tables[0].columns if c != key]
    everything = reduce(DataFrame.unionByName, tagged)
    return (
        everything.groupBy(key)
        .agg(F.min(F.struct("_source", *rest)).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def gene_universe(*sources: DataFrame, column: str = "fbgn") -> DataFrame:
    return reduce(DataFrame.union, [s.select(column) for s in sources]).distinct()


def missing_keys(wanted: DataFrame, have: DataFrame, column: str) -> DataFrame:
    return wanted.join(have.select(column), column, "left_anti")


def compare_sources(a: DataFrame, b: DataFrame, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Full outer join by key; a_* and b_* measures with 0 where a side is missing."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*on, *[F.col(m).alias(f"{name}_{m}") for m in measures])

    both = side(a, "a").join(side(b, "b"), list(on), "full")
    return both.fillna(0, subset=[f"{s}_{m}" for s in "ab" for m in measures])


def filter_by_group(seqs: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Sequences (with fbgn) of the genes in one group, by group symbol or name, any case."""
    wanted = groups.where(F.lower("group_name") == name.lower()).select("fbgn").distinct()
    return seqs.join(wanted, "fbgn", "left_semi")


def list_groups(
    groups: DataFrame, search: str | None = None, min_genes: int = 1, sort_by: str | None = None
) -> DataFrame:
    """Group catalogue: genes per group, with an optional name search (any case).

    sort_by "name" or "size" adds `rank`, the place in that order (names in any case, sizes
    from the largest, ties by name), and `mean_genes` over the groups listed.
    """
    out = groups.groupBy("group_name").agg(F.count_distinct("fbgn").alias("genes"))
    if search:
        out = out.where(F.lower("group_name").contains(search.lower()))
    out = out.where(F.col("genes") >= min_genes)
    if sort_by is None:
        return out
    orders = {"name": [F.asc(F.lower("group_name"))], "size": [F.desc("genes"), F.asc(F.lower("group_name"))]}
    out = stage(out, "groups")
    mean = out.agg(F.avg("genes")).scalar()
    return with_row_number(out, *orders[sort_by], F.asc("group_name"), name="rank").withColumn("mean_genes", mean)


def dedupe_sequences(seqs: DataFrame, order: str, key: str = "seq_id") -> DataFrame:
    """One row per distinct sequence: its first id and how many ids share it."""
    return seqs.groupBy(seq_hash(F.col("seq")).alias("hash")).agg(
        F.min_by(key, order).alias("first_id"), F.count(F.lit(1)).alias("isoforms")
    )


def isoform_map(seqs: DataFrame, order: str, key: str = "seq_id") -> DataFrame:
    """Every id with the first id of its sequence, in long form: a sequence shared by very
    many ids stays many rows instead of one huge list."""
    hashed = seqs.select(key, seq_hash(F.col("seq")).alias("hash"))
    first = dedupe_sequences(seqs, order, key).select("hash", "first_id", "isoforms")
    return skew_join(hashed, first, ["hash"])


def seq_stats(seqs: DataFrame) -> DataFrame:
    n = F.length("seq")
    return seqs.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_bp"),
        F.avg(n).alias("mean_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
    )
