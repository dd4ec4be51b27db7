"""Hit tables: filters, selections, summaries, top lists and dimension joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import is_plus
from ..scale import quantiles, skew_join, upper_median


def filter_hits(
    hits: DataFrame,
    min_length: int | None = None,
    min_pident: float | None = None,
    max_evalue: float | None = None,
) -> DataFrame:
    if min_length is not None:
        hits = hits.where(F.col("length") >= min_length)
    if min_pident is not None:
        hits = hits.where(F.col("pident") >= min_pident)
    if max_evalue is not None:
        hits = hits.where(F.col("evalue") <= max_evalue)
    return hits


def high_quality(hits: DataFrame, min_pident: float = 80, min_length: int = 50) -> DataFrame:
    return filter_hits(hits, min_length=min_length, min_pident=min_pident)


def select_hits(
    hits: DataFrame,
    subjects: DataFrame | None = None,
    gene: str | None = None,
    family: str | None = None,
    strand: str | None = None,
) -> DataFrame:
    """Hits whose query starts with `gene`, whose subject name contains `family`
    (any case), on one strand."""
    if gene:
        hits = hits.where(F.col("qseqid").startswith(gene))
    if strand:
        hits = hits.where(is_plus() if strand == "plus" else ~is_plus())
    if family:
        wanted = subjects.where(F.lower("name").contains(family.lower()))
        hits = skew_join(hits, wanted.select(F.col("te_id").alias("sseqid")), ["sseqid"], "left_semi")
    return hits


def with_subject(hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """Add family and te_class; an unknown subject keeps its id and class Unknown."""
    dim = subjects.select(
        F.col("te_id").alias("sseqid"),
        F.col("family").alias("_family"),
        F.col("te_class").alias("_class"),
    )
    return (
        skew_join(hits, dim, ["sseqid"], "left")
        .withColumns(
            {
                "family": F.coalesce("_family", "sseqid"),
                "te_class": F.coalesce("_class", F.lit("Unknown")),
            }
        )
        .drop("_family", "_class")
    )


def with_gene(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Add fbgn and tx_len; hits on transcripts outside the table are dropped."""
    dim = transcripts.select(F.col("fbtr").alias("qseqid"), "fbgn", "tx_len")
    return skew_join(hits, dim, ["qseqid"])


def strand_counts() -> tuple[Column, Column]:
    plus = F.count_if(is_plus()).alias("plus")
    minus = F.count_if(~is_plus()).alias("minus")
    return plus, minus


def summarize_hits(hits: DataFrame) -> DataFrame:
    """One row of counts and means; zeros when there are no hits."""
    zero = F.lit(0.0)
    return hits.agg(
        F.count(F.lit(1)).alias("total_hits"),
        F.count_distinct("qseqid").alias("unique_queries"),
        F.count_distinct("sseqid").alias("unique_subjects"),
        F.coalesce(F.avg("pident"), zero).alias("mean_pident"),
        F.coalesce(F.avg("length"), zero).alias("mean_length"),
        F.coalesce(F.avg("evalue"), zero).alias("mean_evalue"),
        F.count_if(is_plus()).alias("strand_plus"),
        F.count_if(~is_plus()).alias("strand_minus"),
    )


def describe_hits(hits: DataFrame) -> DataFrame:
    """min, max, mean and median per measure, one row per measure (long form)."""
    measures = {
        "evalue": F.col("evalue"),
        "pident": F.col("pident"),
        "length": F.col("length").cast("double"),
        "bitscore": F.col("bitscore"),
        "query_coverage": (F.col("qend") - F.col("qstart") + 1) / F.col("qlen") * 100,
        "subject_coverage": (F.abs(F.col("send") - F.col("sstart")) + 1) / F.col("slen") * 100,
    }
    long = hits.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("measure"), c.alias("v")) for k, c in measures.items()])
        ).alias("m")
    ).select("m.measure", "m.v")
    basic = long.groupBy("measure").agg(
        F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean")
    )
    return basic.join(quantiles(long, ["measure"], "v", {"v_median": 0.5}), "measure", "left")


def replicate_statistics(hits: DataFrame, replicates: int, name: str = "replicate") -> DataFrame:
    """`hit_statistics` of the replicates 1..n; one without any hit counts as zeros."""
    every = hits.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias(name))
    found = hit_statistics(hits.withColumn(name, F.col(name).cast("int")), [name])
    return every.join(found, name, "left").fillna(0)


def hit_statistics(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, means, upper medians and quality counts per group (e.g. per replicate)."""
    by = list(by)
    counts = hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_hits"),
        F.count_distinct("qseqid").alias("unique_queries"),
        F.avg("pident").alias("mean_pident"),
        F.avg("length").alias("mean_length"),
        F.count_if(F.col("pident") >= 80).alias("hits_80plus"),
        F.count_if(F.col("length") >= 100).alias("hits_100bp_plus"),
        F.count_if((F.col("pident") >= 80) & (F.col("length") >= 50)).alias("hits_hq"),
    )
    pid = upper_median(hits, by, "pident", "median_pident")
    length = upper_median(hits, by, "length", "median_length")
    if by:
        return counts.join(pid, by, "left").join(length, by, "left")
    return counts.withColumns({"median_pident": pid.scalar(), "median_length": length.scalar()})


def kind_statistics(kinds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and means as in `hit_statistics`, of hits that come as length, matches and their number n."""
    n, pident = F.col("n"), 100 * F.col("matches") / F.col("length")
    good = (pident >= 80) & (F.col("length") >= 50)
    return kinds.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_hits"),
        (F.sum(n * pident) / F.sum(n)).alias("mean_pident"),
        (F.sum(n * F.col("length")) / F.sum(n)).alias("mean_length"),
        F.coalesce(F.sum(F.when(good, n)), F.lit(0)).alias("hits_hq"),
    )


def top_hits(
    hits: DataFrame, n: int = 50, by: str = "bitscore", ties: Sequence[str] = ()
) -> DataFrame:
    """The n best hits: lowest evalue, or highest of any other measure."""
    key = F.asc(by) if by == "evalue" else F.desc(by)
    return hits.orderBy(key, *ties).limit(n)


def top_counts(hits: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        hits.groupBy(column)
        .agg(F.count(F.lit(1)).alias("hits"))
        .orderBy(F.desc("hits"), column)
        .limit(n)
    )


def number_rows(limited: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rank the rows of a frame that already went through a top-n limit."""
    return limited.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def identity_tiers(hits: DataFrame, tiers: Sequence[float], id_col: str = "qseqid") -> DataFrame:
    """Hits and distinct ids at or above each identity, every tier in one pass."""
    held = F.filter(F.array(*[F.lit(float(t)) for t in tiers]), lambda t: F.col("pident") >= t)
    return (
        hits.select(id_col, F.explode(held).alias("min_pident"))
        .groupBy("min_pident")
        .agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(id_col).alias("ids"))
    )


def length_tiers(hits: DataFrame, tiers: Sequence[int], id_col: str = "sseqid") -> DataFrame:
    """Hits and distinct ids at or above each length, every tier in one pass."""
    held = F.filter(F.array(*[F.lit(int(t)) for t in tiers]), lambda t: F.col("length") >= t)
    return (
        hits.select(id_col, F.explode(held).alias("min_length"))
        .groupBy("min_length")
        .agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(id_col).alias("ids"))
    )
