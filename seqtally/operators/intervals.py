"""Interval joins, merges and coverage that stay balanced on crowded keys.

Two ideas carry this module. Range joins become equi joins on position bins, with each
pair kept in exactly one bin. Merges run on distinct start positions inside fixed-width
chunks, so no window ever holds more than `chunk` rows of a key; a small per-chunk table
carries open intervals from one chunk to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import UNB, skew_join

CHUNK = 4096


@dataclass(frozen=True)
class Measure:
    """A mergeable aggregate: `first` on raw rows, `then` on partial results."""

    name: str
    first: Column
    then: Callable[[str], Column]


def count_rows(name: str) -> Measure:
    return Measure(name, F.count(F.lit(1)), F.sum)


def sum_of(name: str, value: Column) -> Measure:
    return Measure(name, F.sum(value), F.sum)


def max_of(name: str, value: Column) -> Measure:
    return Measure(name, F.max(value), F.max)


def min_of(name: str, value: Column) -> Measure:
    return Measure(name, F.min(value), F.min)


def set_of(name: str, value: Column) -> Measure:
    """Sorted distinct values, kept whole because the list is the result."""
    return Measure(
        name,
        F.collect_set(value),
        lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))),
    )


def best_of(name: str, ranking: Sequence[Column], payload: dict[str, Column]) -> Measure:
    """The payload of the row with the greatest `ranking`, as a struct column."""
    fields = [c.alias(f"_k{i}") for i, c in enumerate(ranking)]
    fields += [c.alias(k) for k, c in payload.items()]
    return Measure(name, F.max(F.struct(*fields)), F.max)


def collapse(
    df: DataFrame,
    by: Sequence[str],
    start: str = "start",
    end: str = "end",
    gap: int = 0,
    measures: Sequence[Measure] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Join intervals of a key while start <= running end + gap; one row per island.

    Output: by, start, end and one column per measure.
    """
    by = list(by)
    s, e = F.col("_s"), F.col("_e")
    # 1. partial aggregates per distinct start (combined before the shuffle)
    starts = (
        df.withColumns({"_s": F.col(start).cast("long"), "_e": F.col(end).cast("long")})
        .withColumn("_chunk", F.floor(s / chunk).cast("long"))
        .groupBy(*by, "_chunk", "_s")
        .agg(F.max(e).alias("_e"), *[m.first.alias(m.name) for m in measures])
    )
    # 2. islands inside each chunk: at most `chunk` rows per window
    inside = Window.partitionBy(*by, "_chunk").orderBy("_s")
    reach = F.max("_e").over(inside.rowsBetween(UNB, -1))
    local = (
        starts.withColumn("_reach", reach)
        .withColumn("_open", F.when(F.col("_reach").isNull() | (s > F.col("_reach") + gap), s))
        .withColumn("_ls", F.max("_open").over(inside.rowsBetween(UNB, 0)))
        .groupBy(*by, "_chunk", "_ls")
        .agg(F.max("_e").alias("_e"), *[m.then(m.name).alias(m.name) for m in measures])
    )
    # 3. what earlier chunks leave open: their furthest end and their last true island start
    along = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(UNB, -1)
    carry = (
        local.groupBy(*by, "_chunk")
        .agg(F.max("_e").alias("_end"), F.max("_ls").alias("_last"))
        .withColumn("_carry_end", F.max("_end").over(along))
        .withColumn(
            "_true",
            F.when(
                F.col("_carry_end").isNull() | (F.col("_last") > F.col("_carry_end") + gap),
                F.col("_last"),
            ),
        )
        .withColumn("_carry_start", F.max("_true").over(along))
        .select(*by, "_chunk", "_carry_end", "_carry_start")
    )
    # 4. attach local islands to the open one and finish
    own = F.col("_carry_end").isNull() | (F.col("_ls") > F.col("_carry_end") + gap)
    return (
        local.join(carry, [*by, "_chunk"])
        .withColumn("_island", F.when(own, F.col("_ls")).otherwise(F.col("_carry_start")))
        .groupBy(*by, "_island")
        .agg(F.max("_e").alias("_e"), *[m.then(m.name).alias(m.name) for m in measures])
        .select(*by, F.col("_island").alias(start), F.col("_e").alias(end), *[m.name for m in measures])
    )


def merge_intervals(
    df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", gap: int = 0
) -> DataFrame:
    """Disjoint cover of the intervals of each key; touching intervals are joined."""
    return collapse(df, by, start, end, gap)


def _bins(df: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    first, last = F.floor(lo / width), F.floor(hi / width)
    return df.withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    closed: bool = True,
    min_overlap: int | None = None,
    bin_width: int = 2048,
) -> DataFrame:
    """All overlapping pairs of rows that agree on `by`, each pair once.

    closed: s1 <= e2 and e1 >= s2 (1-based closed spans). Otherwise max(s) < min(e)
    (half-open spans). `min_overlap` counts shared bases. Column names of the two sides
    must differ except for `by`. A bin width near the longer side's usual length is best:
    every interval is repeated once per bin it touches.
    """
    by = list(by)
    (s1, e1), (s2, e2) = a_span, b_span
    lo, hi = F.greatest(s1, s2), F.least(e1, e2)
    shared = hi - lo + (1 if closed else 0)
    left = _bins(a, F.col(s1), F.col(e1), bin_width)
    right = _bins(b, F.col(s2), F.col(e2), bin_width)
    pairs = skew_join(left, right, [*by, "_bin"])
    keep = (lo <= hi) if closed else (lo < hi)
    if min_overlap is not None:
        keep = keep & (shared >= min_overlap)
    once = F.col("_bin") == F.greatest(F.floor(F.col(s1) / bin_width), F.floor(F.col(s2) / bin_width))
    return pairs.where(keep & once).drop("_bin")


def listed_overlaps(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    values: Sequence[str],
    deal: Sequence[str],
    shared: str,
    bin_width: int = 256,
    list_size: int = 512,
) -> DataFrame:
    """The pairs of `overlap_join` under the strict rule, where a row of `a` has very many: the
    columns of `a`, `values` and what the two share, named `shared`.

    `b` (columns `by`, `b_span`, `values`) becomes lists of some `list_size` different rows of a bin,
    each with its number of copies. Rows of `a`, dealt by the columns `deal`, meet lists and not
    rows: the pairs are made one after the other in the last stage, without a join of their own.
    """
    by = list(by)
    (s1, e1), (s2, e2) = a_span, b_span
    # equal rows once; very many of them in several shares
    same = b.groupBy(*by, *b_span, *values).agg(F.count(F.lit(1)).alias("_n"))
    same = same.withColumn("_share", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {list_size}"))))
    copies = F.least(F.col("_n") - F.col("_share") * list_size, F.lit(list_size)).cast("int")
    first = lambda start: F.floor(F.col(start) / bin_width).alias("_first")
    row = F.struct(*b_span, first(s2), *values, F.array_repeat(F.lit(0).cast("byte"), copies).alias("copies"))
    binned = _bins(same, F.col(s2), F.col(e2), bin_width)
    lists = binned.groupBy(*by, "_bin").agg(F.ceil(F.count(F.lit(1)) / list_size).cast("int").alias("_lists"))
    part = F.pmod(F.xxhash64(*b_span, *values, "_share"), F.col("_lists"))
    lists = binned.join(lists, [*by, "_bin"]).groupBy(*by, "_bin", part.alias("_list")).agg(F.collect_list(row).alias("_rows"))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _bins(a.select("*", first(s1)), F.col(s1), F.col(e1), bin_width).repartition(parts, *deal)
    met = dealt.join(lists.drop("_list"), [*by, "_bin"]).select(*a.columns, "_bin", "_first", F.explode("_rows").alias("_row"))
    lo, hi = F.greatest(F.col(s1), F.col(f"_row.{s2}")), F.least(F.col(e1), F.col(f"_row.{e2}"))
    met = met.where((lo < hi) & (F.col("_bin") == F.greatest("_first", "_row._first")))
    # all of a pair is worked out before it is repeated
    met = met.select(*a.columns, *[F.col(f"_row.{c}").alias(c) for c in values], (hi - lo).alias(shared), F.col("_row.copies").alias("_copies"))
    return met.select("*", F.explode("_copies").alias("_copy")).drop("_copies", "_copy")


def overlap_columns(
    pairs: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], closed: bool = True
) -> DataFrame:
    """Add overlap_start, overlap_end, overlap_len and the 1-based position inside b."""
    lo = F.greatest(a_span[0], b_span[0])
    hi = F.least(a_span[1], b_span[1])
    extra = 1 if closed else 0
    return pairs.withColumns(
        {
            "overlap_start": lo,
            "overlap_end": hi,
            "overlap_len": hi - lo + extra,
            "target_pos": lo - F.col(b_span[0]) + 1,
            "target_len": F.col(b_span[1]) - F.col(b_span[0]) + extra,
        }
    )


def overlapping(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    key: Sequence[str],
    closed: bool = False,
    bin_width: int = 2048,
) -> DataFrame:
    """Distinct `key` of the rows of `a` that overlap any `b`.

    `b` is first reduced to its disjoint cover, so pile-ups in `b` cost nothing. Under the
    strict rule touching spans stay apart in the cover and empty spans are dropped.
    """
    slim = b.select(*by, *b_span)
    if closed:
        cover = merge_intervals(slim, by, *b_span)
    else:
        cover = merge_intervals(slim.where(F.col(b_span[0]) < F.col(b_span[1])), by, *b_span, gap=-1)
    pairs = overlap_join(a.select(*by, *a_span, *key), cover, by, a_span, b_span, closed, bin_width=bin_width)
    return pairs.select(*key).distinct()


def overlaps_any(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    key: Sequence[str],
    keep: bool = True,
    closed: bool = False,
    bin_width: int = 2048,
) -> DataFrame:
    """Rows of `a` (unique by `key`) that do, or with keep=False do not, overlap any `b`."""
    found = overlapping(a, b, by, a_span, b_span, key, closed, bin_width)
    return a.join(found, list(key), "left_semi" if keep else "left_anti")


def overlap_owners(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    key: Sequence[str],
    owner: str,
    closed: bool = False,
    bin_width: int = 2048,
) -> DataFrame:
    """Every row of `a` with has_overlap and the sorted list of owners it overlaps."""
    owners = (
        overlap_join(
            a.select(*by, *a_span, *key),
            b.select(*by, *b_span, owner),
            by,
            a_span,
            b_span,
            closed,
            bin_width=bin_width,
        )
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set(owner)).alias("owners"))
    )
    none = F.array().cast("array<string>")
    return (
        a.join(owners, list(key), "left")
        .withColumn("has_overlap", F.col("owners").isNotNull())
        .withColumn("owners", F.coalesce("owners", none))
    )


def coverage_fraction(
    queries: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    q_span: tuple[str, str],
    i_span: tuple[str, str],
    key: Sequence[str],
    tracks: Sequence[str],
    track: str = "species",
    bin_width: int = 2048,
) -> DataFrame:
    """Share of each query's bases covered per track, one column per name in `tracks`.

    Spans are half-open. Queries without any cover, and empty queries, get 0.
    """
    cover = merge_intervals(intervals.where(F.col(track).isin(*tracks)), [*by, track], *i_span)
    slim = queries.select(*by, *q_span, *key)
    pairs = overlap_join(slim, cover, by, q_span, i_span, closed=False, bin_width=bin_width)
    bases = F.least(q_span[1], i_span[1]) - F.greatest(q_span[0], i_span[0])
    sums = (
        pairs.withColumn("_bp", bases)
        .groupBy(*key)
        .agg(*[F.sum(F.when(F.col(track) == t, F.col("_bp"))).alias(f"_bp_{t}") for t in tracks])
    )
    size = F.col(q_span[1]) - F.col(q_span[0])
    out = queries.join(sums, list(key), "left")
    for t in tracks:
        share = F.coalesce(F.col(f"_bp_{t}"), F.lit(0)) / size
        out = out.withColumn(f"cov_{t}", F.when(size > 0, share).otherwise(0.0)).drop(f"_bp_{t}")
    return out


def interval_mean(
    queries: DataFrame,
    segments: DataFrame,
    by: Sequence[str],
    q_span: tuple[str, str],
    seg_span: tuple[str, str],
    key: Sequence[str],
    score: str = "score",
    bin_width: int = 2048,
) -> DataFrame:
    """Score over each half-open query: covered bases, sum, mean with gaps as 0, mean.

    `segments` carry one score per base of a half-open span and must not overlap.
    """
    slim = queries.select(*by, *q_span, *key)
    bases = F.least(q_span[1], seg_span[1]) - F.greatest(q_span[0], seg_span[0])
    sums = (
        overlap_join(slim, segments, by, q_span, seg_span, closed=False, bin_width=bin_width)
        .withColumn("_bp", bases)
        .groupBy(*key)
        .agg(F.sum("_bp").alias("covered"), F.sum(F.col(score) * F.col("_bp")).alias("score_sum"))
    )
    size = F.col(q_span[1]) - F.col(q_span[0])
    return (
        queries.join(sums, list(key), "left")
        .withColumns(
            {
                "size": size,
                "covered": F.coalesce("covered", F.lit(0)),
                "score_sum": F.coalesce("score_sum", F.lit(0.0)),
            }
        )
        .withColumns(
            {
                "mean0": F.when(size > 0, F.col("score_sum") / size).otherwise(0.0),
                "mean": F.when(F.col("covered") > 0, F.col("score_sum") / F.col("covered")).otherwise(0.0),
            }
        )
    )


def to_genomic(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Query-relative hits to 0-based half-open genome spans, strand-aware.

    transcripts: fbtr, chrom, g_start, g_end (1-based closed), t_strand. Chromosome names
    get a chr prefix when they lack one.
    """
    up = F.col("t_strand") == "+"
    start = F.when(up, F.col("g_start") + F.col("qstart") - 1).otherwise(
        F.col("g_end") - F.col("qend") + 1
    )
    end = F.when(up, F.col("g_start") + F.col("qend") - 1).otherwise(
        F.col("g_end") - F.col("qstart") + 1
    )
    named = F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(
        F.concat(F.lit("chr"), F.col("chrom"))
    )
    dim = transcripts.select(F.col("fbtr").alias("qseqid"), "chrom", "g_start", "g_end", "t_strand")
    return (
        skew_join(hits, dim, ["qseqid"])
        .withColumns({"chrom": named, "bed_start": start - 1, "bed_end": end})
        .drop("g_start", "g_end")
    )


def first_segment(features: DataFrame, owner: str = "parent", order: str = "row_id") -> DataFrame:
    """The lowest-ordered feature of each owner."""
    cols = [c for c in features.columns if c not in (owner, order)]
    return (
        features.groupBy(owner)
        .agg(F.min(F.struct(order, *cols)).alias("_f"))
        .select(owner, *[F.col(f"_f.{c}").alias(c) for c in cols])
    )


def species_summary(df: DataFrame) -> DataFrame:
    """Roll cov_<assembly> columns up to species, with any, both_close and a count >= 0.5."""
    # Assembly -> species column.
    sim, sec, ere = F.col("cov_droSim1"), F.col("cov_droSec1"), F.col("cov_droEre2")
    yak = F.greatest("cov_droYak2", "cov_droYak3")
    out = df.withColumns(
        {"sim_coverage": sim, "yak_coverage": yak, "ere_coverage": ere, "sec_coverage": sec}
    )
    four = ["sim_coverage", "yak_coverage", "ere_coverage", "sec_coverage"]
    return out.withColumns(
        {
            "any_coverage": F.greatest(*four),
            "both_close_coverage": F.least("sim_coverage", "sec_coverage"),
            "syntenic_species": syntenic_count(four),
        }
    ).drop(*[c for c in out.columns if c.startswith("cov_")])


def syntenic_count(columns: Sequence[str], threshold: float = 0.5) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + (F.col(c) >= threshold).cast("int")
    return total
