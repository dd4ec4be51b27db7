"""Per-base signal of hits along each query: density, smoothing, peaks and clusters.

Weights reach 1e180, so prefix sums and difference arrays would lose small terms; sums are
always over the hits that cover a position. Smoothing works on fixed-size tiles with a
halo, so the unit of work is bounded whatever the length or popularity of a query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import is_plus
from ..functions.names import subject_token
from ..scale import stage
from . import intervals as iv
from .tile_tree import groups, span_sums, spaced, whole_tiles

METRICS = (
    "hit_count",
    "evalue_weighted",
    "bitscore_weighted",
    "combined",
    "combined_plus",
    "combined_minus",
)
EVALUE_FLOOR = 1e-180
#: positions that a task smooths at once
SMOOTHED = 1 << 17


def inverse_evalue():
    return 1 / F.greatest("evalue", F.lit(EVALUE_FLOOR))


def weighted_spans(hits: DataFrame) -> DataFrame:
    """Distinct clipped 0-based spans [lo, hi) per query with summed weights.

    Summing equal spans first bounds what later steps see of a query by its length.
    """
    lo = F.greatest(F.col("qstart") - 1, F.lit(0)).cast("int")
    hi = F.least("qend", "qlen").cast("int")
    size = F.col("hi") - F.col("lo")
    combined = F.col("pident") / 100 * inverse_evalue() / size
    return (
        hits.withColumns({"lo": lo, "hi": hi})
        .where(F.col("lo") < F.col("hi"))
        .groupBy("qseqid", "qlen", "lo", "hi")
        .agg(
            F.count("*").cast("double").alias("hit_count"),
            F.sum(inverse_evalue()).alias("evalue_weighted"),
            F.sum(F.col("bitscore") / size).alias("bitscore_weighted"),
            F.sum(combined).alias("combined"),
            F.sum(F.when(is_plus(), combined).otherwise(0.0)).alias("combined_plus"),
            F.sum(F.when(is_plus(), 0.0).otherwise(combined)).alias("combined_minus"),
        )
    )


def density_runs(hits: DataFrame, metrics: Sequence[str] = METRICS, tile: int = 4096) -> DataFrame:
    """Density in run-length form: (qseqid, qlen, lo, hi, metrics...) with 0-based [lo, hi).

    The signal only changes where a span starts or ends: a few stretches per span instead of
    one row per base. Equal spans are summed first, then every tile of positions is one
    range-add tree, so a crowded or very long query is split over tasks and a tile takes the
    memory of its positions however many hits it has.
    """
    metrics = list(metrics)
    spans = weighted_spans(hits).select("qseqid", "qlen", "lo", "hi", *metrics)
    return span_sums(spans, "qseqid", metrics, tile, "qlen")


def density(hits: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(qseqid, qlen, pos, metrics...) for every covered 0-based position."""
    return density_runs(hits, metrics).select(
        "qseqid", "qlen", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"), *metrics
    )


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def _smoothed_tiles(runs: DataFrame, kernel: np.ndarray, metrics: Sequence[str], tile: int, fold, schema: str) -> DataFrame:
    """`fold` of every few smoothed tiles: their rows' batch, first rows, borders and values.

    Each tile is smoothed on its own with a halo of one kernel radius and reflecting edges;
    the tiles of a batch lie in one line, some SMOOTHED positions at a time.
    """
    radius = len(kernel) // 2
    halo = radius + 1
    if tile <= halo:
        raise ValueError("tile must exceed the kernel radius")
    last = F.floor((F.col("qlen") - 1) / tile)
    from_tile = F.greatest(F.floor((F.col("lo") - halo) / tile), F.lit(0))
    to_tile = F.least(F.floor((F.col("hi") - 1 + halo) / tile), last)
    dealt = (
        runs.withColumn("tile", F.explode(F.sequence(from_tile, to_tile).cast("array<int>")))
        .repartition("qseqid", "tile")
        .sortWithinPartitions("qseqid", "tile", "lo")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_tiles(batches, ["qseqid", "tile"]):
            first = groups(batch, ["qseqid", "tile"])
            qlen = batch.column("qlen").to_numpy()[first].astype(np.int64)
            start = batch.column("tile").to_numpy()[first].astype(np.int64) * tile
            wide = np.minimum(qlen, start + tile) - start + 2 * (halo + radius)
            part = np.cumsum(wide) // SMOOTHED
            for i in np.flatnonzero(np.r_[True, part[1:] != part[:-1]]):
                j = np.searchsorted(part, part[i], "right")
                to = first[j] if j < len(first) else batch.num_rows
                rows = batch.slice(first[i], to - first[i])
                yield from fold(rows, first[i:j] - first[i], qlen[i:j], start[i:j], *smoothed(rows, first[i:j] - first[i], qlen[i:j], start[i:j]))

    def smoothed(rows: pa.RecordBatch, first: np.ndarray, qlen: np.ndarray, start: np.ndarray):
        """Raw and smoothed values in one line and the line's place of each tile's first position."""
        a, b = np.maximum(0, start - halo), np.minimum(qlen, start + tile + halo)
        n, group = b - a, np.repeat(np.arange(len(first)), np.diff(np.r_[first, rows.num_rows]))
        base = np.cumsum(n) - n
        lo, hi = (np.clip(rows.column(c).to_numpy(), a[group], b[group]) - a[group] for c in ("lo", "hi"))
        values = np.stack([rows.column(m).to_numpy() for m in metrics])
        raw = np.zeros((len(metrics), int(n.sum())))
        size = hi - lo  # runs are disjoint
        at = np.repeat(base[group] + lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        raw[:, at] = np.repeat(values, size, axis=1)
        left, right = np.where(a == 0, radius, 0), np.where(b == qlen, radius, 0)
        wide = left + n + right
        begin = np.cumsum(wide) - wide
        x = (np.arange(int(wide.sum())) - np.repeat(begin + left, wide)) % np.repeat(2 * n, wide)
        x = np.where(x < np.repeat(n, wide), x, np.repeat(2 * n, wide) - 1 - x)
        line = raw[:, np.repeat(base, wide) + x]
        return line, np.stack([np.convolve(row, kernel, mode="same") for row in line]), begin + left + start - a

    return dealt.mapInArrow(run, schema)


def _core(qlen: np.ndarray, start: np.ndarray, begin: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile, position and place in the line of every position that the tiles answer for."""
    n = np.minimum(qlen, start + tile) - start
    group = np.repeat(np.arange(len(n)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return group, start[group] + inside, begin[group] + inside


def smooth(
    hits: DataFrame, sigma: float = 25, metrics: Sequence[str] = METRICS, tile: int = 4096
) -> DataFrame:
    """(qseqid, qlen, pos, <metric>_raw, <metric>) per position; edges reflect.

    Each tile is smoothed on its own with a halo of one kernel radius. With `combined`
    among the metrics its smoothed neighbours come along as prev_combined and
    next_combined (null outside the query). Tiles that no hit reaches are all zero and
    left out.
    """
    metrics = tuple(metrics)
    beside = "combined" in metrics
    names = [f"{m}_raw" for m in metrics] + list(metrics)
    names += ["prev_combined", "next_combined"] if beside else []

    def fold(rows, first, qlen, start, raw, done, begin):
        group, pos, at = _core(qlen, start, begin, tile)
        columns = [rows.column("qseqid").take(pa.array(first[group])), pa.array(qlen[group].astype(np.int32)), pa.array(pos.astype(np.int32))]
        columns += [pa.array(row[at]) for row in (*raw, *done)]
        if beside:
            line = np.r_[done[metrics.index("combined")], 0.0]
            columns.append(pa.array(line[at - 1], mask=pos == 0))
            columns.append(pa.array(line[at + 1], mask=pos == qlen[group] - 1))
        yield from pa.Table.from_arrays(columns, ["qseqid", "qlen", "pos", *names]).to_batches(max_chunksize=16384)

    schema = "qseqid string, qlen int, pos int, " + ", ".join(f"{n} double" for n in names)
    return _smoothed_tiles(density_runs(hits, metrics), gaussian_kernel(sigma), metrics, tile, fold, schema)


def smoothed_totals(hits: DataFrame, sigma: float = 25, metrics: Sequence[str] = METRICS, tile: int = 4096) -> DataFrame:
    """Per query: positions and the sums of <metric>_raw and <metric> over all that `smooth` gives."""
    metrics = tuple(metrics)
    names = [f"{m}_raw" for m in metrics] + list(metrics)

    def fold(rows, first, qlen, start, raw, done, begin):
        group, _, at = _core(qlen, start, begin, tile)
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        columns = [rows.column("qseqid").take(pa.array(first)), pa.array(np.bincount(group))]
        columns += [pa.array(np.add.reduceat(row[at], new)) for row in (*raw, *done)]
        yield pa.RecordBatch.from_arrays(columns, ["qseqid", "positions", *names])

    schema = "qseqid string, positions long, " + ", ".join(f"{n} double" for n in names)
    sums = _smoothed_tiles(density_runs(hits, metrics), gaussian_kernel(sigma), metrics, tile, fold, schema)
    return sums.groupBy("qseqid").agg(*[F.sum(c).alias(c) for c in ("positions", *names)])


def smoothed_stretches(hits: DataFrame, threshold: float = 0.1, sigma: float = 25, tile: int = 4096) -> DataFrame:
    """Smoothed positions as stretches all above the threshold share of their query's maximum, or
    all not above it: qseqid, lo, hi, combined and hit_count (maxima), total (of combined).

    A cluster is made of whole stretches, so `find_clusters` and `annotate_clusters` find in
    them what they find in positions. The maxima of the queries are found first, then all is
    smoothed again: a few rows per tile leave the tasks, not its positions.
    """
    kernel = gaussian_kernel(sigma)
    runs = stage(density_runs(hits, ["combined", "hit_count"]), "density")

    def tops(rows, first, qlen, start, raw, done, begin):
        group, _, at = _core(qlen, start, begin, tile)
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        columns = [rows.column("qseqid").take(pa.array(first)), pa.array(np.maximum.reduceat(done[0][at], new))]
        yield pa.RecordBatch.from_arrays(columns, ["qseqid", "_top"])

    def stretches(rows, first, qlen, start, raw, done, begin):
        group, pos, at = _core(qlen, start, begin, tile)
        value, hit_count = done[0][at], done[1][at]
        above = value > rows.column("_top").to_numpy()[first][group] * threshold
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (above[1:] != above[:-1])])
        end = np.r_[new[1:], len(pos)] - 1
        columns = [rows.column("qseqid").take(pa.array(first[group[new]])), pa.array(pos[new].astype(np.int32)), pa.array((pos[end] + 1).astype(np.int32))]
        columns += [pa.array(f.reduceat(x, new)) for f, x in ((np.maximum, value), (np.maximum, hit_count), (np.add, value))]
        yield pa.RecordBatch.from_arrays(columns, ["qseqid", "lo", "hi", "combined", "hit_count", "total"])

    top = _smoothed_tiles(runs.drop("hit_count"), kernel, ["combined"], tile, tops, "qseqid string, _top double")
    top = top.groupBy("qseqid").agg(F.max("_top").alias("_top"))
    schema = "qseqid string, lo int, hi int, combined double, hit_count double, total double"
    return _smoothed_tiles(runs.join(top, "qseqid"), kernel, ["combined", "hit_count"], tile, stretches, schema)


def _span(df: DataFrame) -> DataFrame:
    """Positions or runs, as rows with lo and hi."""
    return df if "lo" in df.columns else df.withColumns({"lo": F.col("pos"), "hi": F.col("pos") + 1})


def _above(signal: DataFrame, threshold: float) -> DataFrame:
    top = signal.groupBy("qseqid").agg(F.max("combined").alias("_top")).where(F.col("_top") > 0)
    return signal.join(top, "qseqid").where(F.col("combined") > F.col("_top") * threshold).drop("_top")


def run_maxima(runs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Local maxima of a density in run-length form.

    Inside a run the signal is level, so only its first position can rise strictly from
    the left; it must not rise to the right and lie inside the query. The window holds the
    runs of one query, which its length bounds.
    """
    w = Window.partitionBy("qseqid").orderBy("lo")
    before = F.when(F.lag("hi").over(w) == F.col("lo"), F.lag("combined").over(w)).otherwise(0.0)
    after = F.when(F.lead("lo").over(w) == F.col("hi"), F.lead("combined").over(w)).otherwise(0.0)
    level = F.col("hi") - F.col("lo") > 1
    top = F.max("combined").over(Window.partitionBy("qseqid"))
    return (
        runs.withColumns({"_l": before, "_r": after, "_top": top})
        .where(
            (F.col("combined") > F.col("_top") * threshold)
            & (F.col("combined") > F.col("_l"))
            & (level | (F.col("combined") >= F.col("_r")))
            & (F.col("lo") > 0)
            & (F.col("lo") < F.col("qlen") - 1)
        )
        .withColumn("pos", F.col("lo"))
        .drop("_l", "_r", "_top", "lo", "hi")
    )


def crests(positions: DataFrame) -> DataFrame:
    """Smoothed positions above 0 that no neighbour exceeds: all local maxima and each query's
    maximum, so `find_peaks` finds the same in them as in all positions."""
    c = F.col("combined")
    beside = [(c >= F.col(side)) | F.col(side).isNull() for side in ("prev_combined", "next_combined")]
    return positions.where((c > 0) & beside[0] & beside[1])


def local_maxima(positions: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Interior positions above the threshold share of the query's maximum that rise
    strictly from the left and do not rise to the right (smoothed positions)."""
    return _above(positions, threshold).where(
        (F.col("combined") > F.col("prev_combined")) & (F.col("combined") >= F.col("next_combined"))
    )


def space_out(peaks: DataFrame, min_distance: int = 10) -> DataFrame:
    """Walk peaks from the left and keep those at least `min_distance` after the last kept.

    Positions count once; runs of close peaks may be of any length. Peaks are read several
    times, so they are written first: what they come from runs once.
    """
    peaks = stage(peaks, "peaks")
    kept = spaced(peaks.select("qseqid", "pos").distinct(), "qseqid", "pos", min_distance)
    return peaks.join(kept, ["qseqid", "pos"], "left_semi")


def find_peaks(signal: DataFrame, threshold: float = 0.1, min_distance: int = 10) -> DataFrame:
    """Spaced local maxima of a smoothed signal or of a density in run-length form."""
    return space_out(_maxima(signal, threshold), min_distance)


def peak_places(signal: DataFrame, threshold: float = 0.1, min_distance: int = 10) -> DataFrame:
    """(qseqid, pos) of what `find_peaks` finds, without going back to the signal for the rest."""
    return spaced(_maxima(signal, threshold).select("qseqid", "pos"), "qseqid", "pos", min_distance)


def _maxima(signal: DataFrame, threshold: float) -> DataFrame:
    maxima = run_maxima if "lo" in signal.columns else local_maxima
    return maxima(signal, threshold)


def _spans_with_family(hits: DataFrame, underscore: bool) -> DataFrame:
    """Distinct spans of a family with their hits by strand and summed weight.

    Equal spans are one row in the joins that follow: a query has no more of them per family
    than its length allows, however many hits it has.
    """
    return (
        hits.select(
            "qseqid",
            (F.col("qstart") - 1).alias("h_lo"),
            F.col("qend").alias("h_hi"),
            subject_token(F.col("sseqid"), underscore).alias("family"),
            is_plus().alias("is_plus"),
            inverse_evalue().alias("w"),
        )
        .groupBy("qseqid", "h_lo", "h_hi", "family")
        .agg(
            F.sum("w").alias("w"),
            F.count_if("is_plus").alias("plus"),
            F.count_if(~F.col("is_plus")).alias("minus"),
            F.count(F.lit(1)).alias("hits"),
        )
    )


def _top_families(
    per_family: DataFrame, key: Sequence[str], value, score: str, n: int = 5, carry: Sequence[str] = ()
) -> DataFrame:
    """The n best families of a key; `carry` names columns that are the same in all its rows."""
    ranked = per_family.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), "family"))
    ).where(F.col("_r") <= n)
    entry = F.struct("_r", "family", value.alias("v"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["family"], e["v"]))
    return ranked.groupBy(*key).agg(
        F.map_from_entries(entries).alias("families"),
        F.max(F.when(F.col("_r") == 1, F.col("family"))).alias("dominant_family"),
        *[F.max(c).alias(c) for c in carry],
    )


def annotate_peaks(peaks: DataFrame, hits: DataFrame, bin_width: int = 512) -> DataFrame:
    """Peaks with strand counts and the five families that add most, position 1-based.

    peaks: qseqid, pos, combined, combined_plus, combined_minus.
    """
    spans = peaks.select("qseqid", F.col("pos").alias("p_lo"), (F.col("pos") + 1).alias("p_hi"))
    key = ["qseqid", "pos"]
    # pairs are dealt by peak once; families, their ranks and the strands are all folded there
    per_family = (
        iv.overlap_join(
            _spans_with_family(hits, underscore=False), spans, ["qseqid"], ("h_lo", "h_hi"),
            ("p_lo", "p_hi"), closed=False, bin_width=bin_width,
        )
        .select("qseqid", F.col("p_lo").alias("pos"), "family", "w", "plus", "minus")
        .repartition(*key)
        .groupBy(*key, "family")
        .agg(
            F.sum("w").alias("weight"),
            F.sum("plus").alias("plus"),
            F.sum("minus").alias("minus"),
        )
    )
    whole = Window.partitionBy(*key)
    strands = {"plus_hits": F.sum("plus").over(whole), "minus_hits": F.sum("minus").over(whole)}
    top = _top_families(per_family.withColumns(strands), key, F.col("weight"), "weight", carry=list(strands))
    return (
        peaks.select(*key, "combined", "combined_plus", "combined_minus")
        .join(top, key, "left")
        .select(
            "qseqid",
            (F.col("pos") + 1).alias("position"),
            F.col("combined").alias("value"),
            F.col("combined_plus").alias("value_plus"),
            F.col("combined_minus").alias("value_minus"),
            F.coalesce("plus_hits", F.lit(0)).alias("plus_hits"),
            F.coalesce("minus_hits", F.lit(0)).alias("minus_hits"),
            F.col("families"),
            F.col("dominant_family"),
        )
    )


def density_summary(positions: DataFrame, hits: DataFrame, peaks: DataFrame | None = None) -> DataFrame:
    """Per query: length, hits by strand, number of peaks, maxima of five metrics."""
    counts = (
        hits.where(F.greatest(F.col("qstart") - 1, F.lit(0)) < F.least("qend", "qlen"))
        .groupBy("qseqid")
        .agg(
            F.max("qlen").alias("length"),
            F.count("*").alias("total_hits"),
            F.count_if(is_plus()).alias("plus_hits"),
            F.count_if(~is_plus()).alias("minus_hits"),
        )
    )
    five = [m for m in METRICS if m != "bitscore_weighted"]
    maxima = positions.groupBy("qseqid").agg(*[F.max(m).alias(f"max_{m}") for m in five])
    out = counts.join(maxima, "qseqid")
    if peaks is not None:
        n = peaks.groupBy("qseqid").agg(F.count("*").alias("num_peaks"))
        out = out.join(n, "qseqid", "left").withColumn("num_peaks", F.coalesce("num_peaks", F.lit(0)))
    return out


def signal_totals(positions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: length, hits, maximum and summed combined signal."""
    counts = hits.groupBy("qseqid").agg(F.max("qlen").alias("length"), F.count("*").alias("total_hits"))
    size = F.col("hi") - F.col("lo")
    sums = _span(positions).groupBy("qseqid").agg(
        F.max("combined").alias("max_signal"), F.sum(F.col("combined") * size).alias("total_signal")
    )
    return counts.join(sums, "qseqid")


def find_clusters(
    positions: DataFrame, threshold: float = 0.1, merge: int = 50, min_length: int = 20
) -> DataFrame:
    """Regions above the threshold share of the query's maximum, joined over gaps of at
    most `merge`, at least `min_length` long: qseqid, c_lo, c_hi (0-based half-open).
    Takes positions, runs or stretches."""
    above = _above(_span(positions), threshold).select(
        "qseqid", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi")
    )
    return iv.collapse(above, ["qseqid"], "c_lo", "c_hi", gap=merge).where(
        F.col("c_hi") - F.col("c_lo") >= min_length
    )


def annotate_clusters(
    clusters: DataFrame,
    positions: DataFrame,
    hits: DataFrame,
    sequences: DataFrame | None = None,
    bin_width: int = 512,
) -> DataFrame:
    """Clusters with signal statistics, families (count, score) and optional sequence.

    Output spans are 1-based closed; the mean counts uncovered positions as 0.
    """
    key = ["qseqid", "c_lo", "c_hi"]
    cl = clusters.select(*key)
    points = _span(positions).withColumnsRenamed({"lo": "p_lo", "hi": "p_hi"})
    summed = ["total"] if "total" in positions.columns else []
    points = points.select("qseqid", "p_lo", "p_hi", "combined", "hit_count", *summed)
    inside = F.least("p_hi", "c_hi") - F.greatest("p_lo", "c_lo")
    # stretches come with their totals and lie wholly inside
    total = F.col("total") if summed else F.col("combined") * inside
    stats = (
        iv.overlap_join(points, cl, ["qseqid"], ("p_lo", "p_hi"), ("c_lo", "c_hi"), closed=False, bin_width=bin_width)
        .groupBy(*key)
        .agg(
            F.max("combined").alias("max_signal"),
            F.sum(total).alias("total_signal"),
            F.max("hit_count").alias("max_hit_count"),
        )
    )
    per_family = (
        iv.overlap_join(
            _spans_with_family(hits, underscore=True), cl, ["qseqid"], ("h_lo", "h_hi"),
            ("c_lo", "c_hi"), closed=False, bin_width=bin_width,
        )
        .select(*key, "family", "hits", "w")
        .repartition(*key)
        .groupBy(*key, "family")
        .agg(F.sum("hits").alias("count"), F.sum("w").alias("score"))
    )
    top = _top_families(per_family, key, F.struct("count", "score"), "score")
    number = F.row_number().over(Window.partitionBy("qseqid").orderBy("c_lo"))
    size = F.col("c_hi") - F.col("c_lo")
    out = (
        stats.join(top, key, "left")
        .withColumn("cluster_id", number)
        .withColumn("mean_signal", F.col("total_signal") / size)
    )
    if sequences is not None:
        seqs = sequences.select(F.col("seq_id").alias("qseqid"), "seq")
        out = out.join(seqs, "qseqid", "left").withColumn(
            "sequence", F.substring("seq", (F.col("c_lo") + 1).cast("int"), size.cast("int"))
        ).drop("seq")
    return out.withColumns({"start": F.col("c_lo") + 1, "end": F.col("c_hi"), "length": size}).drop("c_lo", "c_hi")


def binned_signal(hits: DataFrame, width: int = 50) -> DataFrame:
    """Mean combined signal per fixed-width bin of every query that has hits.

    Works on spans cut at bin borders instead of single positions; bins nothing covers
    are reported as 0. Spans and the stretch that each query has are dealt by tile, whole numbers
    of bins; a tile's bins are summed where they lie, so its pieces take no memory and no join.
    """
    tile = width * max(1, 4096 // width)

    def cut(df: DataFrame, *columns: Column) -> DataFrame:
        tiles = F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor((F.col("hi") - 1) / tile)))
        t0 = F.col("_tile") * tile
        return df.withColumn("_tile", tiles).select(
            "qseqid", "_tile", F.greatest("lo", t0).alias("lo"), F.least("hi", t0 + tile).alias("hi"), *columns
        )

    spans = weighted_spans(hits).select("qseqid", "qlen", "lo", "hi", "combined")
    own = spans.groupBy("qseqid").agg(F.max("qlen").alias("qlen")).withColumns({"lo": F.lit(0), "hi": F.col("qlen")})
    none = F.lit(None).cast(spans.schema["qlen"].dataType)
    dealt = (
        cut(spans, "combined", none.alias("qlen"))
        .unionByName(cut(own, F.lit(0.0).alias("combined"), F.col("qlen")))
        .repartition("qseqid", "_tile")
        .withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    )
    b = F.col("bin") * width
    shared = F.least(F.col("hi"), b + width) - F.greatest(F.col("lo"), b)
    size = F.least(b + width, F.col("qlen")) - b
    return (
        dealt.groupBy("qseqid", "_tile", "bin")
        .agg(F.sum(F.col("combined") * shared).alias("_s"), F.max("qlen").alias("qlen"))
        .where(F.col("qlen").isNotNull())
        .select("qseqid", "bin", (F.col("_s") / size).alias("mean_signal"))
    )


def covered_positions(hits: DataFrame) -> DataFrame:
    """Per query: positions covered by sense only, antisense only, both, any.

    Both strands are counted over the stretches between span borders; no position is expanded.
    """
    spans = (
        hits.select("qseqid", (F.col("qstart") - 1).alias("lo"), F.col("qend").alias("hi"), is_plus().alias("_plus"))
        .where(F.col("lo") < F.col("hi"))
        .groupBy("qseqid", F.lit(0).alias("qlen"), "lo", "hi")
        .agg(F.count_if("_plus").cast("double").alias("plus"), F.count_if(~F.col("_plus")).cast("double").alias("minus"))
    )
    size = (F.col("hi") - F.col("lo")).cast("long")

    def bases(where) -> Column:
        return F.sum(F.when(where, size).otherwise(0))

    plus, minus = F.col("plus") > 0, F.col("minus") > 0
    return (
        span_sums(spans, "qseqid", ["plus", "minus"], 4096, "qlen")
        .groupBy("qseqid")
        .agg(
            F.sum(size).alias("covered"),
            bases(plus & ~minus).alias("sense_only"),
            bases(minus & ~plus).alias("anti_only"),
            bases(plus & minus).alias("both_strands"),
        )
    )


def segment_coverage(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Covered share of each transcript segment: fbtr, utr5_pct, cds_pct, utr3_pct."""
    spans = hits.select("qseqid", (F.col("qstart") - 1).alias("lo"), F.col("qend").alias("hi"))
    union = iv.merge_intervals(spans, ["qseqid"], "lo", "hi")
    dim = transcripts.select(F.col("fbtr").alias("qseqid"), "utr5_len", "cds_len", "utr3_len")
    b5 = F.col("utr5_len")
    bc = b5 + F.col("cds_len")
    b3 = bc + F.col("utr3_len")

    def share(lo, hi, size: str):
        bp = F.sum(F.greatest(F.lit(0), F.least("hi", hi) - F.greatest("lo", lo)))
        n = F.max(size)
        return F.when(n > 0, 100 * bp / n).otherwise(0.0)

    zero = F.lit(0)
    return (
        union.join(dim, "qseqid")
        .groupBy(F.col("qseqid").alias("fbtr"))
        .agg(
            share(zero, b5, "utr5_len").alias("utr5_pct"),
            share(b5, bc, "cds_len").alias("cds_pct"),
            share(bc, b3, "utr3_len").alias("utr3_pct"),
        )
    )
