"""Hard negatives of anchor vectors: near rows of other labels, just below a positive's score.

Vectors become integers, `floor(scale * x)`, so scores are exact. Anchors are taken in blocks
of bounded bytes, the rows in slabs, and every (block, slab) pair is one task's product: rows
stream through the task in tiles, a tile of scores is one Strassen product over int64 (padded
with zeros where it cannot be halved), and per anchor a heap of its best positives, or one of
negatives per positive score, is merged tile by tile. The heaps of the slabs are merged by rank
afterwards. Positives only meet rows of the anchor's label; hot labels are cut into slabs too.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part;
an empty vector scores 0 with all, a shorter one counts as padded with zeros. Rows that repeat
are rows of their own: a copy of the anchor can be its positive, and an id that occurs twice
can be listed twice. Ties go to the smaller id. Components may be of any size: where a score
could pass 50 bits, products are taken over Python integers; only a returned score that does
not fit 64 bits is an error. Extra columns are not read. Empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stage

NONE = -(1 << 62)
LAST = (1 << 63) - 1
EXACT_BITS = 50


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    #: a negative scores at least this many hundredths of the positive's score, and no more than it
    low_percent: int = 80
    #: packed anchors in one block; it bounds a task's memory together with `tile`
    block_bytes: int = 16 << 20
    #: rows of a slab at least, anchors and rows of a tile
    slab_rows: int = 4096
    tile: int = 1024
    #: sides up to this are multiplied directly
    leaf: int = 32


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """Product of two integer matrices with seven products of halves instead of eight.

    Odd sides get a row or column of zeros. Over int64 all sums are exact modulo 2 ** 64, so
    the result is exact wherever it fits, whatever the sums between do.
    """
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), p1.dtype)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best `k` (score, id, row) of many owners: higher scores first, then smaller ids.

    Heaps of two sets of rows merge into that of both, in any order and grouping.
    """

    def __init__(self, owners: int, k: int, big: bool = False):
        kind = object if big else np.int64
        self.k, self.scores = k, np.full((owners, k), NONE, kind)
        self.ids = np.full((owners, k), LAST, np.int64)
        self.full = np.zeros((owners, k), bool)

    def merge(self, at: slice, scores: np.ndarray, ids: np.ndarray, full: np.ndarray) -> None:
        s = np.concatenate([self.scores[at], scores], 1)
        i = np.concatenate([self.ids[at], ids], 1)
        f = np.concatenate([self.full[at], full], 1)
        if s.dtype == object:
            order = np.array([sorted(range(s.shape[1]), key=lambda x: (not f[r, x], -s[r, x], i[r, x]))[: self.k] for r in range(len(s))])
            order = order.reshape(len(s), min(self.k, s.shape[1]))
        else:
            order = np.lexsort((i, -s, ~f), axis=-1)[:, : self.k]
        self.scores[at], self.ids[at], self.full[at] = (np.take_along_axis(x, order, 1) for x in (s, i, f))

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Merge a tile: scores of the owners `at` with rows in ascending order of `ids`, where `fits`."""
        n = len(ids)
        k = min(self.k, n)
        if scores.dtype == object:
            self.merge(at, scores, np.broadcast_to(ids, scores.shape), fits)
            return
        # score and place in one number: unique, and ties go to the smaller id
        keys = np.where(fits, scores * n + np.arange(n - 1, -1, -1), NONE)
        if k < n:
            keys = np.take_along_axis(keys, np.argpartition(keys, n - k, axis=1)[:, n - k :], 1)
        full = keys != NONE
        place = n - 1 - keys % n
        self.merge(at, np.where(full, keys // n, NONE), np.where(full, ids[place], LAST), full)


def _packed(vectors: DataFrame, vec_id: Column, label: Column, vector: Column, anchor: Column, scale: int) -> DataFrame:
    """row, vec_id, label, anchor, dims, top, v: integer vectors of the rows that take part.

    `v` is a letter and the components: `s` for int16, `l` for int64, `t` for decimal text where
    one passes 62 bits. `top` is the largest magnitude, as a double.
    """
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            values = batch.column(4)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            starts = np.r_[0, ends[:-1]] if len(ends) else ends
            finite = np.r_[0, np.cumsum(~np.isfinite(flat))]  # a null component is NaN here
            keep = np.flatnonzero(finite[ends] == finite[starts]) if len(ends) else np.zeros(0, int)
            # a huge finite x times the scale can pass a double; Python's integers take over there
            with np.errstate(over="ignore"):
                whole = np.floor(flat * scale)
            packed, tops = [], []
            for r in keep:
                own = whole[starts[r] : ends[r]]
                top = float(np.abs(own).max()) if len(own) else 0.0
                if top < 2**15:
                    packed.append(b"s" + own.astype("<i2").tobytes())
                elif top < 2**62:
                    packed.append(b"l" + own.astype("<i8").tobytes())
                else:
                    exact = (x if abs(x) < 2**62 else int(flat[starts[r] + i]) * scale for i, x in enumerate(own.tolist()))
                    packed.append(b"t" + ",".join(str(int(x)) for x in exact).encode())
                tops.append(top)
            at = pa.array(keep)
            dims = (ends - starts)[keep].astype(np.int32) if len(keep) else np.zeros(0, np.int32)
            columns = [batch.column(i).take(at) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(dims), pa.array(tops, pa.float64()), pa.array(packed, pa.binary())],
                ["row", "vec_id", "label", "anchor", "dims", "top", "v"],
            )

    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        vec_id.cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        vector.cast("array<double>").alias("v"),
    ).where("vec_id is not null and label is not null and v is not null")
    return rows.mapInArrow(pack, "row long, vec_id long, label long, anchor boolean, dims int, top double, v binary")


def _matrix(values, dims: int, width: int, big: bool) -> np.ndarray:
    """Packed vectors as rows of `width` integers; short ones end in zeros."""
    out = np.zeros((len(values), width), object if big else np.int64)
    for i, (v, d) in enumerate(zip(values, dims)):
        if not d:
            continue
        if v[:1] == b"t":
            out[i, :d] = [int(x) for x in v[1:].split(b",")]
        else:
            out[i, :d] = np.frombuffer(v, "<i2" if v[:1] == b"s" else "<i8", offset=1)
    return out


class _Block:
    """The anchors of one block, their heaps, and what rows are compared with them."""

    def __init__(self, anchors, width: int, big: bool, settings: Settings):
        self.s, self.width, self.big = settings, width, big
        self.row, self.label = (anchors.column(c).to_numpy() for c in ("row", "label"))
        self.vectors = _matrix(anchors.column("v").to_pylist(), anchors.column("dims").to_pylist(), width, big)
        limits = anchors.column("limits").to_pylist()
        if limits and limits[0] is not None:
            # one heap per anchor and positive score; -1 stands for no such score
            self.limits = np.full((len(limits), settings.positives), -1, object if big else np.int64)
            for i, own in enumerate(limits):
                self.limits[i, : len(own)] = own
            self.heaps = [Heaps(len(limits), settings.negatives, big) for _ in range(settings.positives)]
        else:
            self.limits, self.heaps = None, [Heaps(len(limits), settings.positives, big)]

    def add(self, rows) -> None:
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        row, label, ids = rows.column("row").to_numpy()[order], rows.column("label").to_numpy()[order], ids[order]
        vectors = _matrix(rows.column("v").to_pylist(), rows.column("dims").to_pylist(), self.width, self.big)[order]
        for lo in range(0, len(ids), self.s.tile):
            part = slice(lo, lo + self.s.tile)
            turned = np.ascontiguousarray(vectors[part].T)
            for a in range(0, len(self.row), self.s.tile):
                self._tile(slice(a, min(a + self.s.tile, len(self.row))), turned, row[part], label[part], ids[part])

    def _tile(self, at: slice, turned: np.ndarray, row: np.ndarray, label: np.ndarray, ids: np.ndarray) -> None:
        scores = strassen(self.vectors[at], turned, self.s.leaf)
        if self.limits is None:
            self.heaps[0].offer(at, scores, ids, self.row[at][:, None] != row)
            return
        other = self.label[at][:, None] != label
        for j, heap in enumerate(self.heaps):
            limit = self.limits[at, j : j + 1]
            fits = other & (scores <= limit) & (100 * scores >= self.s.low_percent * limit) & (limit >= 0)
            if fits.any():
                heap.offer(at, scores, ids, fits.astype(bool))

    def results(self):
        """Batches of anchor, positive_score (null in the first step), vec_id, score."""
        import pyarrow as pa

        for j, heap in enumerate(self.heaps):
            for lo in range(0, len(self.row), 1 << 14):
                at = slice(lo, lo + (1 << 14))
                full = heap.full[at]
                anchor = np.broadcast_to(self.row[at][:, None], full.shape)[full]
                if not len(anchor):
                    continue
                limit = None
                if self.limits is not None:
                    limit = np.broadcast_to(self.limits[at, j : j + 1], full.shape)[full].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor),
                        pa.array(limit if limit is not None else [None] * len(anchor), pa.int64()),
                        pa.array(heap.ids[at][full]),
                        pa.array(heap.scores[at][full].tolist(), pa.int64()),
                    ],
                    ["anchor", "limit", "vec_id", "score"],
                )


def _products(anchors: DataFrame, rows: DataFrame, width: int, big: bool, settings: Settings) -> DataFrame:
    """Heaps of every (group, block, slab): its anchors are read first, then its rows stream by."""

    def run(batches):
        import pyarrow as pa

        key, held, block = None, [], None
        for batch in batches:
            # runs of one key and kind
            own = [batch.column(c).to_numpy() for c in ("group", "block", "slab", "kind")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in own], axis=0)) + 1 if batch.num_rows else []
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows]):
                if lo == hi:
                    continue
                now, part = tuple(int(x[lo]) for x in own[:3]), batch.slice(lo, hi - lo)
                if now != key:
                    if block:
                        yield from block.results()
                    key, held, block = now, [], None
                if own[3][lo] == 0:
                    held.append(part)
                elif held or block:
                    if block is None:
                        block, held = _Block(pa.Table.from_batches(held), width, big, settings), []
                    block.add(part)
        if block:
            yield from block.results()

    columns = ["group", "block", "slab", "kind", "row", "vec_id", "label", "dims", "v", "limits"]
    both = anchors.withColumn("kind", F.lit(0)).select(columns).unionByName(
        rows.withColumns({"kind": F.lit(1), "limits": F.lit(None).cast("array<long>")}).select(columns)
    )
    dealt = both.repartition("group", "block", "slab").sortWithinPartitions("group", "block", "slab", "kind")
    return dealt.mapInArrow(run, "anchor long, limit long, vec_id long, score long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    label: Column | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` says which rows are anchors, `label` is the label column (default `label`). Each
    anchor's first `positives` other rows of its label are its positives; each gets the first
    `negatives` rows of other labels that score from `low_percent` hundredths of its score up to it.
    """
    label = F.col("label") if label is None else label
    packed = stage(_packed(vectors, F.col(vec_id), label, F.col(vector), anchor, settings.scale), "vectors")
    # one row per label, beside one row of totals
    counts = packed.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("anchor").alias("m"),
        F.max("dims").alias("dims"),
        F.max("top").alias("top"),
    )
    counts = stage(counts, "labels")
    n, m, width, top = counts.agg(F.sum("n"), F.sum("m"), F.max("dims"), F.max("top")).first()
    width = max(width or 0, 1)
    big = width**0.5 * (top or 0.0) >= 2.0 ** (EXACT_BITS / 2)
    block_rows = max(1, settings.block_bytes // (8 * width))
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(rows: Column, size: float) -> Column:
        return F.greatest(F.lit(1), F.ceil(rows / F.lit(float(size)))).cast("int")

    def part_of(count: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), count).cast("int")

    # positives: an anchor meets the rows of its label
    slab_rows = max(settings.slab_rows, (n or 0) / tasks)
    sizes = counts.where("m > 0").select("label", parts(F.col("m"), block_rows).alias("_b"), parts(F.col("n"), slab_rows).alias("_s"))
    sized = packed.join(sizes, "label").withColumn("group", F.col("label"))
    held = sized.where("anchor").withColumns(
        {"block": part_of(F.col("_b"), 1), "slab": F.explode(F.sequence(F.lit(0), F.col("_s") - 1)), "limits": F.lit(None).cast("array<long>")}
    )
    rows = sized.withColumns({"slab": part_of(F.col("_s"), 2), "block": F.explode(F.sequence(F.lit(0), F.col("_b") - 1))})
    positives = _best(_products(held, rows, width, big, settings), ["anchor"], settings.positives)
    positives = stage(positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # windows: an anchor and its at most `positives` scores meet all rows
    blocks = max(1, -(-(m or 0) // block_rows))
    slabs = max(1, min(-(-tasks // blocks), -(-(n or 0) // settings.slab_rows)))
    # no negative can lie in the window of a negative score
    limits = positives.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("limits"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = packed.where("anchor").join(limits, "row").withColumns({"group": F.lit(0).cast("long"), "block": part_of(F.lit(blocks), 1), "slab": every(slabs)})
    rows = packed.withColumns({"group": F.lit(0).cast("long"), "slab": part_of(F.lit(slabs), 2), "block": every(blocks)})
    windows = _best(_products(held, rows, width, big, settings), ["anchor", "limit"], settings.negatives)

    named = packed.where("anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        positives.join(windows.withColumnsRenamed({"limit": "positive_score", "vec_id": "negative_id", "score": "negative_score"}), ["anchor", "positive_score"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
