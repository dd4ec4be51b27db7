"""Range-add segment trees over tiles of positions, and greedy spacing over tiles.

Both work on rows sorted by tile and keep one tile's arrays at a time, so memory is bounded by
the tile, not by how many rows a tile has. All tiles of an Arrow batch are handled together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stage


def groups(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """First row of every run of equal keys."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class _Tiles:
    """Node sums and borders of some tiles; tile g's node i has the key g * 2 * size + i."""

    def __init__(self, size: int):
        self.size = size
        self.keys, self.sums = np.zeros(0, np.int64), None
        self.borders = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray, borders: np.ndarray) -> None:
        """Sum equal nodes with those held. Only additions: weights of any size keep their terms."""
        if self.sums is not None:
            keys, values = np.concatenate([self.keys, keys]), np.concatenate([self.sums, values], 1)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[:, order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.sums = keys[first], np.add.reduceat(values, first, axis=1) if len(first) else values
        self.borders = np.unique(np.concatenate([self.borders, borders]))

    def add_spans(self, tile: np.ndarray, lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> None:
        """Put spans [lo, hi) of their tiles on the at most 2 log(size) nodes that make them up."""
        left, right = lo + self.size, hi + self.size
        keys, rows = [], []
        at = np.arange(len(lo))
        while len(at):
            for odd, node in ((left & 1 == 1, left), (right & 1 == 1, right - 1)):
                keys.append(tile[at[odd]] * (2 * self.size) + node[odd])
                rows.append(at[odd])
            left, right = (left + (left & 1)) >> 1, (right - (right & 1)) >> 1
            go = left < right
            at, left, right = at[go], left[go], right[go]
        keys, rows = np.concatenate(keys or [self.keys[:0]]), np.concatenate(rows or [self.keys[:0]])
        self.add(keys, values[:, rows], np.concatenate([tile * (2 * self.size) + lo, tile * (2 * self.size) + hi]))

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """tile, lo, hi and sums of the stretches between borders: what lies on the path to the root."""
        width = 2 * self.size
        tile, lo = self.borders[:-1] // width, self.borders[:-1] % width
        same = self.borders[1:] // width == tile
        tile, lo, hi = tile[same], lo[same], (self.borders[1:] % width)[same]
        sums = np.zeros((len(self.sums) if self.sums is not None else 0, len(lo)))
        node = lo + self.size
        while len(node) and node[0] > 0:
            key = tile * width + node
            place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            found = self.keys[place] == key
            sums[:, found] += self.sums[:, place[found]]
            node >>= 1
        return tile, lo, hi, sums

    def split(self, tile: int) -> "_Tiles":
        """Take out one tile; it becomes tile 0 of the result."""
        out, start = _Tiles(self.size), tile * 2 * self.size
        mine, own = self.keys >= start, self.borders >= start
        if self.sums is not None:
            out.keys, out.sums = self.keys[mine] - start, self.sums[:, mine]
            self.keys, self.sums = self.keys[~mine], self.sums[:, ~mine]
        out.borders, self.borders = self.borders[own] - start, self.borders[~own]
        return out


def span_sums(spans: DataFrame, key: str, metrics: Sequence[str], tile: int, length: str) -> DataFrame:
    """Sums of the spans over every stretch between two borders: key, length, lo, hi, metrics.

    `spans` has key, length, lo, hi (0-based, half-open) and metrics. Spans are cut at tiles
    and each tile is one range-add tree: a span adds to the few nodes that make it up, a stretch
    reads the nodes above its first position. Stretches that nothing covers are left out; every
    position of a stretch has one value, the same sum in the same order.
    """
    size = 1 << max(0, tile - 1).bit_length()
    metrics = list(metrics)
    t0 = F.col("_tile") * size
    cut = spans.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size)))).select(
        key, length, "_tile", (F.greatest("lo", t0) - t0).cast("long").alias("lo"), (F.least("hi", t0 + size) - t0).cast("long").alias("hi"), *metrics
    )
    fields = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    schema = f"`{key}` {fields[key]}, `{length}` {fields[length]}, lo int, hi int, " + ", ".join(f"`{m}` double" for m in metrics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = None, None  # the tile that may go on in the next batch: tree, (key, tile, length)

        def out(tiles: _Tiles, keys: pa.Array, lengths: pa.Array, starts: np.ndarray):
            tile, lo, hi, sums = tiles.pieces()
            keep = sums[0] > 0 if len(sums) else np.zeros(0, bool)
            tile, lo, hi, sums = tile[keep], lo[keep], hi[keep], sums[:, keep]
            at = pa.array(tile)
            columns = [keys.take(at), lengths.take(at), pa.array((starts[tile] + lo).astype(np.int32)), pa.array((starts[tile] + hi).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums[1:])], [key, length, "lo", "hi", *metrics])

        for batch in batches:
            if not batch.num_rows:
                continue
            first = groups(batch, [key, "_tile"])
            at = pa.array(first)
            keys, numbers = batch.column(key).take(at), batch.column("_tile").take(at).to_numpy()
            lengths = np.maximum.reduceat(batch.column(length).fill_null(-1).to_numpy(), first)
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, batch.num_rows]))
            values = np.stack([np.ones(batch.num_rows), *(batch.column(m).to_numpy(zero_copy_only=False) for m in metrics)])
            tiles = _Tiles(size)
            if held is not None:
                if name[:2] == (keys[0].as_py(), int(numbers[0])):
                    tiles, lengths[0] = held, max(lengths[0], name[2])
                else:
                    yield out(held, *alone)
            tiles.add_spans(group, batch.column("lo").to_numpy(), batch.column("hi").to_numpy(), values)
            last = len(first) - 1
            held, name = tiles.split(last), (keys[last].as_py(), int(numbers[last]), int(lengths[last]))
            kind = batch.schema.field(length).type
            known = pa.array(lengths, kind, mask=lengths < 0)
            alone = (keys.slice(last), known.slice(last), numbers[last:] * size)
            if last:
                yield out(tiles, keys, known, numbers * size)
        if held is not None:
            yield out(held, *alone)

    dealt = cut.repartition(key, "_tile").sortWithinPartitions(key, "_tile", "lo", "hi")
    return dealt.mapInArrow(run, schema)


def _walk(place: np.ndarray, group: np.ndarray, size: int, gap: int) -> np.ndarray:
    """Index of the next place at least `gap` further on in the same tile, or len(place)."""
    wide = size + gap
    line = group * wide + place
    to = np.searchsorted(line, line + gap)
    inside = to < len(place)
    inside[inside] = group[to[inside]] == group[inside]
    return np.where(inside, to, len(place))


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no tile is split; a tile has no more rows than positions."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start = groups(batch, keys)[-1]
        same = held and all(held[0].column(k)[0] == batch.column(k)[0] for k in keys)
        if start or (held and not same):
            done = pa.Table.from_batches([*held, batch.slice(0, start)] if same or not held else held)
            if done.num_rows:
                yield done.combine_chunks().to_batches()[0]
            if held and not same and start:
                yield batch.slice(0, start)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spaced(places: DataFrame, key: str, pos: str, gap: int, tile: int = 4096) -> DataFrame:
    """(key, pos): places kept when walking from the left, at least `gap` after the last kept one.

    Every place points to the next one it would keep; chains of pointers are followed by
    doubling inside a tile. What a tile hands on is how far into the next one nothing may be
    kept, one of `gap` states, so a tile is a table from the state it is entered in to the one it
    is left in. Tables of neighbouring tiles are joined by doubling over written tables until
    each one no longer depends on its entry: a run of n places takes some log(n / tile) rounds.
    `places` are distinct, from 0 on.
    """
    size = max(tile, gap)
    tiled = places.select(key, F.floor(F.col(pos) / size).cast("long").alias("_tile"), F.col(pos).cast("long").alias("_p"))
    tiled = stage(tiled, "places")
    kind = places.schema[key].dataType.simpleString()
    edges = tiled.groupBy(key, "_tile").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    # only a tile whose last places reach over into the first ones of the next hands anything on
    after = edges.select(key, (F.col("_tile") - 1).alias("_tile"), F.col("_first").alias("_next"))
    open_ = edges.join(after, [key, "_tile"]).where(F.col("_next") - F.col("_last") < gap).select(key, "_tile")
    open_ = stage(open_, "open")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_tiles(batches, [key, "_tile"]):
            first = groups(batch, [key, "_tile"])
            number = batch.column("_tile").to_numpy()
            place = batch.column("_p").to_numpy() - number * size
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, batch.num_rows]))
            to = _walk(place, group, size, gap)
            # the last place kept behind each one
            end = np.r_[np.where(to < len(place), to, np.arange(len(place))), len(place)]
            while True:
                further = end[end]
                if (further == end).all():
                    break
                end = further
            entry = np.searchsorted(group * (size + gap) + place, (np.arange(len(first)) * (size + gap))[:, None] + np.arange(gap))
            inside = entry < np.r_[first[1:], batch.num_rows][:, None]
            left = np.where(inside, place[end[np.minimum(entry, len(place) - 1)]] + gap - size, np.arange(gap) - size)
            left = np.maximum(left, 0).astype(np.int32)
            at = pa.array(first)
            table = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * gap), pa.array(left.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), batch.column("_tile").take(at), table], [key, "_tile", "_exit"])

    chains = tiled.join(open_, [key, "_tile"], "left_semi").repartition(key, "_tile").sortWithinPartitions(key, "_tile", "_p")
    exits_ = stage(chains.mapInArrow(exits, f"`{key}` {kind}, _tile long, _exit array<int>"), "exits")
    fixed = F.forall("_exit", lambda x: x == F.get("_exit", F.lit(0)))
    step = 1
    # a table that depends on its entry is joined with that of the tiles before it, or entered in state 0
    while not exits_.where(~fixed).isEmpty():
        before = exits_.select(key, (F.col("_tile") + step).alias("_tile"), F.col("_exit").alias("_entry"))
        zero = F.array_repeat(F.lit(0), gap)
        joined = F.transform(F.coalesce("_entry", zero), lambda x: F.get("_exit", x))
        moving = exits_.where(~fixed).join(before, [key, "_tile"], "left").select(key, "_tile", joined.alias("_exit"))
        exits_ = stage(exits_.where(fixed).unionByName(moving), "exits")
        step *= 2
    entered = exits_.select(key, (F.col("_tile") + 1).alias("_tile"), F.get("_exit", F.lit(0)).alias("_entry"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_tiles(batches, [key, "_tile"]):
            first = groups(batch, [key, "_tile"])
            place = batch.column("_p").to_numpy() - batch.column("_tile").to_numpy() * size
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, batch.num_rows]))
            entry = batch.column("_entry").fill_null(0).to_numpy()[first]
            start = np.searchsorted(group * (size + gap) + place, np.arange(len(first)) * (size + gap) + entry)
            marked = np.zeros(len(place) + 1, bool)
            marked[start[start < np.r_[first[1:], batch.num_rows]]] = True
            jump = np.r_[_walk(place, group, size, gap), len(place)]
            # what is marked marks where it points; pointers double
            while (jump < len(place)).any():
                marked[jump[marked]] = True
                jump = jump[jump]
            yield batch.filter(pa.array(marked[:-1])).select([key, "_p"])

    whole = tiled.join(entered, [key, "_tile"], "left").repartition(key, "_tile").sortWithinPartitions(key, "_tile", "_p")
    found = whole.mapInArrow(kept, f"`{key}` {kind}, _p long")
    return found.select(key, F.col("_p").cast(places.schema[pos].dataType).alias(pos))
