"""Benchmark decontamination with one FM-index per shard of documents.

A shard is an Arrow batch. Its index holds the runs of words that the benchmark knows, as
other words cannot be part of an occurrence; runs shorter than the shortest phrase go too.
Phrases are found by backward search over a wavelet matrix, their places by walking to
sampled suffix positions, and the found spans are merged per document.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM

WINDOW = 10
#: Text of one broadcast block of the benchmark; larger benchmarks are searched block by block.
BLOCK_BYTES = 4_000_000
#: Words of one index; a shard with more gets several.
INDEX_WORDS = 1 << 20
SAMPLE = 16
#: A word in a text whose A-Z are as they were.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "struct<n_words bigint, n_hit bigint, items array<string>, words array<struct<start: int, end: int>>, spans array<struct<start: int, end: int>>>"
ONE = np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text after A-Z are lower-cased."""
    return text.translate(ALNUM).split()


class Phrases:
    """Distinct windows of a block of benchmark items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text.encode())]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found[tuple(ids[i : i + window])].add(item)
        lengths = sorted({len(p) for p in found})
        self.groups = []
        for n in lengths:
            own = [p for p in found if len(p) == n]
            self.groups.append((np.array(own, np.int64).reshape(len(own), n), [sorted(found[p]) for p in own]))
        self.shortest = lengths[0] if lengths else 0


class FmIndex:
    """Index of a sequence of symbols 1.. with 0 between runs."""

    def __init__(self, seq: np.ndarray, top: int):
        n = self.n = len(seq)
        order = self._suffixes(seq)
        last = seq[order - 1]  # order 0 wraps round to the final 0
        self.starts = np.searchsorted(seq[order], np.arange(top + 2))
        # every run's first word is sampled, so walks never cross a 0
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.rows = np.flatnonzero(sampled)
        self.places = order[self.rows]
        self.levels = []
        cur = last
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (cur >> bit) & 1 == 1
            packed = np.zeros(n // 64 + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.levels.append((bit, packed, counts, n - int(ones.sum())))
            cur = np.concatenate([cur[~ones], cur[ones]])

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; each 0 counts as a symbol of its own."""
        n = len(seq)
        gap = seq == 0
        rank = seq + int(gap.sum())
        rank[gap] = np.arange(gap.sum())
        step = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(nxt.max()) + 1) + nxt
            order = np.argsort(key, kind="stable")
            ranked = np.cumsum(np.r_[0, (np.diff(key[order]) != 0).astype(np.int64)])
            rank = np.empty(n, np.int64)
            rank[order] = ranked
            if ranked[-1] == n - 1:
                return order
            step *= 2

    @staticmethod
    def _ones(packed, counts, at):
        w = at >> 6
        mask = (ONE << (at & 63).astype(np.uint64)) - ONE
        return counts[w] + np.bitwise_count(packed[w] & mask)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            r = self._ones(packed, counts, at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + r, at - r)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self._down(symbol, np.zeros_like(at))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi): suffix ranges of the phrases that occur, all searched at once."""
        own = np.arange(len(phrases))
        c = phrases[:, -1]
        lo, hi = self.starts[c], self.starts[c + 1]
        for i in range(phrases.shape[1] - 2, -1, -1):
            alive = lo < hi
            own, lo, hi = own[alive], lo[alive], hi[alive]
            if not len(own):
                break
            c = phrases[own, i]
            lo, hi = self.starts[c] + self.rank(c, lo), self.starts[c] + self.rank(c, hi)
        alive = lo < hi
        return own[alive], lo[alive], hi[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            at = np.minimum(np.searchsorted(self.rows, row), len(self.rows) - 1)
            known = self.rows[at] == row
            out[left[known]] = self.places[at[known]] + steps
            left, row = left[~known], row[~known]
            # step back: read the preceding symbol on the way down, then map
            sym, pos = np.zeros(len(row), np.int64), row
            for bit, packed, counts, zeros in self.levels:
                b = (packed[pos >> 6] >> (pos & 63).astype(np.uint64)) & ONE == ONE
                r = self._ones(packed, counts, pos)
                sym |= b.astype(np.int64) << bit
                pos = np.where(b, zeros + r, pos - r)
            row = self.starts[sym] + pos - self._down(sym, np.zeros_like(pos))
            steps += 1
        return out


def _runs(ids: np.ndarray, shortest: int):
    """(start, end) of runs of known words that can hold a phrase."""
    edge = np.diff(np.r_[0, (ids > 0).astype(np.int8), 0])
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = hi - lo >= shortest
    return lo[long], hi[long]


class ShardSearch:
    """Finds the phrases in the documents of a shard."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases

    def __call__(self, texts) -> tuple[list[int], dict[int, set[str]], dict[int, list[tuple[int, int]]]]:
        ids, counts = self.phrases.ids, []
        self.items, self.found = defaultdict(set), defaultdict(list)
        pieces, doc, start, size = [], [], [], 0
        for k, text in enumerate(texts):
            words = words_of(text) if text else []
            counts.append(len(words))
            if not self.phrases.groups or not words:
                continue
            own = np.fromiter(map(ids.get, words, _zeros()), np.int64, len(words))
            for lo, hi in zip(*_runs(own, self.phrases.shortest)):
                pieces += [own[lo:hi], np.zeros(1, np.int64)]
                doc.append(k)
                start.append((size, int(lo)))
                size += int(hi - lo) + 1
            if size > INDEX_WORDS:
                self._search(pieces, doc, start)
                pieces, doc, start, size = [], [], [], 0
        if size:
            self._search(pieces, doc, start)
        return counts, self.items, self.found

    def _search(self, pieces, doc, start) -> None:
        index = FmIndex(np.concatenate(pieces), len(self.phrases.ids))
        begins = np.array([a for a, _ in start])
        for rows, owners in self.phrases.groups:
            own, lo, hi = index.search(rows)
            n = hi - lo
            first = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else n
            places = index.locate(first + np.arange(int(n.sum())))
            run = np.searchsorted(begins, places, "right") - 1
            for p, r, at in zip(np.repeat(own, n).tolist(), run.tolist(), places.tolist()):
                word = at - start[r][0] + start[r][1]
                self.items[doc[r]].update(owners[p])
                self.found[doc[r]].append((word, word + rows.shape[1]))


def _zeros():
    while True:
        yield 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def char_spans(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans of word spans, from the first word's start to the last word's end."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in words]


def _search_udf(phrases):
    @F.arrow_udf(SCHEMA)
    def search(texts: pa.Array) -> pa.Array:
        raw = texts.to_pylist()
        counts, items, found = ShardSearch(phrases.value)(raw)
        rows = []
        for k, n in enumerate(counts):
            words = merged(found[k]) if k in found else []
            spans = char_spans(raw[k].decode(), words) if words else []
            rows.append((n, sum(b - a for a, b in words), sorted(items.get(k, ())), words, spans))
        pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        pairs = lambda i: pa.array([[{"start": a, "end": b} for a, b in r[i]] for r in rows], pa.list_(pair))
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
        cols += [pa.array([r[2] for r in rows], pa.list_(pa.string())), pairs(3), pairs(4)]
        return pa.StructArray.from_arrays(cols, ["n_words", "n_hit", "items", "words", "spans"])

    return search


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Items in blocks of at most `block_bytes` of text (one item at least), read one by one."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def _fuse(columns: list[Column]) -> Column:
    """Results of several blocks as one: spans merged again."""

    def spans(field: str) -> Column:
        every = F.array_sort(F.flatten(F.array(*[c[field] for c in columns])))
        empty = F.array().cast("array<struct<start:int,end:int>>")

        def add(acc, s):
            last = F.element_at(acc, -1)
            joins = (F.size(acc) > 0) & (s["start"] <= F.when(F.size(acc) > 0, last["end"]))
            wide = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
            return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide))).otherwise(
                F.concat(acc, F.array(s))
            )

        return F.aggregate(every, empty, add)

    words = spans("words")
    return F.struct(
        columns[0]["n_words"].alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[c["items"] for c in columns])))).alias("items"),
        words.alias("words"),
        spans("spans").alias("spans"),
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, into: str = "contamination", block_bytes: int = BLOCK_BYTES, window: int = WINDOW
) -> DataFrame:
    """`docs` with a struct column `into`: n_words, n_hit, items, words and spans.

    items: ids (as strings, sorted) of items with a window in the text; words: merged spans of
    hit words; spans: the same in code points, what a removal cuts out. A null or empty text
    has no words; a null or empty item has no windows; a null item_id is the id "". Repeated
    rows are treated alike, other columns pass through (`into` must not be one of them).
    """
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    columns = [_search_udf(spark.sparkContext.broadcast(Phrases(b, window)))(text) for b in benchmark_blocks(benchmark, block_bytes)]
    if len(columns) == 1:
        return docs.withColumn(into, columns[0])
    names = [f"{into}_{i}" for i in range(len(columns))]
    wide = docs.withColumns(dict(zip(names, columns)))
    return wide.withColumn(into, _fuse([F.col(n) for n in names])).drop(*names)


def removed(text: Column, spans: Column) -> Column:
    """`text` without the code points of the (merged, ascending) spans; a line break stands for each."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a))
    return F.array_join(kept, "\n")
