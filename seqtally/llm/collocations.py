"""Collocations: phrases that occur often, and far more often than their parts would make them.

1. Every task hashes the contiguous phrases of its texts and adds up what it meets; hashes go in
   buckets, as sorted blocks, to the tasks that sum them. A hash can only count too much, and the
   parts of a frequent phrase are frequent themselves (Apriori), so no phrase and no part of one
   is lost. What may be frequent is marked in a filter of fixed size, which is broadcast.
2. Every task lists the phrases of some texts that the filter lets through and makes a
   double-array trie over word numbers of them; all positions of these texts step through it
   together, one word a level, and accepting states are counted by bincount.
3. The counts of all tries are summed. They are exact, as a phrase is in the trie of all texts that
   hold it; phrases that the filter let through by chance fall out here.
4. Parts, scores, contained phrases and ranks are joins and windows over the counted phrases.

The texts are read twice, whatever the number of phrases.

Everything is per language. A null language is named by `no_lang`, a null text has no words.
Other columns are not read. Rows that repeat count again. Ties in score and count go to the
phrase that is smaller in UTF-8 byte order. Texts are counted whole. Empty tables give none.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stage
from .common import LOWER
from .word_arrays import byte_kinds, hashes_of, slices, split_words

KINDS = byte_kinds(b"\t ", b".,;:!?\n\x0b\x0c\r")
LOWER_CASE = np.frombuffer(LOWER, np.uint8)
SLICE_BYTES = 2 << 20
#: codes a task holds before it hands them on, and bytes of texts whose phrases are in one trie
HELD_CODES = 4_000_000
HELD_BYTES = 32 << 20
#: 8 bits beside a hash hold a task's count; the first bits of a hash name its bucket. Hashes are
#: short, as they are shuffled: where two phrases share one, the filter may let an infrequent one through.
HASH_BITS, COUNT_BITS, BUCKET_BITS = 40, 8, 12
MOST = (1 << COUNT_BITS) - 1
#: bits of the filter for every bucket (32 MB over all of them)
FILTER_BITS = 16
#: bits of a trie symbol, and neighbouring places looked at together for a node
DIGIT_BITS, TRIES = 10, 32
LOW_DIGIT = (1 << DIGIT_BITS) - 1


@dataclass(frozen=True)
class Settings:
    max_words: int = 3
    min_count: int = 10
    #: a phrase goes where a longer one has at least this many hundredths of its occurrences
    contained_percent: int = 50
    top: int = 2000
    no_lang: str = "und"
    #: phrases of one trie (with its words some 60 bytes each), beyond which its texts are counted
    shard_phrases: int = 1 << 20
    #: parts a language's phrases are ranked in before the best of all parts are
    rank_parts: int = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _name_hashes(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)


@dataclass
class Numbered:
    """Of `Words`, the distinct ones, and the number and piece of every word."""

    dictionary: object
    code: np.ndarray
    piece: np.ndarray


class Texts:
    """Words of a slice of texts, and which positions begin phrases of k words."""

    def __init__(self, langs, texts, no_lang: str):
        import pyarrow.compute as pc

        self.words = split_words(texts, KINDS, LOWER_CASE)
        self.bytes = texts.nbytes
        coded = pc.fill_null(langs, no_lang).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[self.words.row]

    def shrink(self) -> None:
        """Keep only what a trie reads."""
        self.words = Numbered(self.words.dictionary, self.words.code.astype(np.int32), self.words.piece.astype(np.int32))

    def longer(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which of the positions `at` are followed by `k` - 1 more words in their piece."""
        piece = self.words.piece
        last = at + (k - 1)
        inside = last < len(piece)
        inside[inside] = piece[last[inside]] == piece[at[inside]]
        return inside

    def codes(self, most: int, frequent: "Frequent | None" = None):
        """(k, positions, 40-bit hash of the phrase there) for k = 1 .. `most`.

        With a filter only those that it lets through; no longer phrase is there without them.
        """
        words = self.words
        # with a filter the distinct words are needed anyway: each is hashed once then
        own = words.hashes() if frequent is None else hashes_of(words.dictionary)[words.code]
        state = _mixed(own + _name_hashes(self.langs)[self.lang])
        at = np.arange(len(own))
        for k in range(1, most + 1):
            if k > 1:
                keep = self.longer(at, k)
                at = at[keep]
                state = _mixed(state[keep] ^ (own[at + (k - 1)] + np.uint64(k)))
            codes = state >> np.uint64(64 - HASH_BITS)
            if frequent is not None:
                keep = frequent.has(codes)
                at, state, codes = at[keep], state[keep], codes[keep]
            yield k, at, codes

    def phrases(self, frequent: "Frequent", most: int):
        """Table (lang, phrase) of the distinct phrases that the filter lets through."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words, found = self.words, []
        dictionary = words.dictionary.cast(pa.binary())
        for k, at, codes in self.codes(most, frequent):
            # one position for every phrase: equal hashes side by side, and of those all but
            # repeats of the very same words; words are numbered
            if k == 1:
                some = np.full(len(self.langs) * len(dictionary), -1)
                some[self.lang[at] * len(dictionary) + words.code[at]] = at
                at = some[some >= 0]
            else:
                at = at[np.argsort(codes, kind="stable")]
            key = [self.lang[at], *(words.code[at + j] for j in range(k))]
            new = np.ones(len(at), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in key], axis=0)
            parts = [dictionary.take(pa.array(c[new])) for c in key[1:]]
            langs = pa.array(self.langs, pa.string()).take(pa.array(key[0][new]))
            found.append(pa.table([langs, pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]], ["lang", "phrase"]))
        return pa.concat_tables(found)


def _digit(number: np.ndarray, digits: int, j: int) -> np.ndarray:
    """The j-th of the symbols of a number; -1 where the number is negative."""
    return np.where(number < 0, -1, number >> DIGIT_BITS * (digits - 1 - j) & LOW_DIGIT)


class Trie:
    """Double-array trie of phrases over numbered words; the first level is the language.

    A word is as many symbols of `DIGIT_BITS` bits as the largest number takes, high bits first;
    frequent words have small numbers. So is a language. The state after symbol x in state s is `base[s] + x` where `check` says
    that it belongs to s. `accept[s]` is the number of the phrase that ends in s, or -1.
    """

    def __init__(self, langs, phrases):
        """Arrow arrays, a language and a space-joined phrase for each of the distinct phrases."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = langs.dictionary_encode()
        self.langs = {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
        words = pc.split_pattern(phrases.cast(pa.large_binary()), b" ")
        numbers = words.flatten().dictionary_encode()
        code = numbers.indices.to_numpy().astype(np.int64)
        often = np.argsort(-np.bincount(code, minlength=len(numbers.dictionary)), kind="stable")
        self.symbols = numbers.dictionary.take(pa.array(often))
        code = np.argsort(often)[code] if len(often) else code
        self.digits = [max(1, -(-(n - 1).bit_length() // DIGIT_BITS)) for n in (max(len(self.langs), 1), max(len(often), 1))]
        head, per_word = self.digits
        n_words = words.value_lengths().to_numpy().astype(np.int64)
        size = head + per_word * n_words
        symbols = np.full((len(size), int(size.max(initial=1))), -1, np.int16)
        row = np.repeat(np.arange(len(size)), n_words)
        place = np.arange(len(code)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        for j in range(head):
            symbols[:, j] = _digit(coded.indices.to_numpy().astype(np.int64), head, j)
        for j in range(per_word):
            symbols[row, head + per_word * place + j] = _digit(code, per_word, j)
        # level by level: an edge is (parent, symbol), equal edges are one node
        state, rows, total = np.zeros(len(size), np.int64), np.arange(len(size)), 1
        parents, taken = [np.zeros(1, np.int64)], [np.full(1, -1)]
        for level in range(symbols.shape[1]):
            rows = rows[size[rows] > level]
            edges, which = np.unique(state[rows] << DIGIT_BITS | symbols[rows, level], return_inverse=True)
            state[rows] = total + which
            parents.append(edges >> DIGIT_BITS)
            taken.append(edges & LOW_DIGIT)
            total += len(edges)
        slot = self._place(np.concatenate(parents), np.concatenate(taken), total)
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[slot[state]] = np.arange(len(size))

    def _place(self, parent: np.ndarray, symbol: np.ndarray, total: int) -> np.ndarray:
        """Slots of all nodes, and the arrays over slots: nodes with many children first, lone
        children fill the holes."""
        # children of a node lie together, as edges are sorted within a level
        children = np.bincount(parent[1:], minlength=total)
        first = np.searchsorted(parent[1:], np.arange(total)) + 1
        used = np.zeros(2 * total + (1 << DIGIT_BITS) + 2 * TRIES, bool)
        used[0] = True
        base, slot = np.zeros(total, np.int64), np.zeros(total, np.int64)
        order = np.argsort(-children, kind="stable")
        low, shifts = 1, np.arange(TRIES)[:, None]
        for node in order[: np.count_nonzero(children > 1)]:
            own = symbol[first[node] : first[node] + children[node]]
            relative = own - own[0]
            while True:
                if low + TRIES + relative[-1] >= len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                fits = np.flatnonzero(~used[low + shifts + relative].any(1))
                if len(fits):
                    break
                low += TRIES
            at = low + fits[0]
            used[at + relative] = True
            slot[first[node] : first[node] + children[node]] = at + relative
            base[node] = at - own[0]
        lone = np.flatnonzero(children == 1)
        free = np.flatnonzero(~used)[: len(lone)]
        free = np.concatenate([free, np.arange(len(used), len(used) + len(lone) - len(free))])
        slot[first[lone]] = free
        base[lone] = free - symbol[first[lone]]
        length = int(slot.max(initial=0)) + 1
        self.check = np.full(length, -1, np.int32)
        self.base = np.zeros(length, np.int32)
        self.check[slot[1:]] = slot[parent[1:]]
        self.base[slot] = base
        # a state without children leads nowhere: no slot can hold one of its own
        self.base[slot[children == 0]] = -(1 << 30)
        return slot

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none; symbol -1 stands for a word that no phrase has."""
        to = self.base[state].astype(np.int64) + symbol
        inside = (symbol >= 0) & (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == state) & (to > 0), to, -1)

    def walk(self, at: np.ndarray, state: np.ndarray, number: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that get through all symbols of their number, and their states."""
        for j in range(digits):
            state = self.step(state, _digit(number, digits, j))
            on = state >= 0
            at, state, number = at[on], state[on], number[on]
        return at, state

    def count(self, texts: Texts, known, most: int) -> np.ndarray:
        """Occurrences of every phrase; all positions take each level together."""
        import pyarrow.compute as pc

        numbers = pc.fill_null(pc.index_in(texts.words.dictionary, value_set=known), -1)
        symbol = numbers.to_numpy(zero_copy_only=False).astype(np.int64)[texts.words.code]
        lang = np.array([self.langs.get(x, -1) for x in texts.langs], np.int64)
        at, state = self.walk(np.arange(len(symbol)), np.zeros(len(symbol), np.int64), lang[texts.lang], self.digits[0])
        out = np.zeros(len(self.accept), np.int64)
        for k in range(1, most + 1):
            if k > 1:
                inside = texts.longer(at, k)
                at, state = at[inside], state[inside]
            at, state = self.walk(at, state, symbol[at + (k - 1)], self.digits[1])
            out += np.bincount(state, minlength=len(out))
        ends = np.flatnonzero(self.accept >= 0)
        counts = np.zeros(len(ends), np.int64)
        counts[self.accept[ends]] = out[ends]
        return counts


class Frequent:
    """Filter over hashes, two bits for each in the bits of its bucket: it forgets none."""

    def __init__(self):
        self.bits = np.zeros(1 << (BUCKET_BITS + FILTER_BITS - 3), np.uint8)

    @staticmethod
    def places(codes: np.ndarray) -> list[np.ndarray]:
        """Bits of the hashes, from their buckets' first."""
        return [(codes >> np.uint64(shift) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for shift in (12, 0)]

    def has(self, codes: np.ndarray) -> np.ndarray:
        bucket = (codes >> np.uint64(HASH_BITS - BUCKET_BITS)).astype(np.int64) << FILTER_BITS
        out = np.ones(len(codes), bool)
        for at in self.places(codes):
            out &= (self.bits[(bucket | at) >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _each(batches, no_lang: str):
    for batch in batches:
        for lo, hi in slices(batch.column(1), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            yield Texts(part.column(0), part.column(1), no_lang)


def frequent_hashes(docs: DataFrame, settings: Settings) -> Frequent:
    """The hashes of phrases whose counts add up to `min_count` or more, over all texts."""
    import pyarrow as pa

    most, no_lang, buckets = settings.max_words, settings.no_lang, 1 << BUCKET_BITS
    borders = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(HASH_BITS - BUCKET_BITS)

    def run(batches):
        held = []

        def dealt():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            packed = codes << np.uint64(COUNT_BITS) | np.minimum(n, MOST).astype(np.uint64)
            cuts = np.searchsorted(codes, borders)
            some = np.flatnonzero(np.diff(cuts))
            # the first bytes of all, then the second ones: neighbours are alike and compress
            blocks = [packed[cuts[i] : cuts[i + 1]].view(np.uint8).reshape(-1, 8).T.tobytes() for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "block"])

        for texts in _each(batches, no_lang):
            held += [codes for _, _, codes in texts.codes(most)]
            if sum(map(len, held)) > HELD_CODES:
                yield dealt()
        if held:
            yield dealt()

    def marked(parts):
        """Bits of a bucket whose blocks are in `parts`."""
        packed = np.sort(np.concatenate(parts))
        codes = packed >> np.uint64(COUNT_BITS)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        often = np.add.reduceat(packed & np.uint64(MOST), first) >= settings.min_count
        bits = np.zeros(1 << FILTER_BITS, bool)
        for at in Frequent.places(codes[first[often]]):
            bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes() if often.any() else None

    def summed(batches):
        own, parts = None, []
        for batch in batches:
            done = []
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != own:
                    done += [(own, marked(parts))] if parts else []
                    own, parts = bucket, []
                parts.append(np.frombuffer(block.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.uint64)[:, 0])
            yield rows(done)
        if parts:
            yield rows([(own, marked(parts))])

    def rows(done):
        done = [x for x in done if x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], ["bucket", "bits"])

    # a bucket's blocks one after the other: a task holds one bucket at a time
    dealt = docs.mapInArrow(run, "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket")
    out, size = Frequent(), 1 << (FILTER_BITS - 3)
    found = dealt.mapInArrow(summed, "bucket int, bits binary").toArrow()
    for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits")):
        out.bits[bucket * size : (bucket + 1) * size] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def counted_phrases(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of `min_count` or more occurrences, and (lang, n) of all words.

    `docs` has the columns lang and text.
    """
    import pyarrow as pa

    most, no_lang = settings.max_words, settings.no_lang
    sent = docs.sparkSession.sparkContext.broadcast(frequent_hashes(docs, settings))

    def counted(held, found):
        langs, phrases = (found.column(c).combine_chunks() for c in ("lang", "phrase"))
        trie = Trie(langs, phrases)
        n = sum(trie.count(texts, trie.symbols, most) for texts in held)
        return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(n)], ["lang", "phrase", "f"])

    def run(batches):
        held, listed, rest, words = [], None, [], {}

        def distinct():
            return pa.concat_tables([*([] if listed is None else [listed]), *rest]).group_by(["lang", "phrase"]).aggregate([])

        for texts in _each(batches, no_lang):
            for name, n in zip(texts.langs, np.bincount(texts.lang, minlength=len(texts.langs)).tolist()):
                words[name] = words.get(name, 0) + n
            rest.append(texts.phrases(sent.value, most))
            texts.shrink()
            held.append(texts)
            full = sum(x.bytes for x in held) > HELD_BYTES
            if full or sum(map(len, rest)) > settings.shard_phrases // 2:
                listed, rest = distinct(), []
                if full or len(listed) > settings.shard_phrases:
                    yield counted(held, listed)
                    held, listed = [], None
        if held:
            yield counted(held, distinct())
        # rows without a phrase count all words
        columns = [pa.array(list(words), pa.string()), pa.nulls(len(words), pa.string()), pa.array(words.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    # dealt as they are: a trie has a phrase once
    counts = docs.mapInArrow(run, "lang string, phrase string, f long").repartition("lang", "phrase")
    sums = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    sums = stage(sums.where((F.col("f") >= settings.min_count) | F.col("phrase").isNull()), "phrases")
    sent.unpersist()
    return sums.where("phrase is not null"), sums.where("phrase is null and f > 0").select("lang", F.col("f").alias("n"))


def _joined(words: Column, first, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    a = f(phrase); a cut after its first words leaves two parts of l and r occurrences, and the
    cut with the smallest floor(1000000 a a / (l r)) gives the score (of equal ones the first).
    """
    docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts, totals = counted_phrases(docs, settings)
    words = F.split("phrase", " ")
    named = counts.withColumn("size", F.size(words)).where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    # a cut's parts are at least as frequent as the phrase, so both have been counted
    cuts = named.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", "a", "k", _joined(words, F.lit(1), F.col("k")).alias("left"), _joined(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    big = lambda name: F.col(name).cast("decimal(19,0)")
    scored = (
        cuts.join(part("left", "l"), ["lang", "left"])
        .join(part("right", "r"), ["lang", "right"])
        .withColumns({"_a": big("a"), "_l": big("l"), "_r": big("r")})
        .withColumn("score", F.expr("(_a * _a * 1000000) div (_l * _r)").cast("long"))
        .groupBy("lang", "phrase", "size", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _joined(words, i, n))))
    longer = (
        named.where("size >= 3")
        .select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longest"))
    )
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < settings.contained_percent * F.col("a")))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "part").orderBy(*order)
    parted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(settings.rank_parts)))
    parted = parted.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= settings.top)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= settings.top)
    long = lambda c: F.col(c).cast("long")
    return ranked.join(totals, "lang").select(
        "lang", long("rank").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
