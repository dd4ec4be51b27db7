"""Token counts that follow edits.

Every document keeps a segment tree over its pre-tokens: a leaf holds the length and the
token count of some pre-tokens in a row, an inner node the sums below it. After an edit only
the leaves it touches, with the boundary context that could change their splitting, are
encoded again; their sums go up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens of one leaf.
LEAF = 32
#: A pre-token is chosen by looking at most this far past its end.
LOOK_AHEAD = 2
TREE = "struct<chars: array<int>, tokens: array<int>>"
EDITS = "array<struct<start: int, end: int, text: string>>"
COUNTS = "struct<n_before: bigint, n_after: bigint, n_edits: int, chars_before: bigint, chars_after: bigint, chars_encoded: bigint>"
#: Fixed value: how the byte-level vocabulary splits a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary file (base64 token and rank per line).

    A vocabulary has some 10 ** 5 lines. A path without a scheme is a file of the driver's.
    """
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class Tokenizer:
    """Splits texts into pre-tokens and counts the tokens of each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.encoding)

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.known.__getitem__, pieces))


class _Known(dict):
    """Token counts of pre-tokens seen; emptied when it has grown large."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        if len(self) > 400_000:
            self.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) < 64:
            self[piece] = n
        return n


class SegmentTree:
    """Sums of (chars, tokens) over leaves, in two arrays of 2 * size nodes with the root at 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2

    @classmethod
    def of(cls, leaves: list[tuple[int, int]]) -> "SegmentTree":
        size = 1
        while size < len(leaves):
            size *= 2
        pad = [0] * (size - len(leaves))
        chars = [0] * size + [c for c, _ in leaves] + pad
        tokens = [0] * size + [t for _, t in leaves] + pad
        for i in range(size - 1, 0, -1):
            chars[i] = chars[2 * i] + chars[2 * i + 1]
            tokens[i] = tokens[2 * i] + tokens[2 * i + 1]
        return cls(chars, tokens)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first char) of the leaf that holds char `place`; the last one with chars past the end."""
        place = min(place, self.chars[1] - 1)
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if place >= begin + self.chars[i]:
                begin += self.chars[i]
                i += 1
        return i - self.size, begin

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2


def build(text: str, tok: Tokenizer, leaf: int = LEAF) -> SegmentTree:
    pieces = tok.split.findall(text)
    counts = tok.counts(pieces)
    sizes = list(map(len, pieces))
    return SegmentTree.of([(sum(sizes[i : i + leaf]), sum(counts[i : i + leaf])) for i in range(0, len(pieces), leaf)])


def ordered(edits: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, str]]:
    """Edits in text order, cut to the text; one that begins inside an earlier one is left out."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        start, end = max(0, min(start, length)), max(0, min(end, length))
        if start >= at and end >= start:
            out.append((start, end, new))
            at = max(end, at)
    return out


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def apply_edits(text: str, tree: SegmentTree, edits: list[tuple[int, int, str]], tok: Tokenizer) -> tuple[str, int]:
    """Bring `tree` up to date with the edits of its text; returns the new text and how many of
    its chars were encoded again."""
    edits = ordered(edits, len(text))
    new = edited(text, edits)
    if not edits:
        return new, 0
    if not text:
        fresh = build(new, tok)
        tree.chars, tree.tokens, tree.size = fresh.chars, fresh.tokens, fresh.size
        return new, len(new)
    updates, done, encoded = [], 0, 0
    gains = [0]
    for start, end, own in edits:
        gains.append(gains[-1] + len(own) - (end - start))

    def old_place(place: int, k: int) -> int:
        """Place in the old text of a place in the new text after k edits."""
        return place - gains[k]

    i = 0
    while i < len(edits):
        # leaves whose pre-tokens may have looked at the edit begin here
        first, begin = tree.leaf_at(max(0, edits[i][0] - LOOK_AHEAD))
        if begin and begin > edits[i][0] - LOOK_AHEAD:
            first, begin = tree.leaf_at(begin - 1)
        last, end_of_last = first, begin + tree.chars[first + tree.size]
        place, pieces, k = begin + gains[i], [], i + 1
        for m in tok.split.finditer(new, place):
            pieces.append(m.group())
            # edits that begin before this place (with look-ahead) belong to the region
            while k < len(edits) and old_place(m.end(), k) + LOOK_AHEAD >= edits[k][0]:
                k += 1
            old = old_place(m.end(), k)
            if old < edits[k - 1][1]:
                continue
            while end_of_last < old and last + 1 < tree.size:
                last += 1
                end_of_last += tree.chars[last + tree.size]
            if end_of_last == old:
                break
        else:
            last, k = tree.size - 1, len(edits)
        size = sum(map(len, pieces))
        encoded += size
        updates.append((first, last, size, sum(tok.counts(pieces))))
        i = k
    for first, last, size, tokens in updates:
        tree.set(first, size, tokens)
        for leaf in range(first + 1, last + 1):
            if tree.chars[leaf + tree.size]:
                tree.set(leaf, 0, 0)
    return new, encoded


# --- tables and columns ---------------------------------------------------------------------------------


def tree_column(spark: SparkSession, ranks: dict[bytes, int], text: Column) -> Column:
    """Segment tree of each text, in the layout of `TREE`; one empty leaf for null and empty texts."""
    sent = _sent(spark, ranks)

    @F.arrow_udf(TREE)
    def trees(texts: pa.Array) -> pa.Array:
        tok = _tokenizer(sent)
        own = [build(t or "", tok) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([t.chars for t in own], pa.list_(pa.int32())), pa.array([t.tokens for t in own], pa.list_(pa.int32()))], ["chars", "tokens"]
        )

    return trees(text)


_TOKENIZERS: dict[bytes, Tokenizer] = {}


def _sent(spark: SparkSession, ranks: dict[bytes, int]):
    """Broadcast of a vocabulary with a digest of all of it."""
    whole = hashlib.blake2b(digest_size=16)
    for token, rank in ranks.items():
        whole.update(b"%d %d " % (rank, len(token)) + token)
    return spark.sparkContext.broadcast((whole.digest(), ranks))


def _tokenizer(sent) -> Tokenizer:
    """One tokenizer per worker process and vocabulary."""
    key, ranks = sent.value
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(ranks)
    return _TOKENIZERS[key]


def recount_column(spark: SparkSession, ranks: dict[bytes, int], text: Column, tree: Column, edits: Column) -> Column:
    """Counts after edits, from the tree of the text before them: `COUNTS`.

    chars_encoded is how much of the new text was encoded again. A null text is empty, null
    edits are none; edits are cut to the text and those that overlap an earlier one left out.
    """
    sent = _sent(spark, ranks)

    @F.arrow_udf(COUNTS)
    def recount(texts: pa.Array, trees: pa.Array, edits: pa.Array) -> pa.Array:
        tok = _tokenizer(sent)
        rows = []
        for t, tr, es in zip(texts.to_pylist(), trees.to_pylist(), edits.to_pylist()):
            t = t or ""
            own = SegmentTree(tr["chars"], tr["tokens"]) if tr else build(t, tok)
            before = own.total
            new, encoded = apply_edits(t, own, [(e["start"], e["end"], e["text"] or "") for e in es or ()], tok)
            rows.append((before, own.total, len(ordered([(e["start"], e["end"], "") for e in es or ()], len(t))), len(t), len(new), encoded))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["n_before", "n_after", "n_edits", "chars_before", "chars_after", "chars_encoded"]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return recount(text, tree, edits)


#: What a redaction replaces: addresses, phone and card numbers, and keys.
REDACTED = regex.compile(
    r"(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ip>\b\d{1,3}(?:\.\d{1,3}){3}\b)"
    r"|(?P<key>\b[0-9a-f]{32,}\b)"
    r"|(?P<number>\+?\(?\d[\d ()-]{8,}\d)"
)


def redactions(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits that put a placeholder for personal data and secrets."""
    for m in REDACTED.finditer(text):
        yield m.start(), m.end(), f"<{m.lastgroup}>"


def redaction_column(text: Column) -> Column:
    """Redactions of a text as `EDITS`; none for null and empty texts."""

    @F.arrow_udf(EDITS)
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        return pa.array([[{"start": a, "end": b, "text": c} for a, b, c in redactions(t or "")] for t in texts.to_pylist()], kind)

    return found(text)


def edit_aware_counts(docs: DataFrame, ranks: dict[bytes, int], edits: Column | None = None) -> DataFrame:
    """doc_id with the fields of `COUNTS` for every row of `docs` (doc_id, text).

    Counts each text once, keeps its tree, then applies `edits` (by default the redaction of
    personal data and secrets) and counts again from the tree. A null or empty text has 0
    tokens and no edits of its own. Repeated rows are documents of their own; other columns
    are read by `edits` only; an empty table gives an empty result; long texts are whole.
    """
    spark = docs.sparkSession
    edits = redaction_column(F.col("text")) if edits is None else edits
    kept = docs.select("doc_id", "text", tree_column(spark, ranks, F.col("text")).alias("tree"), edits.alias("edits"))
    counted = kept.select("doc_id", recount_column(spark, ranks, F.col("text"), F.col("tree"), F.col("edits")).alias("c"))
    return counted.select("doc_id", "c.*")
