"""Documents as token pieces packed into sequences: shortest pack first over the length histogram.

Every document is tokenized, closed with an end id and cut into full pieces and a rest. Only
the histogram of piece lengths, at most `length` numbers, goes to the driver. There lengths are
placed longest first into the emptiest open pack that has room, many equal packs at once, so
the plan is a table of patterns and how often each is used. Pieces then find their place in it
by their rank among the pieces of their length.

A sequence is padded to `length`, or not at all where what it holds is a power of two.

Null and empty texts hold the end id alone. Rows without a doc_id and rows that repeat are
documents like others; between equal ones ranks may change places, which no result shows.
Ties in length go by the columns `order`. Texts of any length are read whole. Extra columns
named like a result column are replaced by it. Empty tables give empty tables.
"""

from __future__ import annotations

import json
import string
import zlib
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import stage, with_row_number
from .word_arrays import byte_kinds, slices, split_words

LENGTH = 2048
END_ID = 1
#: Text is cut at these before encoding; no token of the vocabulary spans one.
SPACES = byte_kinds(b"\t\n\x0b\x0c\r ")
#: Fixed value: a pattern of pre-tokens under which letters, digits and marks never share one
#: but for apostrophes, and a digit stands alone.
LETTERS_DIGITS_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SLICE_BYTES = 8 << 20
#: encoded words a worker remembers, some 200 bytes each
KNOWN_WORDS = 1 << 18


def read_vocabulary(path: str) -> str:
    """A tokenizer file of the driver's own installation; tasks get its text (a few MB) by broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@lru_cache(maxsize=1)
def _tokenizer(vocabulary: str):
    """Tokenizer, cuts and known words of a worker; tasks of one vocabulary share them."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary), inner_cuts(vocabulary), {}


def inner_cuts(vocabulary: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Where runs of non-space ASCII characters may be cut without changing a token.

    Only between letters, digits and marks, and only under the pattern above. Bytes that are
    not ASCII, apostrophes and the characters of added tokens are never cut at.
    """
    told = json.loads(vocabulary)
    if LETTERS_DIGITS_MARKS not in json.dumps(told.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\"):
        return None
    letter, digit, mark, other = range(4)
    group = np.full(256, other)
    marks = set(string.punctuation) - set("'") - {c for t in told.get("added_tokens", ()) for c in t["content"]}
    for members, g in ((string.ascii_letters, letter), (string.digits, digit), (marks, mark)):
        group[[ord(c) for c in members]] = g
    cut = np.zeros((4, 4), bool)
    cut[:other, :other] = ~np.eye(other, dtype=bool)
    cut[digit, digit] = True
    return group, cut


def encode(
    texts, tokenizer, end_id: int = END_ID, cuts: tuple[np.ndarray, np.ndarray] | None = None, known: dict[bytes, bytes] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text closed with `end_id`, and where each text ends.

    Each distinct run of non-space characters, or part of one between `cuts`, is encoded once;
    `known` carries up to `KNOWN_WORDS` of them from call to call.
    """
    words = split_words(texts, SPACES, cuts=cuts)
    distinct = words.dictionary.to_pylist()
    known = {} if known is None else known
    new = [w for w in distinct if w not in known]
    fresh = tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
    found = dict(zip(new, (array("I", e.ids).tobytes() for e in fresh)))
    encoded = [found[w] if w in found else known[w] for w in distinct] + [array("I", [end_id]).tobytes()]
    known.update(islice(found.items(), max(0, KNOWN_WORDS - len(known))))
    size = np.array([len(e) // 4 for e in encoded], np.int64)
    flat = np.frombuffer(b"".join(encoded), np.uint32)
    begin = np.cumsum(size) - size
    per_row = np.bincount(words.row, minlength=words.rows)
    # the words of all rows, with one end marker behind each row's
    codes = np.empty(len(words.code) + words.rows, np.int64)
    codes[np.arange(len(words.code)) + words.row] = words.code
    closing = np.cumsum(per_row) + np.arange(words.rows)
    codes[closing] = len(encoded) - 1
    own = size[codes]
    done = np.cumsum(own)
    ids = flat[np.repeat(begin[codes] - (done - own), own) + np.arange(done[-1] if len(done) else 0)]
    return ids, done[closing]


def token_pieces(docs: DataFrame, vocabulary: str, text: str = "text", length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: the columns of `docs` but the text, start, length, doc_tokens, ids_crc32, ids.

    start counts the document's ids before the piece, doc_tokens all its ids with the end id;
    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers. `ids` can be left out.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    own = ["start", "length", "doc_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    rest = [c for c in docs.columns if c != text and c not in own]
    fields = [f for f in docs.schema.fields if f.name in rest]
    fields += [T.StructField(c, T.ArrayType(T.LongType()) if c == "ids" else T.LongType()) for c in own]

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, cuts, known = _tokenizer(sent.value)
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, ends = encode(part.column(0), tokenizer, end_id, cuts, known)
                begins = np.r_[0, ends[:-1]] if len(ends) else ends
                pieces = -(-(ends - begins) // length)
                row = np.repeat(np.arange(len(ends)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(length, (ends - begins)[row] - start)
                at = begins[row] + start
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at, size)]
                columns = [part.column(1 + i).take(pa.array(row)) for i in range(len(rest))]
                columns += [pa.array(start), pa.array(size), pa.array((ends - begins)[row]), pa.array(crc, pa.int64())]
                if keep_ids:
                    offsets = pa.array(np.append(at, len(ids)).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, [*rest, *own])

    return docs.select(text, *rest).mapInArrow(run, T.StructType(fields))


def shortest_pack_first(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in the order they lie in) and how many sequences follow each.

    Lengths are placed longest first; each goes to the open packs with the most room left, as
    many at once as there are equal ones, and opens new packs only where no room is left. One
    length splits at most one group of equal packs, so there are at most 2 x `length` patterns.
    """
    # room -> packs with that room; a pack is a chain (last length, how often, what lies before)
    room: list[list[tuple[tuple, int]]] = [[] for _ in range(length + 1)]
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        if not 0 < size <= length:
            raise ValueError(f"a piece of {size} does not fit sequences of {length}")
        left = counts[size]
        # packs only lose room while one length is placed, so the emptiest ones are found going down
        for widest in range(length, size - 1, -1):
            packs = room[widest]
            while packs and left:
                chain, n = packs.pop()
                taken = min(n, left)
                if taken < n:
                    packs.append((chain, n - taken))
                last, times, before = chain
                longer = (last, times + 1, before) if last == size else (size, 1, chain)
                room[widest - size].append((longer, taken))
                left -= taken
            if not left:
                break
        if left:
            # whole packs of this length alone: the first placed opens one, the next fill it up
            each = length // size
            full, rest = divmod(left, each)
            for times, n in ((each, full), (rest, 1)):
                if times and n:
                    room[length - size * times].append(((size, times, None), n))
    out = []
    for packs in room:
        for chain, n in packs:
            lengths: list[int] = []
            while chain:
                lengths += [chain[0]] * chain[1]
                chain = chain[2]
            out.append((tuple(lengths[::-1]), n))
    return out


def pack(pieces: DataFrame, order: Sequence[str], length: int = LENGTH) -> DataFrame:
    """`pieces` with sequence_id and offset, by their column `length`.

    `order` names columns that tell pieces of one length apart; they make reruns agree. The
    plan is a table of at most 2 x `length` patterns times the distinct lengths of one (no
    more than 64, as they add up to `length`), whatever the number of pieces.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, at_sequence = [], 0
    for lengths, n in shortest_pack_first(counts, length):
        offset = 0
        for size in dict.fromkeys(lengths):
            times = lengths.count(size)
            slots.append((size, n * times, times, at_sequence, offset))
            offset += size * times
        at_sequence += n
    # places in the order of lengths, as the pieces are numbered: a slot holds the next n * times
    slots.sort(key=lambda slot: slot[0])
    table = np.array(slots, np.int64).reshape(-1, 5)
    ends = np.cumsum(table[:, 1])
    sent = spark.sparkContext.broadcast((ends, ends - table[:, 1], *table[:, [0, 2, 3, 4]].T))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(number):
        import pyarrow as pa

        ends, firsts, size, times, sequence, at = sent.value
        k = number.to_numpy(zero_copy_only=False) - 1
        slot = np.searchsorted(ends, k, "right")
        k = k - firsts[slot]
        columns = [sequence[slot] + k // times[slot], at[slot] + k % times[slot] * size[slot]]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["sequence_id", "offset"])

    name = "_number"
    while name in pieces.columns:
        name += "_"
    numbered = with_row_number(pieces, F.col("length"), *[F.col(c).asc_nulls_first() for c in order], name=name)
    placed = numbered.withColumn(name, place(F.col(name).cast("long")))
    return placed.select(*pieces.columns, f"{name}.sequence_id", f"{name}.offset")


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_ids and the padded ids of every sequence; at most `length` ids a group."""
    own = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_ids"))
    ids = F.flatten(F.col("p.ids"))
    power = F.expr("bit_count(n_ids) = 1")
    return own.select("sequence_id", "n_ids", F.when(power, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), (F.lit(length) - F.col("n_ids")).cast("int")))).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = True, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs` (doc_id, text) with their place in a sequence."""
    pieces = stage(token_pieces(docs, vocabulary, length=length, end_id=end_id, keep_ids=keep_ids), "pieces")
    return pack(pieces, ["doc_id", "start", "doc_tokens", "ids_crc32"], length)
