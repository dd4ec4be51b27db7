"""Small helpers shared by the operators: tables, words, and a Bloom filter of fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = "[ \\t-\\r]+"
#: Bytes with A-Z lower-cased; the second table also turns every ASCII non-word byte into a space.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
ALNUM = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null or blank texts."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), "^[ \\t-\\r]+|[ \\t-\\r]+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def word_count(text: Column) -> Column:
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), "^[ \\t-\\r]+|[ \\t-\\r]+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, WORD_GAP))).cast("long")


class Bloom:
    """Set of longs in `2 ** log_bits` bits: no false negatives, a few false positives.

    The size is fixed by the parameter, so it can be broadcast whatever the input; when the
    set outgrows it, more rows pass and the exact join behind it does more of the work.
    """

    def __init__(self, words: np.ndarray, log_bits: int):
        self.words, self.log_bits = words, log_bits

    @staticmethod
    def _places(keys: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
        a = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(29)
        b = a * np.uint64(0xBF58476D1CE4E5B9)
        return a >> np.uint64(64 - log_bits), b >> np.uint64(64 - log_bits)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.int64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys.view(np.uint64) if keys.dtype == np.int64 else keys, self.log_bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame, log_bits: int) -> "Bloom":
        """Filter over the single long column of `keys`; at most 2 ** (log_bits - 6) rows reach the driver."""
        import pyarrow as pa

        def mark(batches):
            for batch in batches:
                own = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.concatenate(cls._places(own.view(np.uint64), log_bits))
                slot = (at >> np.uint64(6)).astype(np.int64)
                bit = np.uint64(1) << (at & np.uint64(63))
                order = np.argsort(slot, kind="stable")
                slot, bit = slot[order], bit[order]
                first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
                merged = np.bitwise_or.reduceat(bit, first) if len(slot) else bit
                yield pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(merged.view(np.int64))], ["slot", "bits"])

        merged = keys.mapInArrow(mark, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
        got = merged.toArrow()
        words = np.zeros(1 << (log_bits - 6), np.uint64)
        words[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return cls(words, log_bits)
