"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The learner keeps a learning rate per coordinate and an L1 term that leaves most weights at
exactly zero, so what is broadcast for scoring is a short list of (place, weight).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM


@dataclass(frozen=True)
class Settings:
    """`max_rows` bounds the labelled rows the model is fitted on; they are those with the
    smallest hash of doc_id, taken whole. Scoring reads every row."""

    max_rows: int = 20_000
    epochs: int = 3
    log_size: int = 20
    alpha: float = 0.7
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    threshold: float = 0.3


class _Hashes(dict):
    """Hash of each word seen; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = (zlib.crc32(word) << 20) ^ zlib.adler32(word)
        return value


_HASHES = _Hashes()
_KINDS = [(0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)]


def _word_hashes(text: bytes | None) -> np.ndarray:
    words = text.translate(ALNUM).split() if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _features(h: np.ndarray, log_size: int):
    """(first word, place) arrays: words, word pairs, and pairs with one word between them."""
    for gap, k in _KINDS:
        x = h[: len(h) - gap] if gap else h
        x = x * np.uint64(k)
        if gap:
            x = (x ^ (x >> np.uint64(31))) + h[gap:] * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        yield gap, (x >> np.uint64(64 - log_size)).astype(np.int64)


class Ftrl:
    """The learner; one sweep over rows, one update per row."""

    def __init__(self, s: Settings):
        self.s = s
        self.z = np.zeros((1 << s.log_size) + 1)
        self.n = np.zeros((1 << s.log_size) + 1)

    def weights(self, at) -> np.ndarray:
        s, z = self.s, self.z[at]
        w = (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) > s.l1, w, 0.0)

    def learn(self, places: np.ndarray, y: float) -> None:
        w = self.weights(places)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[places] = n + g * g


@dataclass
class Model:
    """Non-zero weights by place; the last place is the constant. Without rows to learn from
    it is empty and every score is 0."""

    places: np.ndarray
    values: np.ndarray
    settings: Settings
    fitted: bool


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Model of `labels` (doc_id, toxic) over the texts of `docs` (doc_id, text).

    Labels that are null are left out; a doc_id labelled on several rows counts as toxic if
    one of them says so. Rows of `docs` that repeat a doc_id are learned one by one.
    """
    s = settings or Settings()
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.withColumn("k", F.md5(F.col("doc_id").cast("string"))).orderBy("k", "doc_id").limit(s.max_rows)
    # at most max_rows narrow rows
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.select("k", "text", F.col("y").cast("double").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(s.epochs))).alias("epoch"))
    # bounded by max_rows, so one task may hold the learner
    rows = rows.repartition(1).sortWithinPartitions("epoch", "k", "text").select("text", "y")

    def learn(batches):
        model, any_row = Ftrl(s), False
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [p for _, p in _features(_word_hashes(text), s.log_size)]
                model.learn(np.unique(np.concatenate([*parts, [1 << s.log_size]])), y)
                any_row = True
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        if any_row:
            at = np.union1d(at, [1 << s.log_size])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], ["place", "weight"])

    got = rows.mapInArrow(learn, "place long, weight double").toArrow()
    places, values = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(places)
    return Model(places[order], values[order], s, len(places) > 0)


def score(docs: DataFrame, model: Model, text: Column | None = None) -> Column:
    """Probability (double, 0 to 1) that a text is toxic.

    A null or empty text has the constant only, so it scores near the share of toxic rows.
    The whole text counts, each feature once however often it occurs.
    """
    text = F.col("text") if text is None else text
    if not model.fitted:
        return F.lit(0.0)
    sent = docs.sparkSession.sparkContext.broadcast((model.places, model.values.astype(np.float32), model.settings.log_size))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        places, values, log_size = sent.value
        dense = np.zeros((1 << log_size) + 1, np.float32)
        dense[places] = values
        out = np.full(len(texts), float(dense[-1]))
        chunk, own, size = [], [], 0

        def flush():
            if not chunk:
                return
            h = np.concatenate(chunk)
            doc = np.repeat(np.array(own), [len(c) for c in chunk])
            for gap, at in _features(h, log_size):
                hit = np.flatnonzero(dense[at])
                if gap:
                    hit = hit[doc[hit] == doc[hit + gap]]
                pair = np.unique((doc[hit] << 32) | at[hit])
                np.add.at(out, pair >> 32, dense[pair & 0xFFFFFFFF])

        for k, t in enumerate(texts.to_pylist()):
            h = _word_hashes(t)
            if len(h):
                chunk.append(h)
                own.append(k)
                size += len(h)
            if size > 200_000:
                flush()
                chunk, own, size = [], [], 0
        flush()
        return pa.array(1 / (1 + np.exp(-out)))

    return scored(text.cast("binary"))


def held_out(doc_id: Column) -> Column:
    """True for the fold kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs` (doc_id, text).

    Learns from labelled rows outside the held-out fold only. A null doc_id is not held out
    and has no label; repeated rows score alike; other columns are not read; without labels
    all scores are 0; an empty table gives an empty result.
    """
    s = settings or Settings()
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), s)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))
