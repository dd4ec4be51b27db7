"""Language ID by fusing evidence in Bayes' way.

A document's posterior over languages joins the likelihood of its text under byte-trigram
profiles, how likely each language is declared as it was (metadata or markup), the suffix of
its address, and the prior of its host. Profiles, declaration tables and priors are counted
over all rows by grouped aggregation; a host's prior is smoothed towards its domain's, and
that towards the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import stage
from .common import LOWER

EVIDENCE = ("lang", "markup", "suffix")


@dataclass(frozen=True)
class Settings:
    """Languages hold at least `language_share` of the declared rows and a table's values
    `value_share` of all rows, so tables have a fixed size bound. A text counts as at most
    `saturation` independent trigrams. It is rejected when its best language has less than
    `min_confidence`, or when a text of at least `min_trigrams` has a fit of more than
    `max_misfit` deviations, for its length, below that language's. For that, `unit`
    trigrams in a row (a word, a part of a number) count as one, and texts of a language (shouted
    or full of symbols, say) differ from each other like samples of `document_units`."""

    log_size: int = 15
    language_share: float = 0.01
    value_share: float = 0.001
    saturation: float = 200.0
    smoothing: float = 20.0
    min_confidence: float = 0.5
    max_misfit: float = 8.0
    min_trigrams: int = 1
    unit: float = 4.0
    document_units: float = 50.0


def _trigrams(text: bytes | None, log_size: int) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text (A-Z), white space runs as they are."""
    b = np.frombuffer((text or b"").translate(LOWER), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    x = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (x >> np.uint32(32 - log_size)).astype(np.int64)


def profiles(docs: DataFrame, s: Settings) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram shares, counted over the texts of all rows that declare one."""
    declared = docs.where("lang is not null and text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    every = declared.agg(F.sum("n")).first()[0] or 0
    large = declared.where(F.col("n") >= every * s.language_share).select("lang")
    langs = sorted(r[0] for r in large.collect())  # at most 1 / language_share
    if not langs:
        return [], np.zeros((0, 1 << s.log_size), np.float32)
    size = 1 << s.log_size

    def count(batches):
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = _trigrams(text, s.log_size)
                if lang not in own:
                    own[lang] = np.zeros(size, np.int64)
                if len(at) > size // 8:
                    own[lang] += np.bincount(at, minlength=size)
                else:
                    np.add.at(own[lang], at, 1)
        for lang, n in own.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "place", "n"])

    rows = docs.where(F.col("lang").isin(langs)).select("lang", F.col("text").cast("binary"))
    counts = rows.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most 2 ** log_size rows per language
    n = np.full((len(langs), size), 0.5)
    row = {lang: i for i, lang in enumerate(langs)}
    for i, lang in enumerate(got.column(0).to_pylist()):
        n[row[lang], got.column(1)[i].as_py()] += got.column(2)[i].as_py()
    return langs, np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def text_fit(docs: DataFrame, table: np.ndarray, s: Settings) -> Column:
    """struct<n, fit>: trigrams of the text and its mean log likelihood per language."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("struct<n: bigint, fit: array<double>>")
    def fitted(texts: pa.Array) -> pa.Array:
        table = sent.value
        n, fits = [], []
        for text in texts.to_pylist():
            at = _trigrams(text, s.log_size)
            n.append(len(at))
            fits.append([float(p[at].mean(dtype=np.float64)) for p in table] if len(at) else [0.0] * len(table))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fits, pa.list_(pa.float64()))], ["n", "fit"])

    return fitted(F.col("text").cast("binary"))


def _vector(langs: list[str], of) -> Column:
    return F.array(*[of(i) for i in range(len(langs))])


def _likelihoods(scored: DataFrame, column: str, langs: list[str], s: Settings) -> DataFrame:
    """(value, log P(value | language) per language) for the frequent values of an evidence column."""
    counts = scored.where(F.col(column).isNotNull() & F.col("best").isNotNull()).groupBy(column)
    counts = counts.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("best") == i).alias(f"n{i}") for i in range(len(langs))])
    totals = counts.agg(F.sum("n"), *[F.sum(f"n{i}") for i in range(len(langs))]).first()
    every, per = totals[0] or 0, [t or 0 for t in totals[1:]]
    base = F.col("n") / F.lit(float(every or 1))
    logs = _vector(langs, lambda i: F.log((F.col(f"n{i}") + s.smoothing * base) / (per[i] + s.smoothing)) - F.log(base))
    joined = counts.where(F.col("n") >= every * s.value_share)
    return joined.select(column, logs.alias(f"{column}_evidence"))


def _prior(scored: DataFrame, langs: list[str], s: Settings) -> DataFrame:
    """(host, log prior per language): host counts smoothed to the domain's, those to the corpus's."""
    rows = scored.where("best is not null and host is not null")
    n = [F.count_if(F.col("best") == i).alias(f"n{i}") for i in range(len(langs))]
    hosts = rows.groupBy("host", "domain").agg(F.count(F.lit(1)).alias("n"), *n)
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), *[F.sum(f"n{i}").alias(f"d{i}") for i in range(len(langs))])
    every = domains.agg(F.sum("dn"), *[F.sum(f"d{i}") for i in range(len(langs))]).first()
    total, per = every[0] or 0, [x or 0 for x in every[1:]]
    joined = hosts.join(domains, hosts.domain.eqNullSafe(domains.domain)).drop("domain")
    k, m = s.smoothing, len(langs)
    mid = lambda i: (F.col(f"d{i}") + k * (per[i] + 1.0) / (total + m)) / (F.col("dn") + k)
    own = _vector(langs, lambda i: F.log((F.col(f"n{i}") + k * mid(i)) / (F.col("n") + k)))
    return joined.select("host", own.alias("prior"))


def identify(docs: DataFrame, settings: Settings | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """doc_id, language, confidence, kept and misfit for every row of `docs`.

    Columns read: doc_id, text, lang (declared), and where present markup (language declared
    in the page), suffix and host of its address and the host's domain; a null in any of them
    is no evidence. `evidence` holds such columns for some doc_ids (one row each) and is
    joined after the texts have been scored, so texts are not shuffled. A text of under three bytes, or null, has no language (`und`) and is not
    kept, nor is one that fits no profile. Repeated rows get equal results; other columns are
    not read; without declared languages all rows are `und`; an empty table gives none.
    """
    s = settings or Settings()
    have = [c for c in (*EVIDENCE, "host", "domain") if c in docs.columns]
    docs = docs.select("doc_id", "text", *have)
    for c in {*EVIDENCE, "host", "domain"} - set(have):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    langs, table = profiles(docs, s)
    if not langs:
        none = docs.select("doc_id", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
        return none.withColumn("misfit", F.lit(None).cast("double"))
    fit = docs.select("doc_id", *EVIDENCE, "host", "domain", text_fit(docs, table, s).alias("t"))
    best = F.when(F.col("t.n") > 0, F.array_position("t.fit", F.array_max("t.fit")).cast("int") - 1)
    scored = stage(fit.select("doc_id", *EVIDENCE, "host", "domain", "t.n", "t.fit", best.alias("best")), "fit")
    if evidence is not None:
        more = [c for c in evidence.columns if c != "doc_id"]
        scored = stage(scored.drop(*more).join(evidence, "doc_id", "left").select(scored.columns), "evidence")
    return fuse(scored, langs, table, s)


def _independent(most: float, unit: float = 1.0) -> Column:
    """Independent units of so many trigrams a text counts as."""
    return F.col("n") / (unit + F.col("n") / most)


def _spread(scored: DataFrame, langs: list[str], table: np.ndarray, s: Settings) -> DataFrame:
    """(best, centre, sd) per language: what its texts fit, and the deviation of one unit.

    Median and MAD over the texts that declare the language they fit best, so no number of
    undeclared texts moves them. The profile's own mean and deviation stand in where there is
    no such text; its deviation is the least, as copies of one text do not vary.
    """
    p = np.exp(table.astype(np.float64))
    mean = (p * table).sum(1)
    sd = np.sqrt(np.maximum((p * table.astype(np.float64) ** 2).sum(1) - mean**2, 0))
    rows = [(i, float(mean[i]), float(sd[i])) for i in range(len(langs))]
    own = scored.sparkSession.createDataFrame(rows, "best int, mean double, least double")
    top = F.array_max("fit")
    names = F.array(*[F.lit(x) for x in langs])
    agree = scored.where((F.col("n") >= s.min_trigrams) & (F.col("lang") == F.get(names, F.col("best"))))
    agree = agree.select("best", "n", top.alias("top"))
    centre = agree.groupBy("best").agg(F.percentile_approx("top", 0.5).alias("median"))
    far = F.abs(F.col("top") - F.col("median")) * F.sqrt(_independent(s.document_units, s.unit))
    mad = agree.join(F.broadcast(centre), "best").groupBy("best").agg(F.percentile_approx(far, 0.5).alias("mad"))
    found = own.join(centre, "best", "left").join(mad, "best", "left")
    return found.select(
        "best", F.coalesce("median", "mean").alias("centre"), F.greatest(1.4826 * F.col("mad"), F.col("least")).alias("sd")
    )


def fuse(scored: DataFrame, langs: list[str], table: np.ndarray, s: Settings) -> DataFrame:
    """Posterior and verdict from scored rows (doc_id, evidence, host, domain, n, fit, best)."""
    top = F.array_max("fit")
    out = scored.join(F.broadcast(_spread(scored, langs, table, s)), "best", "left")  # one row per language
    logs = F.transform("fit", lambda x: x * _independent(s.saturation))
    for c in EVIDENCE:
        # at most 1 / value_share rows
        out = out.join(F.broadcast(_likelihoods(scored, c, langs, s)), c, "left")
        logs = F.zip_with(logs, F.coalesce(f"{c}_evidence", F.array_repeat(F.lit(0.0), len(langs))), lambda a, b: a + b)
    out = out.join(_prior(scored, langs, s), "host", "left")
    logs = F.zip_with(logs, F.coalesce("prior", F.array_repeat(F.lit(0.0), len(langs))), lambda a, b: a + b)
    out = out.withColumn("logs", logs).withColumn("peak", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("peak")))
    out = out.withColumn("confidence", F.when(F.col("n") > 0, 1 / total).otherwise(0.0))
    names = F.array(*[F.lit(x) for x in langs])
    guess = F.element_at(names, F.array_position("logs", F.col("peak")).cast("int"))
    misfit = F.when((F.col("n") >= s.min_trigrams) & (F.col("sd") > 0), (F.col("centre") - top) * F.sqrt(_independent(s.document_units, s.unit)) / F.col("sd"))
    sure = (F.col("n") > 0) & (F.col("confidence") >= s.min_confidence) & ~F.coalesce(misfit > s.max_misfit, F.lit(False))
    return out.select(
        "doc_id",
        F.when(F.col("n") > 0, guess).otherwise("und").alias("language"),
        "confidence",
        sure.alias("kept"),
        misfit.alias("misfit"),
    )
