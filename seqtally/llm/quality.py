"""Quality rules: base counts, then divergence of a document from its language's reference.

A reference holds, over all documents of a language, how characters fall into classes and
how often each of its common words occurs. A document whose histograms are far from it (by
Jensen-Shannon distance) is not kept; short documents are spared, as their histograms say
little. Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import stage
from .common import words_of

REPEAT_WINDOW = 8
SYMBOLS = "[#*$%&|<>]+"
#: Removed in turn to count the characters of a class; all other characters are "letter".
CLASSES = {"digit": "[0-9]+", "upper": "\\p{Lu}+", "punctuation": "[!-/:-@\\[-`{-~]+"}


@dataclass(frozen=True)
class Rules:
    """Thresholds of the verdict.

    A reference language holds at least `language_share` of all words and a common word
    `word_share` of its language's, so there are at most 1 / language_share lists of at most
    1 / word_share words: few enough to broadcast for any input.
    """

    language_share: float = 0.01
    word_share: float = 0.005
    min_words: int = 50
    min_chars: int = 200
    max_class_distance: float = 0.24
    max_word_distance: float = 0.315


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the words `_w` and the base counts of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", text.alias("_t")).withColumn("_w", words_of(F.col("_t")))
    n = F.size("_w")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    windows = F.when(
        n >= REPEAT_WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - REPEAT_WINDOW),
            lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(REPEAT_WINDOW)]),
        ),
    )
    chars = F.length("_t")
    df = df.select(
        "doc_id", "lang", "_w",
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        lines.alias("_lines"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (chars - _length_without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        chars.alias("_chars"),
        *[(chars - _length_without(F.col("_t"), p)).alias(f"_{c}") for c, p in CLASSES.items()],
    )
    dup = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    df = df.withColumn("n_dup_lines", dup).drop("_lines").withColumn("_win", windows).drop("_h")
    # only a text with a repeated window is sorted: equal windows become neighbours
    repeated = F.size(F.array_distinct("_win")) < F.size("_win")
    df = df.withColumn("_s", F.when(repeated, F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.drop("_win")

    def twin(x, k):
        return (x["h"] == F.get("_s", k + 1)["h"]) | ((k > 0) & (x["h"] == F.get("_s", F.greatest(k - 1, F.lit(0)))["h"]))

    places = F.array_sort(F.transform(F.filter("_s", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("_p", places).drop("_s")
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def common_words(docs: DataFrame, rules: Rules) -> dict[str, list[str]]:
    """Common words (lower-cased) of each reference language, from the words of all documents."""
    words = docs.where("lang is not null").select("lang", F.explode(words_of(F.lower("text"))).alias("word"))
    counts = stage(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    per = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    every = per.agg(F.sum("total")).first()[0] or 0
    large = per.where(F.col("total") >= every * rules.language_share)
    # at most 1 / language_share rows, so this broadcast is small whatever the input
    kept = counts.join(F.broadcast(large), "lang").where(F.col("n") >= F.col("total") * rules.word_share)
    out: dict[str, list[str]] = {}
    for lang, word in kept.select("lang", "word").orderBy("lang", "word").collect():
        out.setdefault(lang, []).append(word)
    return out


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of two count lists."""

    def share(x):
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        return F.transform(x, lambda v: v / total)

    def term(a, b):
        half = (a + b) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / half)).otherwise(0.0)
        return (part(a) + part(b)) / 2

    both = F.zip_with(share(p), share(q), term)
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, v: a + v), F.lit(0.0)))


def quality(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Base counts and verdict per row of `docs` (doc_id, lang, text).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, then lang, class_distance and word_distance (null without a reference or below the
    minimum length). A null or blank text has no words and fails the base rules. A document of
    no language, or of one without a reference, is judged by the base rules alone. Repeated
    rows give repeated rows; other columns are not read; an empty table gives an empty result.
    """
    rules = rules or Rules()
    docs = docs.select("doc_id", "lang", "text")
    lists = common_words(docs, rules)
    counted = base_counts(docs)
    if lists:
        known = sorted({w for ws in lists.values() for w in ws})
        own = F.lit(None).cast("array<string>")
        for lang, ws in lists.items():
            own = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in ws])).otherwise(own)
        # common words as places in the language's list: numbers are counted faster than words
        common = F.transform(F.filter("_w", lambda w: F.lower(w).isin(known)), lambda w: F.array_position("_own", F.lower(w)))
        counted = counted.withColumn("_own", own).withColumn("_c", common)
        hist = F.transform("_own", lambda r, i: (F.size("_c") - F.size(F.array_remove("_c", (i + 1).cast("long")))).cast("double"))
    else:
        hist = F.lit(None).cast("array<double>")
    counted = counted.withColumn("_hist", hist)
    rest = F.col("n_words") - F.aggregate("_hist", F.lit(0.0), lambda a, v: a + v)
    space = F.col("_chars") - F.col("word_chars")
    letter = F.col("word_chars") - F.col("_digit") - F.col("_upper") - F.col("_punctuation")
    classes = F.array(*[c.cast("double") for c in (letter, space, *[F.col(f"_{c}") for c in CLASSES])])
    counted = counted.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_chars",
        classes.alias("_classes"), F.concat("_hist", F.array(rest)).alias("_hist"),
    )
    counted = stage(counted, "quality")
    width = F.size("_classes")
    totals = counted.where("_hist is not null").groupBy("lang")
    sums = totals.agg(
        *[F.sum(F.get("_classes", F.lit(i))).alias(f"c{i}") for i in range(2 + len(CLASSES))],
        *[F.sum(F.get("_hist", F.lit(i))).alias(f"w{i}") for i in range(1 + max(map(len, lists.values()), default=0))],
    )
    refs = sums.select(
        "lang",
        F.array(*[F.col(f"c{i}") for i in range(2 + len(CLASSES))]).alias("_ref_classes"),
        F.array_compact(F.array(*[F.col(f"w{i}") for i in range(1 + max(map(len, lists.values()), default=0))])).alias("_ref_words"),
    )
    # one row per reference language: at most 1 / language_share
    joined = counted.join(F.broadcast(refs), "lang", "left")
    long = (F.col("n_words") >= rules.min_words) & (F.col("_chars") >= rules.min_chars) & F.col("_ref_words").isNotNull() & (width > 0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.col("class_distance") > rules.max_class_distance) | (F.col("word_distance") > rules.max_word_distance)
    return (
        joined.withColumn("class_distance", F.when(long, _distance(F.col("_classes"), F.col("_ref_classes"))))
        .withColumn("word_distance", F.when(long, _distance(F.col("_hist"), F.col("_ref_words"))))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "class_distance", "word_distance")
    )
