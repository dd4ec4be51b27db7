"""Registered queries of the operators and, where SQL can say it, their check texts.

Each query derives the digest columns from what its operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import table
from .decontamination import find_contamination
from .hard_negatives import hard_negatives
from .html_text import extract_text, host_of
from .jaccard_join import near_duplicates
from .language import identify
from .mixing import mix
from .packing import pack_documents, read_vocabulary
from .quality import quality
from .query_sql import CHECKS
from .token_counts import edit_aware_counts, read_ranks
from .toxicity import toxicity
from .url_filter import filter_urls
from .warc import archived_pages

#: A public byte-level vocabulary; any file of that layout can be named instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_edit_aware_tokens(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of every document before and after redaction."""
    found = edit_aware_counts(table(spark, folder, "documents"), read_ranks(spark, vocabulary))
    return found.select(
        "doc_id",
        F.col("n_before").alias("n_tokens"),
        F.col("n_after").alias("n_tokens_edited"),
        "n_edits",
        "chars_before",
        "chars_after",
        "chars_encoded",
    )


@query
def op2_distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules with the distance of every document from its language's reference."""
    found = quality(table(spark, folder, "documents"))
    distances = {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    return found.withColumns(distances)


@query
def op3_site_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = extract_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words the scheduled mix takes of every document."""
    return mix(table(spark, folder, "documents"))[0]


@query
def op5_fm_index(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, folder, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


@query
def op6_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC archives and read back by the salvage reader."""
    return archived_pages(spark, table(spark, folder, "pages"))


@query
def op7_ftrl_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def page_document(url):
    """Id of the document a page was taken from: the number in its path; null without one."""
    number = F.regexp_extract(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), "/(\\d{1,18})(?:[./]|$)", 1)
    return F.when(number != "", number).cast("long")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, markup, suffix, page_host) of the page a document was taken from, if any.

    The number in a page's path is its document's id; of several pages the smallest page_id counts.
    """
    markup = F.lower(F.regexp_extract("html", "(?i)<html\\b[^>]*\\blang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    rows = pages.select(
        page_document(F.col("url")).alias("doc_id"),
        F.struct(
            "page_id",
            F.when(markup != "", markup).alias("markup"),
            F.when(host_of(F.col("url")) != "", host_of(F.col("url"))).alias("host"),
        ).alias("p"),
    )
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("p").alias("p"))
    return first.select("doc_id", "p.markup", F.substring_index("p.host", ".", -1).alias("suffix"), F.col("p.host").alias("page_host"))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document from its text, declarations, address and host.

    A document's host is its source; the markup language and address suffix are those of the
    page it was taken from.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", F.col("source").alias("host"))
    return identify(docs, evidence=page_evidence(table(spark, folder, "pages")).drop("page_host"))


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_duplicates(table(spark, folder, "documents"))


@query
def op10_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL; pages of documents labelled as toxic or of low quality are bad ones."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, folder, "labels").select("doc_id", bad.alias("bad"))
    linked = pages.select("page_id", page_document(F.col("url")).alias("doc_id")).join(labels, "doc_id")
    return filter_urls(pages, linked.select("page_id", "bad"))


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Negatives in the window below each of the five best positives of every hundredth vector."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=moved)


@query
def op12_shortest_pack_first(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 tokens."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pack_documents(docs, read_vocabulary(vocabulary), keep_ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op13_collocation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of two or three words of every language."""
    return collocations(table(spark, folder, "documents"))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def check_texts() -> dict[str, str]:
    return {name: sql for name, sql in CHECKS.items() if name in QUERIES}
