"""Training corpus from `documents`: filter, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; `run`
writes a stage's result as Parquet and reads it again as the next one's docs. All stages but
the last return the columns of `documents`, extra ones included.

Rows are told apart by what they hold, not by doc_id alone: a doc_id that occurs with a good
and a bad text keeps the good one, and rows without a doc_id are judged like others. Stages on
an empty table return empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtally.llm.common import Bloom, table
from seqtally.llm.decontamination import find_contamination
from seqtally.llm.jaccard_join import near_duplicates
from seqtally.llm.language import identify
from seqtally.llm.mixing import mix
from seqtally.llm.queries import page_evidence
from seqtally.llm.toxicity import Settings as ToxicitySettings
from seqtally.llm.toxicity import fit, held_out, score
from seqtally.scale import stage

LOG_BITS = 24
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def row_key() -> Column:
    """Number of 63 bits that stands for a row's doc_id, text, lang and source, nulls included."""
    columns = ("doc_id", "text", "lang", "source")
    return F.shiftrightunsigned(F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]), 1)


def _bounded(docs: DataFrame) -> DataFrame:
    """Texts reach Python in batches of `BATCH_BYTES`, unless the session names a size of its own."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return docs


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with its row key under a free name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, row_key()), name


def _split(docs: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` whose key is surely not in `keys`, and the others.

    The test is a Bloom filter of fixed size, so the texts of the first part, nearly all of
    them where `keys` are few, need no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Bloom.of(keys, LOG_BITS))

    @F.arrow_udf("boolean")
    def known(values):
        import pyarrow as pa

        return pa.array(sent.value.has(values.to_numpy(zero_copy_only=False)))

    test = known(F.col(key))
    return docs.where(~test), docs.where(test)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored below the threshold."""
    settings = ToxicitySettings()
    docs = _bounded(docs)
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return docs.where(score(docs, fit(docs, labels, settings)) < settings.threshold)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough confidence."""
    docs, key = _keyed(_bounded(docs))
    rows = docs.select(F.col(key).alias("doc_id"), "text", "lang", F.col("source").alias("host"))
    page = page_evidence(table(spark, sf_dir, "pages")).drop("page_host")
    own = docs.where("doc_id is not null").select("doc_id", key).join(page, "doc_id").drop("doc_id")
    found = identify(rows, evidence=own.withColumnRenamed(key, "doc_id").dropDuplicates(["doc_id"]))
    rejected = stage(found.where("not kept").select(F.col("doc_id").alias(key)).distinct(), "rejected")
    clear, rest = _split(docs, key, rejected)
    return clear.unionByName(rest.join(rejected, key, "left_anti")).drop(key)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest row key, once."""
    docs, key = _keyed(_bounded(docs))
    found = stage(near_duplicates(docs.select(F.col(key).alias("doc_id"), "text")), "components")
    found = found.withColumnRenamed("doc_id", key)
    others = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    again = found.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(key)
    others, again = stage(others, "others"), stage(again, "again")
    clear, rest = _split(docs, key, others.unionByName(again))
    rest = rest.join(others, key, "left_anti")
    # the few rows that occur again: one of them
    number = f"{key}_n"
    while number in docs.columns:
        number += "_"
    order = Window.partitionBy(key).orderBy("doc_id")
    rest = rest.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
    return clear.unionByName(rest.select(clear.columns)).drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; one with any goes as a whole."""
    into = "_contamination"
    while into in docs.columns:
        into += "_"
    found = find_contamination(_bounded(docs), table(spark, sf_dir, "benchmark"), into)
    return found.where(F.col(into)["n_hit"] == 0).drop(into)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document that is left."""
    return mix(docs)[0]


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: A learned score and iterated components decide which rows are left; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
