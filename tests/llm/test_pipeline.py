from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_distribution_divergence", "op4_source_mix", "op5_fm_index", "op6_warc_salvage", "op9_jaccard_join", "op11_hard_negatives", "op13_collocation_trie"])
def test_query_equals_check_text(spark, name):
    con = oracle.connect(FOLDER)
    verdict, detail = oracle.compare(__spark_entry__.queries()[name](spark, FOLDER), con, __spark_entry__.oracle_sql()[name])
    assert verdict == "OK", detail


def test_every_operator_has_a_query():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """The smallest tables with nulls, repeated rows, planted cases and clashing columns added."""
    base = str(tmp_path_factory.mktemp("odd"))
    for name in ("benchmark", "labels", "pages"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{base}/{name}.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    copied = docs.where("doc_id = 7").first().text
    more = [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (None, copied, "en", "s", 0), (9003, copied, "en", "s", 0), (9004, item, "en", "s", 0)]
    # doc_ids that occur again, with a text that goes and with other good texts, one of them very long
    toxic = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").select("doc_id")
    plain = docs.where("lang = 'en' and doc_id >= 20 and n_chars between 500 and 3000").join(toxic, "doc_id", "left_anti")
    long = " ".join(r.text for r in plain.orderBy("doc_id").limit(6).collect()) + " "
    more += [(11, "", "en", "s", 0), (12, long * (400_000 // len(long) + 1), "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(docs.where("doc_id < 20"))
    docs.withColumns({c: F.lit("x") for c in ("_contamination", "_copy", "host", "score", "node")}).write.parquet(f"{base}/documents.parquet")
    return base


def kept_alone(spark, last):
    """Ids that the stages up to `last` keep of the unchanged documents."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[: last + 1]:
        docs = corpus_pipeline.stage(step(spark, docs, FOLDER), name)
    return {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_keep_columns_and_take_effect(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, odd_folder), name)
        assert docs.columns == columns, name
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    assert 9001 not in ids[1] and 9002 not in ids[1]  # no text, no language
    assert sum(x in (7, 9003, None) for x in ids[2]) == 1 and 9004 in ids[2]
    assert 11 in ids[1] and (11 in ids[2]) == (11 in kept_alone(spark, 2)) and ids[2].count(12) == 1 + (12 in kept_alone(spark, 2))
    assert {k: n for k, n in Counter(ids[2]).items() if n > 1}.keys() <= {12}
    assert 9004 not in ids[3] and len(ids[3]) > 100
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, odd_folder)
    assert mixed.count() == len(ids[3]) and mixed.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_empty_documents(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet").where("false")
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, odd_folder), name)
        assert docs.count() == 0
