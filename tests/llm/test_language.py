import random

from pyspark.sql import functions as F

from seqtally.llm.language import Settings, identify

BITS = {"en": ["the", "ing", "tion", "wh", "ly"], "de": ["sch", "ung", "ein", "zu", "keit"], "fr": ["eau", "tre", "oi", "que", "é"]}


def text_of(lang, k, n=80):
    rnd = random.Random(f"{lang}{k}")
    return " ".join("".join(rnd.choice(BITS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def rows():
    return [(i, text_of(lang, i), lang, f"host{i % 4}") for i, lang in enumerate(list(BITS) * 40)]


def test_text_decides_over_a_wrong_declaration(spark, docs_of):
    wrong = [(900, text_of("de", 900), "fr", "host1"), (901, text_of("en", 901), None, None), (902, text_of("fr", 902), "xx", "new host")]
    got = {r.doc_id: r for r in identify(docs_of(rows() + wrong).withColumn("host", F.col("source"))).collect()}
    assert all(got[i].language == lang and got[i].kept for i, _, lang, _ in rows())
    assert [got[i].language for i in (900, 901, 902)] == ["de", "en", "fr"]
    assert all(got[i].confidence > 0.5 for i in (900, 901, 902))


def test_other_evidence_decides_where_the_text_says_little(spark, docs_of):
    base = [(i, t, lang, f"{lang}.example") for i, t, lang, _ in rows()]
    short = [(950, "0 0", None, "fr.example"), (951, "0 0", "de", None), (952, "0 0", None, None)]
    docs = docs_of(base + short).withColumn("host", F.col("source")).withColumn("domain", F.lit("example"))
    pages = spark.createDataFrame([(i, lang, lang) for i, _, lang, _ in base] + [(952, "en", "en")], "doc_id long, markup string, suffix string")
    got = {r.doc_id: r.language for r in identify(docs, evidence=pages).collect()}
    assert (got[950], got[951], got[952]) == ("fr", "de", "en")


def test_odd_rows_and_empty_tables(spark, docs_of, odd_rows):
    docs = docs_of([(r[0] and r[0] + 1000, *r[1:]) for r in odd_rows] + rows())
    got = identify(docs.withColumn("host", F.col("source"))).where("doc_id > 1000 or doc_id is null").collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].language, by[i].confidence, by[i].kept) for i in (1002, 1003)] == [("und", 0.0, False)] * 2
    twice = [tuple(r) for r in got if r.doc_id == 1001]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert identify(docs.where("false")).count() == 0
    none = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.language for r in none} == {"und"} and not any(r.kept for r in none)


def test_text_that_fits_no_profile_is_rejected(spark, docs_of):
    noise = " ".join("".join(random.Random(i).choice("{}[]~^_@0189") for i in range(k, k + 9)) for k in range(200))
    got = {r.doc_id: r for r in identify(docs_of(rows() + [(999, noise, "en", "s")]), Settings(min_trigrams=100, max_misfit=5)).collect()}
    assert not got[999].kept and got[999].misfit > 5 and got[0].kept


def test_a_third_of_foreign_rows_is_rejected_whatever_its_length(spark, docs_of):
    letters = {"ru": "абвгдежзиклмнопрстуф", "digits": "0123456789", "base64": "ABCDEFGHIJabcdefghij+/0123456789", "pl": "szczrzęąłżówkyj"}

    def foreign(kind, k, n):
        rnd = random.Random(f"{kind}{k}")
        return " ".join("".join(rnd.choice(letters[kind]) for _ in range(rnd.randint(3, 9))) for _ in range(n))

    own = rows()
    strange = [(2000 + i, foreign(list(letters)[i % 4], i, 200 if i % 8 < 4 else 20), None, "dump") for i in range(60)]
    got = {r.doc_id: r for r in identify(docs_of(own + strange).withColumn("host", F.col("source"))).collect()}
    assert all(got[r[0]].kept for r in own)
    assert not [(r[1][:40], got[r[0]].misfit) for r in strange if got[r[0]].kept]
