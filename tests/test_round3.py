import math
import random
from collections import Counter

import duckdb
import oracle
from pyspark.sql import functions as F

from seqtally.functions import sequence as sq
from seqtally.operators import annotation as an
from seqtally.operators import nullmodel, rollups, signal, similarity
from seqtally.plans.registry import CHECKS, _load, check_texts, run
from seqtally.plans.statistics_queries import RANK_P
from seqtally.sources import annotation, sinks

_load()

def test_no_set_inside_the_limits(spark, tmp_path):
    sets = spark.createDataFrame([("a", "FBgn1"), ("a", "FBgn2"), ("b", "FBgn1")], "set_name string, fbgn string")
    sinks.write_gene_sets(sets, str(tmp_path / "none"), 3, 9)
    back = annotation.read_set_folders(spark, str(tmp_path / "none"))
    assert an.set_summary(back.select("set_name", F.col("value").alias("fbgn")), 1, 9).collect() == []
    assert annotation.read_gene_sets(spark, str(tmp_path / "none"), one_file_per_set=False).collect() == []
    sinks.write_gene_sets(sets, str(tmp_path / "one"), 2, 9)
    assert {tuple(r) for r in annotation.read_set_folders(spark, str(tmp_path / "one")).collect()} == {("FBgn1", "a"), ("FBgn2", "a")}


def test_match_line_of_empty_and_unequal_texts(spark):
    rows = [(1, "", ""), (2, "AC", "A"), (3, "A-", "A"), (4, None, "A"), (5, "\U0001f600-", "\U0001f600\u00e9")]
    df = spark.createDataFrame(rows, "n int, q string, s string")
    got = {r.n: r.m for r in df.select("n", sq.match_line(F.col("q"), F.col("s")).alias("m")).collect()}
    assert got == {1: "", 2: "|.", 3: "| ", 4: None, 5: "| "}


def test_alignment_lines_of_long_texts(spark):
    q, s = "AC-T" * 40, "ACGA" * 40
    df = spark.createDataFrame([(q, s, 5, 300, False), ("", "", 1, 1, True)], "q string, s string, a int, b int, plus boolean")
    lines = df.select(F.inline(sq.alignment_lines(*[F.col(c) for c in ("q", "s", "a", "b", "plus")]))).collect()
    assert [(r.q_from, r.q_to, r.s_from, r.s_to) for r in lines] == [(5, 64, 300, 241), (65, 124, 240, 181), (125, 164, 180, 141)]
    assert "".join(r["query"] for r in lines) == q and "".join(r.subject for r in lines) == s
    assert "".join(r.marks for r in lines) == "|| ." * 40


def test_far_rank_tails_in_sql():
    xs = [0.5, 2.0, 5.9, 6.1, 12.0, 20.0]
    z = "z as (select 's' as set_name, 9 as n_in, 9 as n_out, x as u, 1.0 as median_in, 1.0 as median_out, x from unnest(" + str(xs) + "::double[]) t(x))"
    pv = RANK_P[RANK_P.index(" pv as (select set_name") :]
    got = duckdb.sql(f"with {z}, {pv} select u, mw_p from pv order by u").fetchall()
    for x, p in got:
        assert math.isclose(p, math.erfc(x), rel_tol=1e-4, abs_tol=1e-13)


def test_top_hits_sql_orders_by_the_value_itself():
    con = duckdb.connect()
    con.sql("""create table hits as select i as l_orderkey, 1 as l_linenumber, 1 as l_partkey, 1 as l_suppkey,
      1e-3 - i * 1e-13 as evalue from range(100) r(i)""")
    best = [r[0] for r in con.sql(CHECKS["top_hits_by_evalue"]).fetchall()]
    assert sorted(best) == list(range(50, 100))


def test_subject_coverage_sql_with_equal_starts():
    con = duckdb.connect()
    # stretches of 10 bases, 20 apart; every start 100 times with ends that differ
    con.sql("""create table hits as select concat('te', i % 50) as sseqid, 1 + i // 5000 % 60 * 20 as sstart,
      1 + i // 5000 % 60 * 20 + i * 7 % 10 as send from range(300000) r(i)""")
    con.sql("create table subjects as select concat('te', i) as te_id, 'f' as family, 2000 as te_length from range(50) r(i)")
    got = con.sql(CHECKS["subject_coverage"]).fetchall()
    want = con.sql("""select sseqid, count(distinct p) from (select sseqid, unnest(range(sstart, send + 1)) as p
      from (select distinct sseqid, sstart, send from hits)) group by 1""").fetchall()
    assert {r[0]: r[3] for r in got} == dict(want)


def test_hit_and_rest_means_are_exact(spark):
    folder = "/root/testdata/sf0.001"
    got = run("hit_vs_rest_scores", spark, folder)
    assert oracle.compare(got, oracle.connect(folder), check_texts()["hit_vs_rest_scores"])[0] == "OK"
    # no value was rounded on the way
    assert got.where("hit_mean <> round(hit_mean, 6)").count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_folded_inside_their_text(spark):
    rng = random.Random(3)
    texts = [("t%d" % n, "".join(rng.choice("ACGT") for _ in range(n))) for n in (0, 10, 11, 12, 300, 5000)]
    texts.append(("wide", "é\U0001f600xyzzy" * 9))
    df = spark.createDataFrame([*texts, ("none", None)], "seq_id string, seq string")
    got = {r.seq_id: tuple(r)[1:] for r in sq.kmer_summary(df, 11).collect()}
    want = {}
    for name, t in texts:
        words = [t[i : i + 11] for i in range(len(t) - 10)]
        if words:
            want[name] = (len(words), len(set(words)), sum(range(1, len(words) + 1)), min(words), max(words))
    assert got == want
    assert "Exchange" not in _plan(sq.kmer_summary(df, 11))


def test_changed_copies_are_found(spark):
    a = spark.createDataFrame([("a", "acgtacgt"), ("b", "ACNNGT"), ("c", "A")], "seq_id string, seq string")
    rows = [("a", "a1", "ACGTACGT"), ("a", "a2", "ACGTACGA"), ("b", "b1", "GTNNAC"), ("b", "b2", "GTNNGT"), ("c", "c1", "G"), ("x", "x1", "AC")]
    copies = spark.createDataFrame(rows, "seq_id string, shuffled_id string, seq string")
    got = {r.shuffled_id: r.preserved for r in nullmodel.verify_shuffle(a, copies).collect()}
    assert got == {"a1": True, "a2": False, "b1": True, "b2": False, "c1": True, "x1": False}
    assert "Exchange" not in _plan(nullmodel.dinuc_counts(a))


def test_shuffles_draw_as_the_random_module_does():
    for n in (0, 1, 2, 3, 17, 1000):
        mine, theirs = list(range(n)), list(range(n))
        nullmodel._deal(mine, random.Random(n).getrandbits)
        random.Random(n).shuffle(theirs)
        assert mine == theirs


def test_window_scores_against_counting(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("AAAC") for _ in range(n)) for n in (3, 4, 40, 63, 64, 65, 96, 97, 200, 140000)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "seq_id string, seq string")
    want = set()
    for i, t in enumerate(texts):
        for o in range(0, len(t), 32):
            w = t[o : o + 64]
            if len(w) >= 4 and (o == 0 or len(w) > 32):
                c = Counter(w[j : j + 3] for j in range(len(w) - 2))
                score = sum(x * (x - 1) // 2 for x in c.values()) / (len(w) - 3)
                if score > 2:
                    want.add((str(i), o, o + len(w), score))
    assert {tuple(r) for r in similarity.low_complexity_windows(df).collect()} == want


def test_gc_of_a_long_text(spark):
    rng = random.Random(5)
    t = "".join(rng.choice("ACGTn") for _ in range(70000))
    got = sq.gc_window(spark.createDataFrame([("a", t), ("b", "")], "seq_id string, seq string")).collect()
    assert [r.pos for r in got] == list(range(70000)) and {r.seq_id for r in got} == {"a"}
    for i in (0, 10, 25, 65535, 65536, 69990, 69999):
        w = t[max(i - 25, 0) : i + 25]
        assert got[i].gc == sum(c in "GC" for c in w) / len(w)


def test_crests_hold_all_peaks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        a, n = rng.randrange(1, 8800), rng.randrange(5, 200)
        rows.append((f"q{i % 4}", "s", 90.0, n, a, a + n, 1 + i % 2, 3 - i % 2 * 2, rng.random() + 0.01, 50.0, 9000))
    cols = "qseqid string, sseqid string, pident double, length int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int"
    hits = spark.createDataFrame([*rows, ("edge", "s", 90.0, 30, 1, 30, 1, 30, 0.5, 50.0, 40)], cols)
    d = signal.smooth(hits, metrics=("combined",))
    tops = signal.crests(d)
    want = {(r.qseqid, r.pos) for r in signal.find_peaks(d).collect()}
    assert want and {(r.qseqid, r.pos) for r in signal.find_peaks(tops).collect()} == want
    assert tops.count() * 10 < d.count()


def test_region_statistics_of_equal_hits_and_regions(spark):
    rng = random.Random(7)
    hits = [(i, rng.choice(["fa", "Fb", "none"]), rng.choice([20, 60]), a, a + rng.choice([9, 30])) for i in range(300) for a in [rng.randrange(40)]]
    regions = [(rng.choice(["r1", "r2"]), rng.choice(["LTR", "CDS"]), a, a + 10) for _ in range(60) for a in [rng.randrange(30)]]
    h = spark.createDataFrame(hits, "id int, family string, length int, s_lo int, s_hi int")
    r = spark.createDataFrame(regions, "region_id string, region string, reg_start int, reg_end int")
    m = spark.createDataFrame([("fa", "r1"), ("fb", "r2"), ("fb", "r1")], "family_key string, region_id string")
    span = ["family", "length", "s_lo", "s_hi"]
    summed = rollups.region_overlap(h.groupBy(*span).agg(F.count("*").alias("n")), r, m, span, summed=True)
    plain = rollups.region_stats(rollups.region_overlap(h, r, m, ["id"]))
    assert {tuple(x) for x in rollups.region_stats(summed).collect()} == {tuple(x) for x in plain.collect()}
    # no more rows than spans and names of regions, however many hits and regions there are
    assert summed.count() <= 3 * h.select(*span).distinct().count()
