"""Steps that must not grow faster than their input."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally.functions.sequence import codes_of
from seqtally.operators import signal, similarity
from seqtally.plans.registry import run
from seqtally.session import _WRITTEN


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _seq(n, seed, letters="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_search_moves_no_texts_and_no_short_segments(spark):
    q = spark.createDataFrame([(f"q{i}", _seq(300, i)) for i in range(6)], "seq_id string, seq string")
    s = spark.createDataFrame([("s", _seq(300, 0)[40:90] + _seq(20, 99))], "seq_id string, seq string")
    found = similarity.search(q, s, k=5, gap=3, min_score=30)
    assert "Exchange" not in _plan(found)
    top = found.orderBy("q_id").first()
    assert top["q_id"] == "q0" and top["qseq"][:50] == _seq(300, 0)[40:90] and top["slen"] == 70


def test_texts_that_differ_in_case_are_searched_each(spark):
    text = _seq(60, 3)
    q = spark.createDataFrame([("a", text), ("b", text.lower())], "seq_id string, seq string")
    s = spark.createDataFrame([("s", text)], "seq_id string, seq string")
    assert {r["q_id"] for r in similarity.search(q, s, k=11, min_score=40).collect()} == {"a"}


def test_sweep_counts_segments_of_both_strands(spark):
    q = spark.createDataFrame([("a", _seq(400, 1)), ("b", _seq(400, 2))], "seq_id string, seq string")
    s = spark.createDataFrame([("s", _seq(400, 1)[:200] + _seq(400, 2)[200:]), ("t", _seq(300, 7))], "seq_id string, seq string")
    got = {(r["word_size"], r["reward"], r["penalty"]): r for r in similarity.sweep(q, s, [5, 7], [(1, -1), (2, -3)]).collect()}
    for k in (5, 7):
        segs = similarity.score_segments(similarity.chain_seeds(similarity.seed_join(q, s, k), k, 10), q, s).collect()
        for reward, penalty in ((1, -1), (2, -3)):
            kept = [x for x in segs if reward * x["matches"] + penalty * x["mismatch"] >= 12]
            r = got[k, reward, penalty]
            assert (r["total_hits"], r["plus_hits"]) == (len(kept), sum(x["strand"] == "plus" for x in kept))
            assert r["unique_queries"] == len({x["q_id"] for x in kept})
            assert r["mean_pident"] == pytest.approx(sum(x["pident"] for x in kept) / len(kept))
            assert r["mean_length"] == pytest.approx(sum(x["length"] for x in kept) / len(kept))


def test_stretches_of_a_crowded_text_come_in_lists_of_bounded_length(monkeypatch):
    words = similarity.SubjectWords([("s", "plus", _seq(300, 1, "AC")), ("t", "plus", _seq(200, 2, "AC"))], 6)
    letters, _, owner = similarity.joined([codes_of(_seq(500, 3, "AC")), codes_of("A" * 40)])

    def rows(gap):
        parts = list(words.runs(letters, owner, None, gap))
        return len(parts), sorted(zip(*(np.concatenate([p[c] for p in parts]).tolist() for c in ("lo", "hi", "s", "seeds", "matches"))))

    for gap in (None, 4):
        monkeypatch.setattr(similarity, "MARKS", 4_000_000)
        once, want = rows(gap)
        monkeypatch.setattr(similarity, "MARKS", 1000)
        many, got = rows(gap)
        assert once == 1 and many > 3 and got == want


@pytest.fixture(scope="module")
def hits(spark):
    rng = random.Random(4)
    rows = []
    for q, n, size in (("a", 40, 1500), ("b", 6, 90), ("c", 25, 5000), ("d", 1, 1)):
        for _ in range(n):
            lo = rng.randint(1, size)
            ends = rng.sample([5, 50], 2)
            rows.append((q, f"f{rng.randint(1, 3)}_x", 80.0, lo, min(size, lo + rng.randint(0, 60)), *ends, 10.0 ** -rng.randint(1, 3), 50.0, size))
    return spark.createDataFrame(rows, "qseqid string, sseqid string, pident double, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int")


def _near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and tuple(g)[1:] == pytest.approx(tuple(w)[1:], rel=1e-9)


@pytest.mark.parametrize("tile", [300, 4096])
def test_smoothing_folded_in_tasks_is_that_of_all_positions(hits, tile):
    names = [c for m in signal.METRICS for c in (m, f"{m}_raw")]
    every = signal.smooth(hits, tile=tile).cache()
    want = every.groupBy("qseqid").agg(F.count("*").alias("positions"), *[F.sum(c).alias(c) for c in names]).orderBy("qseqid")
    _near(signal.smoothed_totals(hits, tile=tile).select(*want.columns).orderBy("qseqid").collect(), want.collect())
    stretches = signal.smoothed_stretches(hits, tile=tile).cache()
    assert stretches.count() * 5 < every.count()
    cols = ["qseqid", "start", "end", "max_signal", "total_signal", "mean_signal", "max_hit_count"]
    a, b = (signal.annotate_clusters(signal.find_clusters(d), d, hits).orderBy("qseqid", "start").select(cols).collect() for d in (every, stretches))
    assert len(a) > 5
    _near(b, a)


def test_covered_positions_are_found_without_windows(hits):
    got = signal.covered_positions(hits)
    assert "Window" not in _plan(got)
    want = {}
    for r in hits.collect():
        for p in range(r["qstart"] - 1, r["qend"]):
            want.setdefault(r["qseqid"], {}).setdefault(p, set()).add(r["sstart"] < r["send"])
    kinds = {q: [len(v), *(sum(x == s for x in v.values()) for s in ({True}, {False}, {True, False}))] for q, v in want.items()}
    assert {r["qseqid"]: list(r)[1:] for r in got.collect()} == kinds


def test_arrivals_of_the_stream_grow_in_number_not_in_share(spark):
    before = set(_WRITTEN.get(spark.sparkContext.applicationId, []))
    run("streamed_strand_tallies", spark, "/root/testdata/sf0.001").collect()
    made = [p for p in _WRITTEN[spark.sparkContext.applicationId] if p not in before and "/arrivals-" in p]
    files = list(Path(made[0].removeprefix("file:")).glob("part-*"))
    assert len(files) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pairs_of_peaks_and_clusters_are_dealt_once(hits):
    runs = signal.density_runs(hits)
    peaks = signal.annotate_peaks(signal.run_maxima(runs), hits)
    clusters = signal.annotate_clusters(signal.find_clusters(runs), runs, hits)
    for found in (peaks, clusters):
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _plan(found))
        assert not [x for x in dealt if ("pos#" in x or "c_hi#" in x) and "family#" in x]
