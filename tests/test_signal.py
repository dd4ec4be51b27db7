import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally.operators import signal
from seqtally.operators.tile_tree import span_sums, spaced

SCHEMA = (
    "qseqid string, sseqid string, pident double, length int, qstart int, qend int, sstart int, send int, "
    "evalue double, bitscore double, qlen int"
)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for q, qlen, n in (("long_1", 1500, 60), ("short_1", 30, 8), ("mid_1", 700, 1)):
        for _ in range(n):
            a = int(rng.integers(1, qlen))
            b = a + int(rng.integers(0, 80))  # may leave the query
            ends = (5, 90) if rng.random() < 0.6 else (90, 5)
            e = float(rng.choice([0.0, 1e-30, 1e-3, 2.0]))
            out.append((q, f"fam{rng.integers(0, 3)}_x", float(rng.integers(60, 100)), b - a + 1, a, b, *ends, e, 50.0, qlen))
    return out


@pytest.fixture(scope="module")
def hits(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    out = {}
    for q, _, pid, _, a, b, s, e, ev, bits, qlen in rows:
        v = out.setdefault(q, {m: np.zeros(qlen) for m in signal.METRICS})
        lo, hi = max(0, a - 1), min(qlen, b)
        if lo >= hi:
            continue
        w = 1.0 / max(ev, 1e-180)
        c = pid / 100 * w / (hi - lo)
        v["hit_count"][lo:hi] += 1
        v["evalue_weighted"][lo:hi] += w
        v["bitscore_weighted"][lo:hi] += bits / (hi - lo)
        v["combined"][lo:hi] += c
        v["combined_plus" if s < e else "combined_minus"][lo:hi] += c
    return out


def gather(df, cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["qseqid"], {})[r["pos"]] = tuple(r[c] for c in cols)
    return out


@pytest.mark.parametrize("tile", [128, 4096])
def test_density_matches_array_sums(rows, hits, tile):
    runs = signal.density_runs(hits, tile=tile)
    df = runs.select("qseqid", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"), *signal.METRICS)
    got, want = gather(df, signal.METRICS), brute(rows)
    for q, v in want.items():
        for i in range(len(v["hit_count"])):
            have = got.get(q, {}).get(i, (0.0,) * 6)
            assert have == pytest.approx(tuple(v[m][i] for m in signal.METRICS), rel=1e-12)


def reference_smooth(x, sigma=25):
    k = signal.gaussian_kernel(sigma)
    r = len(k) // 2
    p = np.pad(x, r, mode="symmetric")
    return np.array([np.dot(p[i : i + 2 * r + 1], k) for i in range(len(x))])


@pytest.mark.parametrize("tile", [256, 4096])
def test_smoothing_is_the_same_in_tiles_and_keeps_the_sum(rows, hits, tile):
    got = gather(signal.smooth(hits, metrics=("hit_count", "combined"), tile=tile), ["hit_count", "combined", "prev_combined", "next_combined"])
    for q, v in brute(rows).items():
        want = reference_smooth(v["hit_count"])
        have = np.array([got[q].get(i, (0.0,))[0] for i in range(len(want))])
        assert have == pytest.approx(want, abs=1e-9)
        assert have.sum() == pytest.approx(v["hit_count"].sum(), rel=1e-9)
        comb = reference_smooth(v["combined"])
        for i, cell in got[q].items():
            assert cell[1] == pytest.approx(comb[i], rel=1e-9)
            assert (cell[2] is None) == (i == 0) and (cell[3] is None) == (i == len(comb) - 1)
            if cell[2] is not None:
                assert cell[2] == pytest.approx(comb[i - 1], rel=1e-9)


def brute_peaks(x, thr=0.1, dist=10):
    if len(x) == 0 or x.max() == 0:
        return []
    p = [i for i in range(1, len(x) - 1) if x[i] > thr * x.max() and x[i] > x[i - 1] and x[i] >= x[i + 1]]
    kept = p[:1]
    for i in p[1:]:
        if i - kept[-1] >= dist:
            kept.append(i)
    return kept


def test_raw_and_smoothed_peaks(rows, hits):
    raw = signal.find_peaks(signal.density_runs(hits, ["hit_count", "combined"]))
    smooth = signal.find_peaks(signal.smooth(hits, metrics=("combined",)))
    for df, shape in ((raw, lambda x: x), (smooth, reference_smooth)):
        got = {}
        for r in df.collect():
            got.setdefault(r["qseqid"], []).append(r["pos"])
        for q, v in brute(rows).items():
            assert sorted(got.get(q, [])) == brute_peaks(shape(v["combined"]))


def brute_clusters(x, thr=0.1, merge=50, size=20):
    regions = []
    for i in np.flatnonzero(x > thr * x.max()):
        if regions and i - regions[-1][1] <= merge:
            regions[-1][1] = i + 1
        else:
            regions.append([i, i + 1])
    return [tuple(r) for r in regions if r[1] - r[0] >= size]


def test_clusters_and_their_statistics(rows, hits):
    d = signal.density_runs(hits, ["combined", "hit_count"])
    found = signal.annotate_clusters(signal.find_clusters(d), d, hits).collect()
    for q, v in brute(rows).items():
        want = brute_clusters(v["combined"])
        mine = sorted((r for r in found if r["qseqid"] == q), key=lambda r: r["start"])
        assert [(r["start"] - 1, r["end"]) for r in mine] == want
        for r, (a, b) in zip(mine, want):
            assert r["total_signal"] == pytest.approx(v["combined"][a:b].sum())
            assert r["max_signal"] == pytest.approx(v["combined"][a:b].max())
            assert r["mean_signal"] == pytest.approx(v["combined"][a:b].mean())
            assert r["dominant_family"].startswith("fam")


def test_strand_coverage(rows, hits):
    got = {r["qseqid"]: r for r in signal.covered_positions(hits).collect()}
    for q in got:
        sense, anti = set(), set()
        for r in rows:
            if r[0] == q:
                (sense if r[6] < r[7] else anti).update(range(r[4] - 1, r[5]))
        g = got[q]
        assert (g["covered"], g["sense_only"], g["anti_only"], g["both_strands"]) == (
            len(sense | anti), len(sense - anti), len(anti - sense), len(sense & anti)
        )


def test_spacing_restarts_only_after_a_gap(spark):
    df = spark.createDataFrame([("q", p) for p in (1, 6, 12, 17, 23, 60, 65)], "qseqid string, pos int")
    assert sorted(r["pos"] for r in signal.space_out(df, 10).collect()) == [1, 12, 23, 60]


def greedy(places, gap):
    kept = []
    for p in sorted(places):
        if not kept or p - kept[-1] >= gap:
            kept.append(p)
    return kept


@pytest.mark.parametrize("gap,tile", [(10, 16), (3, 3), (7, 4096), (5, 2)])
def test_spacing_over_tiles_equals_a_walk(spark, gap, tile):
    rng = np.random.default_rng(gap)
    places = {q: sorted({int(x) for x in rng.integers(0, 400, n)}) for q, n in (("dense", 900), ("thin", 30), ("one", 1))}
    places["line"] = list(range(0, 400, gap - 1))  # every state goes on from tile to tile
    places["late"] = [p + 977 for p in places["dense"]]
    df = spark.createDataFrame([(q, p) for q, own in places.items() for p in own], "q string, p int")
    got = {}
    for r in spaced(df, "q", "p", gap, tile).collect():
        got.setdefault(r["q"], []).append(r["p"])
    assert {q: sorted(v) for q, v in got.items()} == {q: greedy(v, gap) for q, v in places.items()}
    assert spaced(df.where("false"), "q", "p", gap, tile).count() == 0


def test_a_long_run_of_places_takes_few_rounds(spark):
    df = spark.range(0, 10**6).select(F.lit("q").alias("q"), F.col("id").alias("p"))
    kept = spaced(df, "q", "p", 10)
    assert tuple(kept.agg(F.count("*"), F.min("p"), F.max("p"), F.count_if(F.col("p") % 10 != 0)).first()) == (10**5, 0, 999990, 0)


def test_a_crowded_tile_sums_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng = np.random.default_rng(2)
        rows = [(q, 300, int(a), int(min(a + w, 300)), float(x)) for q in ("a", "b", None) for a, w, x in zip(rng.integers(0, 299, 400), rng.integers(1, 90, 400), 10.0 ** rng.integers(0, 150, 400))]
        df = spark.createDataFrame(rows, "q string, n int, lo int, hi int, x double")
        want = {}
        for q, _, lo, hi, x in rows:
            for p in range(lo, hi):
                want[q, p] = want.get((q, p), 0.0) + x
        got = {}
        for r in span_sums(df, "q", ["x"], 64, "n").collect():
            assert r["n"] == 300 and r["lo"] < r["hi"]
            got |= {(r["q"], p): r["x"] for p in range(r["lo"], r["hi"])}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
        assert span_sums(df.where("false"), "q", ["x"], 64, "n").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
