import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally.llm.hard_negatives import Heaps, Settings, hard_negatives, strassen

SMALL = Settings(block_bytes=8 * 4 * 16, slab_rows=7, tile=5, leaf=1)


def brute(rows, k=5, w=5):
    good = []
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, vec_id, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, anchor, va, la in good:
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), vec_id, i, label) for i, vec_id, v, label in good)
        for s, positive, *_ in [x for x in scored if x[3] == la and x[2] != a][:k]:
            p = -s
            fits = [(-n, b) for n, b, _, label in scored if label != la and 80 * p <= -100 * n <= 100 * p]
            out += [(anchor, positive, r, b, p, n) for r, (n, b) in enumerate(fits[:w], 1)]
    return sorted(out)


def mined(spark, rows, settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumns({c: F.lit("x") for c in ("row", "v", "anchor", "block", "slab", "score", "rank", "limit")})
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(df, anchor=F.col("vec_id") % 100 == 0, label=moved, settings=settings)
    return sorted(tuple(r) for r in found.collect())


def vectors(rnd, n, dims, labels, spread=4):
    return [(i if rnd.random() < 0.9 else rnd.choice([i - 1, 100, 200]), [rnd.randint(-1, spread) / 256 for _ in range(dims)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (33, 17, 40), (64, 64, 64), (3, 70, 2), (0, 4, 3)])
def test_strassen_equals_the_plain_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m + k + n)
    for top in (100, 1 << 28, 1 << 62):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (strassen(a, b, 2) == a @ b).all()  # both modulo 2 ** 64
    big = np.array([[10**30, 3], [5, 7]], object)
    assert (strassen(big, big, 1) == big @ big).all()


def test_heaps_merge_in_any_grouping():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(-3, 3, (6, 40)), np.sort(rng.integers(0, 30, 40))
    fits = rng.random((6, 40)) < 0.5
    one, many = Heaps(6, 5), Heaps(6, 5)
    one.offer(slice(0, 6), scores, ids, fits)
    for lo in (30, 0, 10, 20):
        many.offer(slice(0, 6), scores[:, lo : lo + 10], ids[lo : lo + 10], fits[:, lo : lo + 10])
    assert (one.scores == many.scores).all() and (one.ids == many.ids).all() and (one.full == many.full).all()


@pytest.mark.parametrize("settings", [Settings(), SMALL])
def test_equals_brute_force(spark, settings):
    rnd = random.Random(4)
    rows = vectors(rnd, 330, 5, 3)
    rows += [(400, [0.1, 0.2], 1), (500, [], 1), (600, [0.0] * 5, 2), (None, [0.1] * 5, 1), (700, None, 1)]
    rows += [(800, [0.1] * 5, None), (900, [0.1, None, 0.1, 0.1, 0.1], 1), (1000, [math.nan] * 5, 1), (1100, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (100, rows[100][1], rows[100][2])]
    got = mined(spark, rows, settings)
    assert got == brute(rows) and len(got) > 100


def test_huge_components_stay_exact(spark):
    rnd = random.Random(9)
    rows = vectors(rnd, 120, 3, 2) + [(200, [3e5, 1.0, -3e5], 0), (201, [2e5, 1.0, 0.0], 0), (203, [1.9e5, 0.0, 0.0], 1)]
    assert mined(spark, rows, SMALL) == brute(rows)
    rows = [(100, [1e-300, 0.5], 1), (101, [1e300, 0.0], 1), (102, [0.0, 0.5], 1), (103, [0.0, 0.45], 0)]
    assert mined(spark, rows, SMALL) == brute(rows)


def test_empty_and_single_label(spark):
    assert mined(spark, [], SMALL) == []
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 1)], SMALL) == []
    assert mined(spark, [(101, [1.0], 1), (102, [1.0], 2)], SMALL) == []
