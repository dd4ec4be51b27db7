"""Vectorised p-values. Everything up to the final scalar per test stays in Spark."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _log_choose(n, k) -> np.ndarray:
    return (_lgamma(n + 1.0) - _lgamma(k + 1.0) - _lgamma(n - k + 1.0)).astype(float)


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: total probability of tables no likelier than the observed one."""
    row, col, total = a + b, a + c, a + b + c + d
    if 0 in (row, c + d, col, b + d):
        return 1.0
    x = np.arange(max(0, row + col - total), min(row, col) + 1, dtype=float)
    logp = _log_choose(float(col), x) + _log_choose(float(total - col), row - x)
    p = np.exp(logp - _log_choose(np.array([float(total)]), float(row))[0])
    seen = p[int(a - x[0])]
    return float(min(1.0, p[p <= seen * (1 + 1e-7)].sum()))


@F.pandas_udf(T.DoubleType())
def fisher_pvalue(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(*map(int, t)) for t in zip(a, b, c, d)], dtype=float)


def odds_ratio(a: str, b: str, c: str, d: str) -> Column:
    """Sample odds ratio: NaN when a margin is empty, infinite when b or c is 0."""
    A, B, C, D = (F.col(x).cast("double") for x in (a, b, c, d))
    empty = (A + B == 0) | (C + D == 0) | (A + C == 0) | (B + D == 0)
    return (
        F.when(empty, F.lit(float("nan")))
        .when((B == 0) | (C == 0), F.lit(float("inf")))
        .otherwise(A * D / (B * C))
    )


@lru_cache(maxsize=None)
def _numerator(m: int) -> tuple[int, tuple[int, ...]]:
    """L and the coefficients of (1 - q^L)^(m+1) / ((1 - q)(1 - q)(1 - q^2) .. (1 - q^m)).

    L is the least common multiple of 1 .. m, so every factor divides 1 - q^L and the quotient
    is a polynomial of less than (m + 1) L coefficients, whatever sizes are compared later.
    """
    period = math.lcm(*range(1, m + 1))
    out = np.ones(1, dtype=object)
    for part in (1, *range(1, m + 1)):
        # times 1 + q^part + q^(2 part) + .. below q^L: a running sum in steps of `part`
        wide = np.concatenate([out, np.zeros(period - part, dtype=object)])
        for offset in range(min(part, len(wide))):
            wide[offset::part] = np.add.accumulate(wide[offset::part])
        longer = wide.copy()
        longer[period:] = wide[period:] - wide[: len(wide) - period] if len(wide) > period else wide[period:]
        out = longer
    return period, tuple(int(x) for x in out)


def _at_most(s: int, m: int) -> int:
    """Partitions of 0, 1, .., s into at most `m` parts of any size, counted together."""
    if s < 0:
        return 0
    period, numerator = _numerator(m)
    turns, rest = divmod(s, period)
    # 1 / (1 - q^L)^(m+1) has binomials as coefficients; the numerator meets at most m + 1 of them
    return sum(
        numerator[rest + period * b] * math.comb(turns - b + m, m)
        for b in range(min(turns, (len(numerator) - 1 - rest) // period) + 1)
    )


def exact_u_tail(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, exact.

    Arrangements with U = s are partitions of s into at most m parts of at most n, with m the
    smaller side: the coefficients of prod (1 - q^(n+i)) / (1 - q^i), i = 1 .. m. The bounds on
    the parts are 2^m signed shifts of unbounded partitions, which a fixed polynomial and
    binomials count at any place. Time and memory depend on m alone: 8 against 10^7 values
    take what 8 against 10 take.
    """
    m, n = sorted((n1, n2))
    # both ends of the distribution are alike: U >= u as often as U <= m n - u
    last = m * n - max(0, math.ceil(u))
    if last < 0 or m == 0:
        return 0.0 if last < 0 else 1.0
    shifts = Counter({0: 1})
    for i in range(1, m + 1):
        for s, sign in list(shifts.items()):
            if s + n + i <= last:
                shifts[s + n + i] -= sign
    return sum(sign * _at_most(last - s, m) for s, sign in shifts.items()) / math.comb(m + n, m)


def normal_u_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided normal approximation for the larger U, with tie and continuity correction."""
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def mann_whitney_p(u1: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided: exact when a side has at most 8 values and there are no ties, else
    normal. `ties` is the sum of t^3 - t over tied values."""
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and ties == 0:
        return min(1.0, 2 * exact_u_tail(u, n1, n2))
    return normal_u_p(u, n1, n2, ties)


@F.pandas_udf(T.DoubleType())
def mann_whitney_pvalue(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    out = []
    for x, a, b, t in zip(u, n1, n2, ties):
        skip = any(pd.isna(v) for v in (x, a, b, t)) or a < 3 or b < 3
        out.append(float("nan") if skip else mann_whitney_p(float(x), int(a), int(b), float(t)))
    return pd.Series(out, dtype=float)


def log2_or_capped(orat: Column) -> Column:
    """log2 with infinity capped at 100 and zero at 0.01; null when not a number."""
    capped = F.when(orat == float("inf"), 100.0).when(orat == 0, 0.01).otherwise(orat)
    return F.when(~F.isnan(orat), F.log2(capped))


def volcano_x(orat: Column) -> Column:
    """log2 odds ratio clipped to -10..10; zero ratios drop out as null."""
    capped = F.when(orat == float("inf"), 100.0).otherwise(orat)
    ok = ~F.isnan(orat) & (orat > 0)
    return F.when(ok, F.least(F.greatest(F.log2(capped), F.lit(-10.0)), F.lit(10.0)))


def volcano_y(q: Column) -> Column:
    """-log10 q with a floor of 1e-200, clipped to 0..200."""
    y = -F.log10(F.greatest(q, F.lit(1e-200)))
    return F.least(F.greatest(y, F.lit(0.0)), F.lit(200.0))
