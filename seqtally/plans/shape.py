"""Result shaping shared by the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shown(df: DataFrame, digits: int = 6, raw: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded (except `raw` columns), lists joined by commas, so results compare
    across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType) and f.name not in raw:
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


#: Bounds of the ranges that `narrow` scales apart; single precision itself ends near 1e38.
TIERS = (30, 60, 90, 120, 150, 180, 210)


def narrow(value: Column) -> Column:
    """A double with the 24 leading bits of its value and its own size, up to 1e210.

    Sums that differ in their last bits only become equal, and large weights stay finite.
    """
    out = value
    for k in reversed(TIERS):
        low = k - 30
        scaled = (value / F.lit(float(f"1e{low}"))).cast("float").cast("double") * F.lit(float(f"1e{low}"))
        own = scaled if low else value.cast("float").cast("double")
        out = F.when(F.abs(value) < F.lit(float(f"1e{k}")), own).otherwise(out)
    return out


def narrow_sql(value: str) -> str:
    """The same as SQL text."""
    tiers = [f"when abs({value}) < 1e30 then cast(cast({value} as float) as double)"]
    tiers += [f"when abs({value}) < 1e{k} then cast(cast({value} / 1e{k - 30} as float) as double) * 1e{k - 30}" for k in TIERS[1:]]
    return f"(case {' '.join(tiers)} else {value} end)"


def single(df: DataFrame) -> DataFrame:
    """Doubles at single precision, lists joined: for sums whose last digits depend on the
    order of addition and whose decimals often end in an exact half."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = narrow(c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def single_sql(text: str) -> str:
    """The same on the check side: round(x, 4) stands for single precision."""
    return re.sub(r"round\(((?:(?!round\().)*?), 4\)", lambda m: narrow_sql(m[1]), text)
