"""Building blocks that keep every group, rank and join side bounded.

* `stage`            writes a table to the shared folder and reads it back
* `skew_join`        equi join whose hot keys are split over many tasks
* `with_row_number`  global row numbers without a one-task sort
* `join_per_value`   join with one row per value whose crowded values are split by slab
* `cumulative_counts`, `quantiles`, `upper_median`  exact order statistics of any group size
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import scratch_path

HOT_ROWS = 2_000_000
UNB = Window.unboundedPreceding


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once and continue from the files, so what follows sees fixed rows."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows and the number of parts each is split into.

    At most rows / hot_rows keys, whatever their number of rows; counted with a map-side combine.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    return counts.select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_splits"))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    force: bool = False,
) -> DataFrame:
    """Equi join on shared column names that survives keys holding most of either side.

    A plain join is left to Spark, which broadcasts a side below its size threshold and, with
    adaptive execution, splits the crowded partitions of a sort-merge join. `force` salts
    by key instead, for what is crowded on both sides or aggregated on top: left rows of a key
    with more than `hot_rows` rows pick one of its parts by hash and the right rows are
    repeated for each; in an inner join keys crowded on the right are split the same way.
    The lists of hot keys are joined, not broadcast, so they may be of any length.
    """
    on = list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot repeat the right side of a {how} join")
    if not force:
        return left.join(right, on, how)

    def salted(mine: DataFrame, other: DataFrame, hot: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
        """`mine` with a part per row, `other` repeated for every part."""
        parts = F.coalesce(F.col("_splits"), F.lit(1))
        one = mine.join(hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(*mine.columns), parts).cast("int"))
        all_ = other.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1)))
        return one.drop("_splits"), all_.drop("_splits")

    by_left, by_right = hot_keys(left, on, hot_rows), hot_keys(right, on, hot_rows)
    keys = [*on, "_salt"]
    left, right = salted(left, right, by_left, "_salt")
    if how == "inner":
        right, left = salted(right, left, by_right, "_salt2")
        keys.append("_salt2")
    return left.join(right, keys, how).drop("_salt", "_salt2")


def _range_parts(df: DataFrame, *order: Column) -> DataFrame:
    """Sorted slabs `_part` 0..n-1; written out, so slab borders cannot move on a retry."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slabs = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    return stage(slabs, "slabs")


def with_row_number(df: DataFrame, *order: Column, name: str = "row_no") -> DataFrame:
    """1-based position in the total order `order`, for tables of any size.

    Rows are range-partitioned and numbered inside each slab; slab offsets come from one
    count per slab. `order` must be total for a repeatable answer.
    """
    parts = _range_parts(df, *order)
    # one row per slab: bounded by spark.sql.shuffle.partitions
    offsets = (
        parts.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"),
        )
    )
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, local + F.col("_offset"))
        .drop("_part", "_offset")
    )


def join_per_value(df: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """`df` with the row of `table` that has the same `value`; `table` has each value once.

    Rows are placed in range slabs by value, a value with many rows in several of them. The
    table is looked up once per value and slab, and rows meet that on (slab, value), so no key
    of the join holds more rows than a slab. Values are not null; rows without one in `table` go.
    """
    parts = _range_parts(df, F.col(value), F.monotonically_increasing_id())
    looked = parts.select("_part", value).distinct().join(table, value)
    return parts.join(looked, ["_part", value]).drop("_part")


def running_over_slabs(
    df: DataFrame, order: Sequence[Column], value: str, agg, name: str
) -> DataFrame:
    """Running `agg` (F.min, F.max or F.sum) of `value` along `order`, slab by slab."""
    parts = _range_parts(df, *order)
    per_slab = parts.groupBy("_part").agg(agg(value).alias("_slab"))
    carry = per_slab.select(
        "_part", agg("_slab").over(Window.orderBy("_part").rowsBetween(UNB, -1)).alias("_carry")
    )
    local = agg(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(UNB, 0))
    both = {F.min: F.least, F.max: F.greatest}.get(agg)
    joined = parts.join(F.broadcast(carry), "_part").withColumn("_local", local)
    merged = (
        both(F.col("_local"), F.col("_carry"))
        if both
        else F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0))
    )
    return joined.withColumn(name, merged).drop("_part", "_carry", "_local")


def cumulative_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group and distinct value: `n`, `before` (rows below it) and the group `total`.

    Rows are first counted per distinct value (map-side), then the distinct values are
    range-partitioned, so neither a hot group nor a hot value lands in one task.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    )
    parts = _range_parts(counts, *[F.col(c) for c in by], F.col(value))
    slabs = parts.groupBy(*by, "_part").agg(F.sum("n").alias("_slab"))
    # at most one row per slab in each group
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    slabs = slabs.select(
        *by,
        "_part",
        (F.sum("_slab").over(group.orderBy("_part")) - F.col("_slab")).alias("_offset"),
        F.sum("_slab").over(group).alias("total"),
    )
    local = Window.partitionBy("_part", *by).orderBy(value)
    return (
        parts.join(slabs, [*by, "_part"])
        .withColumn("before", F.col("_offset") + F.sum("n").over(local) - F.col("n"))
        .select(*by, value, "n", "before", "total")
    )


def _at(index: Column, value: str) -> Column:
    inside = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
    return F.max(F.when(inside, F.col(value)))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles, one output column per entry of `probs`."""
    cum = cumulative_counts(df, by, value)
    bounds, out = [], []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        bounds += [
            _at(F.floor(pos), value).alias(f"_{name}_lo"),
            _at(F.ceil(pos), value).alias(f"_{name}_hi"),
        ]
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).cast("double").alias(name))
    return cum.groupBy(*by).agg(*bounds, F.max("total").alias("total")).select(*by, *out)


def upper_median(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """The element at index n // 2 of the sorted values."""
    cum = cumulative_counts(df, by, value)
    return cum.groupBy(*by).agg(_at(F.floor(F.col("total") / 2), value).alias(name))


def conditional_upper_medians(
    df: DataFrame, value: str, conditions: dict[str, Column], name: str
) -> DataFrame:
    """(label, name): the element at index n // 2 among the rows of each condition.

    Conditions may overlap. Every distinct value is shuffled once with one count per
    condition, rather than once per condition.
    """
    labels = list(conditions)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(*[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(conditions.values())])
    )
    parts = _range_parts(counts, F.col(value))
    slabs = parts.groupBy("_part").agg(*[F.sum(f"_n{i}").alias(f"_s{i}") for i in range(len(labels))])
    along, whole = Window.orderBy("_part"), Window.partitionBy(F.lit(0))  # one row per slab
    offsets = slabs.select(
        "_part",
        *[(F.sum(f"_s{i}").over(along) - F.col(f"_s{i}")).alias(f"_o{i}") for i in range(len(labels))],
        *[F.sum(f"_s{i}").over(whole).alias(f"_t{i}") for i in range(len(labels))],
    )
    local = Window.partitionBy("_part").orderBy(value)
    placed = parts.join(F.broadcast(offsets), "_part").select(
        value,
        *[
            F.struct(
                (F.col(f"_o{i}") + F.sum(f"_n{i}").over(local) - F.col(f"_n{i}")).alias("before"),
                F.col(f"_n{i}").alias("n"),
                F.floor(F.col(f"_t{i}") / 2).alias("k"),
            ).alias(f"_c{i}")
            for i in range(len(labels))
        ],
    )

    def pick(i: int) -> Column:
        c = F.col(f"_c{i}")
        inside = (c["before"] <= c["k"]) & (c["k"] < c["before"] + c["n"])
        return F.max(F.when(inside, F.col(value))).alias(f"_m{i}")

    one = placed.agg(*[pick(i) for i in range(len(labels))])
    rows = [F.struct(F.lit(x).alias("label"), F.col(f"_m{i}").alias(name)) for i, x in enumerate(labels)]
    return one.select(F.inline(F.array(*rows)))
