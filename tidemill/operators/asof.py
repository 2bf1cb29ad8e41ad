"""As-of joins without range joins: both sides are tagged and stacked, and a window carries the last value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], *, forward: bool = False, suffix: str = "") -> DataFrame:
    """left with the named columns of the latest right row at or before left_time (forward: the earliest row
    strictly after it), and its time as ``asof``. One shuffle by the keys; no row is multiplied."""
    names = [c + suffix for c in columns]
    mine = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
    other = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("asof"), *[F.col(c).alias(n) for c, n in zip(columns, names)]).alias("_right"))
    both = mine.unionByName(other, allowMissingColumns=True)
    if forward:  # a right row at the same time is not after it
        order = [F.desc("_t"), F.desc("_side")]
    else:
        order = [F.asc("_t"), F.asc("_side")]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*[F.col(c) for c in left.columns], F.col("_found.asof").alias("asof"), *[F.col(f"_found.{n}").alias(n) for n in names])


def asof_day(left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """As ``asof`` without keys, for a right side that all share and a left side of few distinct times (days): only
    the distinct times are matched in one place, and joined back to the rows by equality."""
    times = left.select(left_time).distinct().withColumn("_all", F.lit(0))
    found = asof(times, right.withColumn("_all", F.lit(0)), ["_all"], left_time, right_time, columns).drop("_all")
    return left.join(found, left_time, "left").select(*left.columns, "asof", *columns)


def next_bar(features: DataFrame, bars: DataFrame, columns: list[str], hops: int = 30) -> DataFrame:
    """features with the next bar strictly after ts within so many days; null beyond them."""
    joined = asof(features, bars, ["instrument"], "ts", "ts", columns, forward=True, suffix="_next")
    near = F.col("asof") <= F.col("ts") + F.make_dt_interval(F.lit(hops))
    return joined.select(*[c for c in features.columns], F.when(near, F.col("asof")).alias("next_ts"), *[F.when(near, F.col(c + "_next")).alias(c + "_next") for c in columns])
