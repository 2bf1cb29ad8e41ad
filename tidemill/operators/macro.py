"""Macro series: aligned yields and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_date():
    """One row a day."""
    return Window.orderBy("date")


def align(yields: DataFrame) -> DataFrame:
    """Dates with a US yield; the DE yield carried forward; dates before the first of it dropped."""
    carried = F.last("de_yield", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return yields.where("us_yield is not null").withColumn("de_yield", carried).where("de_yield is not null")


def spread_changes(yields: DataFrame) -> DataFrame:
    """Spread in basis points and its changes over 5 and 20 dates, US changes over 1, 5 and 20."""
    rows = align(yields).withColumn("spread_bps", (F.col("us_yield") - F.col("de_yield")) * 100)
    change = lambda c, k: F.col(c) - F.lag(c, k).over(by_date())
    return rows.select(
        "date", "spread_bps", change("spread_bps", 5).alias("spread_d5"), change("spread_bps", 20).alias("spread_d20"),
        change("us_yield", 1).alias("us_d1"), change("us_yield", 5).alias("us_d5"), change("us_yield", 20).alias("us_d20"),
    )
