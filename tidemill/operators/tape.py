"""Trade tapes: decoding, filters, front contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIXED_POINT = 1e-9
OUT_OF_SCALE = 1e6


def clean_trades(trades: DataFrame) -> DataFrame:
    """Trades with positive finite price and size; an instrument whose median price is above 1e6 is taken as
    fixed point and rescaled by 1e-9. The median's side of 1e6 follows from counts and the prices next to it,
    so one partial aggregate with a row for each instrument is joined back."""
    low, price = F.col("price") <= OUT_OF_SCALE, F.col("price")
    sums = trades.groupBy("instrument").agg(F.count_if(low).alias("_lo"), F.count_if(price > OUT_OF_SCALE).alias("_hi"), F.max(F.when(low, price)).alias("_a"), F.min(F.when(~low, price)).alias("_b"))
    fixed = F.when(F.col("_lo") == F.col("_hi"), F.col("_a") + F.col("_b") > 2 * OUT_OF_SCALE).otherwise(F.col("_hi") > F.col("_lo"))
    scaled = trades.join(sums.select("instrument", fixed.alias("_fixed")), "instrument").withColumn("price", F.when(F.col("_fixed"), price * FIXED_POINT).otherwise(price))
    return scaled.drop("_fixed").where("price > 0 and size > 0")


def outright_trades(messages: DataFrame) -> DataFrame:
    """Trades only, without calendar spreads (their symbol has a dash)."""
    return messages.where((F.col("action") == "T") & ~F.contains("symbol", F.lit("-")))


def decode_price(text: Column) -> Column:
    """A price field: with a point it is a number, without one it is an integer in billionths."""
    return F.when(F.contains(text, F.lit(".")), text.cast("double")).otherwise(text.cast("double") * FIXED_POINT)


def parse_utc(text: Column) -> Column:
    """An ISO time with up to nanoseconds and a Z, cut to microseconds."""
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(text, "Z$", ""), r"(\.\d{6})\d+$", "$1"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def regular_hours(ts: Column) -> Column:
    """13:30 to 20:00 UTC."""
    return (minute_of_day(ts) >= 13 * 60 + 30) & (minute_of_day(ts) < 20 * 60)


def maintenance(ts: Column) -> Column:
    """21:00 to 22:05 UTC."""
    return (minute_of_day(ts) >= 21 * 60) & (minute_of_day(ts) < 22 * 60 + 5)


def new_york(ts: Column) -> Column:
    """New York wall time of a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)


def front_by_count(trades: DataFrame) -> DataFrame:
    """(instrument, trade_date, symbol): per New York date the symbol with most trades; ties: the least."""
    days = trades.groupBy("instrument", F.to_date(new_york(F.col("ts"))).alias("trade_date"), "symbol").agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy("instrument", "trade_date").agg(F.min_by("symbol", F.struct(-F.col("n"), "symbol")).alias("symbol"))


def front_by_volume(trades: DataFrame) -> DataFrame:
    """(instrument, symbol): the symbol with the largest total size; ties: the least."""
    sums = trades.groupBy("instrument", "symbol").agg(F.sum("size").alias("v"))
    return sums.groupBy("instrument").agg(F.min_by("symbol", F.struct(-F.col("v"), "symbol")).alias("symbol"))


def front_trades(trades: DataFrame) -> DataFrame:
    """Trades of each date's front symbol."""
    dated = trades.withColumn("trade_date", F.to_date(new_york(F.col("ts"))))
    return dated.join(front_by_count(trades), ["instrument", "trade_date", "symbol"], "left_semi")


def violations(series: DataFrame) -> DataFrame:
    """Per instrument: rows, prices that aren't positive and finite, times that don't increase."""
    w = Window.partitionBy("instrument").orderBy("ts", "seq")
    bad = F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0) | (F.abs("price") == float("inf"))
    return (
        series.withColumn("_tie", F.col("ts") <= F.lag("ts").over(w))
        .groupBy("instrument")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad_price"), F.count_if("_tie").alias("n_not_increasing"))
    )
