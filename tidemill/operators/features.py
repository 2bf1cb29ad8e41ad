"""The 25 model features of an instrument's day, for all days in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof, asof_day
from .indicators import by_time
from .micro import trailing_vpin
from .rules import encode

# Codes of the structure verdict and of a direction.
STRUCTURES = {"efficient": 0, "linear": 1, "vol_only": 2, "nonlinear": 3}
SIDES = {"long": 1, "short": -1, "flat": 0}

# The features in the order of the model, with the value of a day that lacks one. A structure
# that is missing or unknown is -1, so the veto of an efficient one (0) never comes from missing data.
VECTOR = {
    "regime_state": 1.0, "days_in_regime": 1.0,
    "yield_spread_bps": 0.0, "yield_spread_change_5d": 0.0, "yield_spread_change_20d": 0.0,
    "forecast_p50_scaled": 0.0, "forecast_uncertainty": 0.0, "forecast_context_vol": 0.0, "structure_code": -1.0,
    "book_imbalance": 0.0, "vpin": 0.0,
    "atr_14": 0.0, "rsi_14": 50.0, "price_vs_ma50": 0.0, "price_vs_ma200": 0.0, "body_direction": 0.0, "body_pct_of_range": 0.5,
    "event_reversal": 0.0, "event_strength": 0.0,
    "day_of_week": 0.0, "is_friday": 0.0,
    "signal_direction": 0.0, "signal_count": 0.0, "signal_strength": 0.0, "confirmation_count": 0.0,
}


def technical_part(rows: DataFrame) -> DataFrame:
    """Features of technical()'s rows."""
    names = {"atr": "atr_14", "rsi": "rsi_14", "vs_ma50": "price_vs_ma50", "vs_ma200": "price_vs_ma200", "body_dir": "body_direction", "body_pct": "body_pct_of_range"}
    return rows.select("instrument", "ts", *[F.col(c).alias(n) for c, n in names.items()])


def macro_part(days: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest spread known on each day and its changes, or those of the US yield where there are none.
    days: (instrument, ts); changes: spread_changes()."""
    change = lambda k: F.coalesce(f"spread_d{k}", f"us_d{k}", F.lit(0.0)).alias(f"yield_spread_change_{k}d")
    known = changes.select("date", F.coalesce("spread_bps", F.lit(0.0)).alias("yield_spread_bps"), change(5), change(20))
    return asof_day(days.select("instrument", "ts"), known, "ts", "date", known.columns[1:]).select("instrument", "ts", *known.columns[1:])


def regime_part(states: DataFrame) -> DataFrame:
    """State and days since it was entered. states: (instrument, ts, state)."""
    w = by_time()
    run = F.sum(F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1))).over(w)
    dealt = states.withColumn("_run", run)
    days = F.row_number().over(Window.partitionBy("instrument", "_run").orderBy("ts"))
    return dealt.select("instrument", "ts", F.col("state").alias("regime_state"), days.alias("days_in_regime"))


def forecast_part(rows: DataFrame) -> DataFrame:
    """rows: (instrument, ts, p50, spread, sigma, structure)."""
    return rows.select("instrument", "ts", F.col("p50").alias("forecast_p50_scaled"), F.col("spread").alias("forecast_uncertainty"), F.col("sigma").alias("forecast_context_vol"), encode(F.lower("structure"), STRUCTURES).alias("structure_code"))


def side_code(direction: str) -> Column:
    return encode(F.col(direction), SIDES, 0)


def reversal_part(rows: DataFrame) -> DataFrame:
    """rows: event_reversal()'s."""
    return rows.select("instrument", "ts", side_code("direction").alias("event_reversal"), F.col("strength").alias("event_strength"))


def signal_part(rows: DataFrame) -> DataFrame:
    """rows: composite()'s."""
    return rows.select("instrument", "ts", side_code("direction").alias("signal_direction"), "signal_count", F.col("strength").alias("signal_strength"), F.col("tier2_count").alias("confirmation_count"))


def feature_vector(days: DataFrame, *parts: DataFrame, least_bars: int = 1) -> DataFrame:
    """(instrument, ts, then VECTOR's columns as doubles) of every day that has least_bars days up to it.

    days: one row per (instrument, ts); parts: rows (instrument, ts, some of VECTOR's columns), one per day at
    most. All parts meet on (instrument, ts) by equality, so one shuffle of each serves; a feature that no part
    gives, or that is null, has its value of VECTOR.
    """
    out = days.select("instrument", "ts")
    if least_bars > 1:
        out = out.withColumn("_n", F.count(F.lit(1)).over(by_time().rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_n") >= least_bars).drop("_n")
    for part in parts:
        out = out.join(part, ["instrument", "ts"], "left")
    day = F.weekday("ts")
    out = out.withColumns({"day_of_week": day, "is_friday": (day == 4).cast("int")})
    value = lambda c, none: F.coalesce(F.col(c).cast("double"), F.lit(none)) if c in out.columns else F.lit(none)
    return out.select("instrument", "ts", *[value(c, none).alias(c) for c, none in VECTOR.items()])


def book_part(states: DataFrame) -> DataFrame:
    """states: book_at()'s rows, one for each day at most."""
    return states.select("instrument", "ts", F.col("imbalance_l1").alias("book_imbalance"))


def bucket_part(days: DataFrame, buckets: DataFrame, last: int = 50) -> DataFrame:
    """The mean imbalance of the last buckets that had closed by each day's time. days: (instrument, ts); buckets:
    vpin_buckets()'s."""
    known = trailing_vpin(buckets, last).groupBy("instrument", "close_ts").agg(F.max_by("vpin", "bucket").alias("vpin"))
    return asof(days.select("instrument", "ts"), known, ["instrument"], "ts", "close_ts", ["vpin"]).select("instrument", "ts", "vpin")
