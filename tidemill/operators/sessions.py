"""Joins of the closed loop on session days, the latest run, the latest book, and the views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .loop import excursions, pip_size


def h4_session(start: Column) -> Column:
    """The session a four-hour bar (local start) belongs to: after 17:00 of the day before, up to 17:00."""
    return F.to_date(start - F.expr("INTERVAL 1 MICROSECOND") + F.expr("INTERVAL 7 HOURS"))


def interval_opportunity(events: DataFrame, h4: DataFrame, daily: DataFrame) -> DataFrame:
    """Per event (instrument, session_date, side) the excursions over its session's four-hour bars, or over
    the daily bar where there is none; an event without either is left out. The interval of a session is an
    equi-join on its day."""
    path = h4.groupBy("instrument", h4_session(F.col("bar_start")).alias("session_date")).agg(F.struct(F.min_by("open", "bar_start").alias("entry"), F.max_by("close", "bar_start").alias("exit"), F.max("high").alias("high"), F.min("low").alias("low")).alias("h"))
    day = daily.select("instrument", "session_date", F.struct(F.col("open").alias("entry"), F.col("close").alias("exit"), "high", "low").alias("d"))
    rows = events.join(path, ["instrument", "session_date"], "left").join(day, ["instrument", "session_date"], "left")
    rows = rows.withColumn("x", F.coalesce("h", "d")).where("x is not null").withColumn("source", F.when(F.col("h").isNotNull(), "H4").otherwise("D"))
    return excursions(rows.select("instrument", "session_date", "side", "source", "x.*"), ["instrument", "session_date", "side", "source"])


def recent_outcomes(events: DataFrame, outcomes: DataFrame, today: DataFrame, days: int = 20) -> DataFrame:
    """Events (event_id, instrument, session_date) with their outcomes (event_id, ...), of the last days up to
    each instrument's today (instrument, today)."""
    near = events.join(today, "instrument").where(F.col("session_date").between(F.date_sub("today", days), F.col("today")))
    return near.drop("today").join(outcomes, "event_id")


def slippage_rows(fills: DataFrame, expected: DataFrame) -> DataFrame:
    """Number of fills of an instrument and session and their mean distance in pips from the expected entry."""
    rows = fills.join(expected, ["instrument", "session_date"])
    return rows.groupBy("instrument", "session_date").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("fill") - F.col("entry")) / pip_size(F.col("instrument"))).alias("slip"))


def latest_run(rows: DataFrame, value: str) -> DataFrame:
    """The rows of each instrument's latest run (run_id, in order) that has any value that isn't null."""
    last = rows.where(F.col(value).isNotNull()).groupBy("instrument").agg(F.max("run_id").alias("run_id"))
    return rows.join(last, ["instrument", "run_id"], "left_semi")


def latest_book(snapshots: DataFrame, vpin: DataFrame) -> DataFrame:
    """Each instrument's last book snapshot with the mean imbalance of its volume buckets, null without any."""
    last = snapshots.groupBy("instrument").agg(F.max_by(F.struct(F.col("snap").alias("book_ts"), "imbalance_l1", "imbalance_depth"), "snap").alias("b"))
    return last.select("instrument", "b.*").join(vpin.select("instrument", "vpin"), "instrument", "left")


def latest_ticks(conditioned: DataFrame, minutes: int = 15) -> DataFrame:
    """Each instrument's last conditioned tick, and ticks and share of spikes in the minutes up to it."""
    last = conditioned.groupBy("instrument").agg(F.max_by(F.struct(F.col("ts").alias("last_ts"), "price", "level", "velocity"), F.struct("ts", "seq")).alias("x")).select("instrument", "x.*")
    recent = conditioned.join(last.select("instrument", "last_ts"), "instrument").where(F.col("ts") > F.col("last_ts") - F.make_dt_interval(mins=F.lit(minutes)))
    return last.join(recent.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_recent"), F.avg(F.col("spike").cast("double")).alias("spike_rate")), "instrument")


def create_views(spark: SparkSession, features: DataFrame, book: DataFrame, vpin: DataFrame, ticks: DataFrame) -> None:
    """Temporary views for SQL users: v_engine_features (freshest forecast of each instrument with its
    structure as a number), v_l3_latest and v_physics_latest. features: (instrument, run_id, ts, p50, structure)."""
    features.where("p50 is not null").createOrReplaceTempView("forecast_features")
    latest_book(book, vpin).createOrReplaceTempView("v_l3_latest")
    latest_ticks(ticks).createOrReplaceTempView("v_physics_latest")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY VIEW v_engine_features AS
        SELECT instrument, x.ts, x.p50, x.run_id,
               CASE x.structure WHEN 'efficient' THEN 0 WHEN 'linear' THEN 1 WHEN 'vol_only' THEN 2 WHEN 'nonlinear' THEN 3 ELSE -1 END AS structure_code
        FROM (SELECT instrument, max_by(struct(*), ts) AS x FROM forecast_features GROUP BY instrument)""")


def freshness(tables: dict[str, tuple[DataFrame, str]], most_days: int = 30) -> DataFrame:
    """(name, last_ts, n_rows, fresh) of each table; fresh: not more than so many days behind the newest."""
    out = None
    for name, (df, ts) in sorted(tables.items()):
        part = df.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("last_ts"), F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    newest = out.agg(F.max("last_ts").alias("_newest"))
    joined = out.join(F.broadcast(newest), F.lit(True))  # one row
    return joined.select("name", "last_ts", "n_rows", (F.col("last_ts") >= F.col("_newest") - F.make_dt_interval(F.lit(most_days))).alias("fresh"))


def event_reversal(bars: DataFrame, events: DataFrame) -> DataFrame:
    """A day whose high-impact events surprise on the whole for the dollar but whose candle rises is long, the
    reverse short, else flat; strength .85 and .02 for each further event that isn't neutral, 1 at most.
    bars: (instrument, ts, open, close); events: (date, impact, surprise)."""
    score = F.when(F.contains("surprise", F.lit("positive_usd")), 1).when(F.contains("surprise", F.lit("negative_usd")), -1).otherwise(0)
    days = events.where("impact = 'high'").groupBy("date").agg(F.sum(score).alias("net"), F.count_if(F.coalesce("surprise", F.lit("neutral")) != "neutral").alias("told"), F.count(F.lit(1)).alias("n_events"))
    rows = bars.withColumn("date", F.to_date("ts")).join(days, "date", "left")
    rises = F.signum(F.col("close") - F.col("open"))
    side = F.when((F.col("net") > 0) & (rises > 0), "long").when((F.col("net") < 0) & (rises < 0), "short").otherwise("flat")
    strength = F.when(side == "flat", 0.0).otherwise(F.least(F.lit(1.0), 0.85 + 0.02 * (F.col("told") - 1)))
    return rows.select("instrument", "ts", side.alias("direction"), strength.alias("strength"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def accuracy(rows: DataFrame) -> DataFrame:
    """Confusion counts of predicted against label (0 or 1), accuracy, precision, recall and F1; 0 for an empty ratio."""
    hit = lambda p, l: F.count_if((F.col("predicted") == p) & (F.col("label") == l))
    c = rows.groupBy("instrument").agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def position_ratio(long: Column, short: Column) -> Column:
    """Per cent of the open positions that are long; 50 without any."""
    return F.when(long + short > 0, 100 * long / (long + short)).otherwise(50.0)


def spread_ok(bid: Column, ask: Column, pip: float = 0.0001, most: float = 2.0) -> Column:
    """Whether a quote's spread is within so many pips."""
    return F.coalesce((ask - bid) / pip <= most, F.lit(False))
