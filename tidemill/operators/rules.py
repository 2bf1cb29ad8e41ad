"""Predicates, calendars, alerts, paths of cross-validation and other small rules."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .indicators import by_time


def fresh(value: Column, at: Column, now: Column, minutes: int) -> Column:
    """value, unless it is older than so many minutes."""
    return F.when(at >= now - F.make_dt_interval(mins=F.lit(minutes)), value)


def above_noise(p50: Column, spread: Column, floor: float = 0.05) -> Column:
    return (F.abs(p50) >= floor) & (spread > 0)


def repaired_quote(bid: Column, ask: Column, price: Column, pip: float = 0.0001) -> tuple[Column, Column]:
    """Bid and ask; a missing or crossed quote becomes the price less and plus half of 1.5 pips."""
    bad = bid.isNull() | ask.isNull() | (bid >= ask)
    half = 0.75 * pip
    return F.when(bad, F.round(price - half, 5)).otherwise(bid), F.when(bad, F.round(price + half, 5)).otherwise(ask)


def calendar(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """(day, next_day): trading days (no weekend, no holiday) and the next one. days: (day), holidays: (day)."""
    trading = days.where(F.weekday("day") < 5).join(holidays, "day", "left_anti")
    return trading.withColumn("next_day", F.lead("day").over(Window.orderBy("day")))


def encode(value: Column, codes: dict[str, int], missing: int = -1) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[value], F.lit(missing))


def run_status(errors: Column) -> Column:
    return F.when(errors == 0, "success").when(errors < 4, "partial").otherwise("failed")


def path_quantiles(paths: DataFrame, levels: tuple) -> DataFrame:
    """Quantiles over sampled paths of the log return from the last close (floor 1e-9), by origin and step.
    paths: (origin, path, step, close); step 0 is the last close."""
    w = Window.partitionBy("origin", "path").orderBy("step")
    last = F.first("close").over(w)
    ret = F.ln(F.greatest("close", F.lit(1e-9)) / F.greatest(last, F.lit(1e-9)))
    grid = F.percentile("ret", F.array(*[F.lit(x) for x in levels]))
    return paths.withColumn("ret", ret).where("step > 0").groupBy("origin", "step").agg(F.array_sort(grid).alias("q"), F.avg("ret").alias("mean"))


def cpcv_paths(spark: SparkSession, groups: int = 6, test: int = 2) -> DataFrame:
    """(path, group): the test groups of every combination."""
    return spark.createDataFrame([(k, g) for k, c in enumerate(itertools.combinations(range(groups), test)) for g in c], "path int, grp int")


def cpcv_members(rows: DataFrame, paths: DataFrame, groups: int = 6, purge: int = 5, embargo: int = 2) -> DataFrame:
    """(instrument, path, n_test, n_train): rows of a path's test groups, and of its train set: the rest less
    those within ``purge`` after or ``embargo`` before a test row's place. rows: (instrument, n)."""
    size = rows.groupBy("instrument").agg((F.max("n") + 1).alias("len"))
    edges = size.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("instrument", "len", "grp", F.floor(F.col("grp") * F.col("len") / groups).alias("lo"), F.floor((F.col("grp") + 1) * F.col("len") / groups).alias("hi"))
    tested = edges.join(F.broadcast(paths), "grp")  # groups times paths rows for an instrument
    bounds = tested.groupBy("instrument", "path").agg(F.collect_list(F.struct("lo", "hi")).alias("t"))
    n = rows.join(bounds, "instrument")
    inside = F.exists("t", lambda x: (F.col("n") >= x["lo"]) & (F.col("n") < x["hi"]))
    near = F.exists("t", lambda x: (F.col("n") >= x["lo"] - purge) & (F.col("n") < x["hi"] + embargo))
    return n.groupBy("instrument", "path").agg(F.count_if(inside).alias("n_test"), F.count_if(~near).alias("n_train"))


def probabilistic_sharpe(returns: DataFrame, column: str = "r") -> DataFrame:
    """Per-period Sharpe, unbiased skew and kurtosis, and the statistic of the probabilistic Sharpe ratio; null
    for returns that are all equal, the last three also for three rows or fewer."""
    n, sd = F.count(column), F.stddev_samp(column)
    found = returns.groupBy("instrument").agg(n.alias("n"), (F.avg(column) / F.when(sd > 0, sd)).alias("sharpe"), F.skewness(column).alias("g1"), F.kurtosis(column).alias("g2"))
    k = F.when(F.col("n") > 3, F.col("n"))
    skew = F.col("g1") * F.sqrt(k * (k - 1)) / (k - 2)
    kurt = (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * F.col("g2") + 6)
    found = found.withColumn("skew", skew).withColumn("kurt", kurt)
    sr = F.col("sharpe")
    return found.select("instrument", "n", "sharpe", "skew", "kurt", (sr * F.sqrt(k - 1) / F.sqrt(1 - F.col("skew") * sr + (F.col("kurt") + 2) / 4 * sr * sr)).alias("psr_z"))


def alerts(rows: DataFrame, *, stale_hours: int = 48, most_bps: float = 50.0) -> DataFrame:
    """(instrument, ts, alert): a move beyond three ATR, a flat decision five days or more in a row, a gap of more
    than stale_hours before the bar, a spread change (spread_d5, basis points) beyond most_bps. rows: (instrument,
    ts, close, atr, direction, spread_d5)."""
    w = by_time()
    flat = F.col("direction") == "flat"
    grp = F.sum((~flat).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tagged = rows.withColumn("_grp", grp)
    run = F.row_number().over(Window.partitionBy("instrument", "_grp").orderBy("ts")) - F.when(F.col("_grp") > 0, 1).otherwise(0)
    tagged = tagged.withColumn("_run", run)
    found = F.array_compact(F.array(F.when(F.abs(F.col("close") - F.lag("close").over(w)) > 3 * F.col("atr"), "move"), F.when(flat & (F.col("_run") >= 5), "flat_days"),
        F.when(F.col("ts") > F.lag("ts").over(w) + F.make_dt_interval(hours=F.lit(stale_hours)), "stale"), F.when(F.abs("spread_d5") > most_bps, "spread")))
    return tagged.withColumn("_a", found).select("instrument", "ts", F.explode("_a").alias("alert"))


def target_position(decisions: DataFrame, base: int = 10, most: int = 8) -> DataFrame:
    """Whole units of direction times size, within bounds, and the change from the last."""
    sign = F.when(F.col("direction") == "long", 1).when(F.col("direction") == "short", -1).otherwise(0)
    want = F.greatest(F.lit(-most), F.least(F.lit(most), F.round(sign * F.col("size") * base).cast("int")))
    return decisions.withColumn("position", want).withColumn("change", F.col("position") - F.lag("position", 1, 0).over(by_time()))


def daily_swap(annual: Column, price: Column, day: Column, pip: float = 0.0001) -> Column:
    """Pips of a day's swap from an annual rate; three times on Wednesdays."""
    return annual / 365 * price / pip * F.when(F.weekday(day) == 2, 3).otherwise(1)
