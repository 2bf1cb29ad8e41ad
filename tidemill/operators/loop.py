"""The closed loop: events from decisions, their opportunity, slippage, stress windows, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_time
from .ladder import by_n


def extract_events(decisions: DataFrame) -> DataFrame:
    """Non-flat decisions as event rows, the prediction's direction before the composite's."""
    side = F.when(F.col("direction") != "flat", F.col("direction")).otherwise(F.col("fallback"))
    return decisions.withColumn("side", side).where("side is not null and side != 'flat'").select("instrument", "ts", "side", F.coalesce("strength", F.lit(0.0)).alias("confidence"))


def pip_size(instrument: Column) -> Column:
    return F.when(F.contains(instrument, F.lit("JPY")), 0.01).otherwise(0.0001)


def opportunity(events: DataFrame, ticks: DataFrame, session: str = "session_date") -> DataFrame:
    """Per event (instrument, session_date, side): entry, exit, best and worst excursion and the close in pips,
    and the path ratio best / (best - worst), one half without a path. The session interval is an equi-join on its day; the session's
    prices are aggregated before it."""
    at = F.struct("ts", "seq")
    bars = ticks.groupBy("instrument", session).agg(F.min_by("price", at).alias("entry"), F.max_by("price", at).alias("exit"), F.max("price").alias("high"), F.min("price").alias("low"))
    return excursions(events.join(bars, ["instrument", session]), ["instrument", session, "side"])


def excursions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Best, worst and closing excursion of rows (side, entry, exit, high, low) in pips and their path ratio."""
    pip = pip_size(F.col("instrument"))
    long = F.col("side") == "long"
    best = F.when(long, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low")) / pip
    worst = F.when(long, F.col("low") - F.col("entry")).otherwise(F.col("entry") - F.col("high")) / pip
    close = F.when(long, F.col("exit") - F.col("entry")).otherwise(F.col("entry") - F.col("exit")) / pip
    rows = rows.withColumn("mfe", best).withColumn("mae", worst).withColumn("close_return", close)
    ratio = F.when(F.col("mfe") - F.col("mae") > 0, F.col("mfe") / (F.col("mfe") - F.col("mae"))).otherwise(0.5)
    return rows.select(*keys, "entry", "exit", "mfe", "mae", "close_return", ratio.alias("path_ratio"))


def slippage(fills: DataFrame, expected: DataFrame, session: str = "session_date") -> DataFrame:
    """Mean distance of fills from the expected entry in pips, and the execution limits moved by it."""
    rows = fills.join(expected, ["instrument", session])
    mean = rows.groupBy("instrument").agg(F.avg(F.abs(F.col("fill") - F.col("entry")) / pip_size(F.col("instrument"))).alias("slip"), F.count(F.lit(1)).alias("n"))
    over = F.col("slip") - 1
    return mean.withColumns({
        "max_spread": F.when(over > 0, F.greatest(F.lit(1.0), F.round(2.0 - 0.5 * over, 2))).otherwise(2.0),
        "entry_velocity": F.when(over > 0, 1.5e-6 * (1 + 0.25 * over)).otherwise(1.5e-6),
    })


def stress_windows(curve: DataFrame, windows: DataFrame) -> DataFrame:
    """For each named window of time: worst drawdown and day, share of flat days, mean size, and the days from the
    worst drawdown back to its peak (null if the window ends first). windows: (name, lo, hi), any number; they
    meet the curve by equality on days."""
    days = windows.withColumn("_day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    rows = curve.withColumn("_day", F.to_date("ts")).join(days, "_day").where((F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi"))).drop("_day")
    peak = F.max("equity").over(Window.partitionBy("name", "instrument").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_peak", peak).withColumn("_dd", F.col("equity") - F.col("_peak"))
    worst = rows.groupBy("name", "instrument").agg(F.min_by(F.struct("ts", "_peak"), F.struct("_dd", "ts")).alias("_w"))
    back = rows.join(worst, ["name", "instrument"]).where((F.col("ts") > F.col("_w.ts")) & (F.col("equity") >= F.col("_w._peak")))
    back = back.groupBy("name", "instrument").agg((F.min(F.to_date("ts"))).alias("_back"), F.first(F.to_date("_w.ts")).alias("_low"))
    found = rows.groupBy("name", "instrument").agg(F.min("_dd").alias("max_loss"), F.min("pnl").alias("worst_day"), F.avg((F.col("direction") == "flat").cast("double")).alias("flat_share"), F.avg("size").alias("mean_size"))
    return found.join(back, ["name", "instrument"], "left").withColumn("days_to_recover", F.date_diff("_back", "_low")).drop("_back", "_low")


def intraday_replay(ticks: DataFrame, sides: DataFrame, session: str = "session_date", leverage: float = 10.0, equity: float = 10_000.0) -> DataFrame:
    """A session's trade from its first to its last tick: best and worst per cent, and leveraged profit."""
    at = F.struct("ts", "seq")
    day = ticks.groupBy("instrument", session).agg(F.min_by("price", at).alias("entry"), F.max_by("price", at).alias("exit"), F.max("price").alias("high"), F.min("price").alias("low"))
    rows = day.join(sides, ["instrument", session])
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    best = F.when(sign > 0, F.col("high")).otherwise(F.col("low"))
    worst = F.when(sign > 0, F.col("low")).otherwise(F.col("high"))
    share = lambda x: sign * (x - F.col("entry")) / F.col("entry")
    return rows.select("instrument", session, "side", (100 * share(best)).alias("mfe_pct"), (100 * share(worst)).alias("mae_pct"), (equity * leverage * share(F.col("exit"))).alias("pnl"))


def kpss(series: DataFrame) -> DataFrame:
    """KPSS statistic of the level, with a Bartlett window of L = 4 (n / 100)^(1/4) lags.

    Bartlett's weighted lag products are the mean square of sums over L + 1 values in a row, those that reach
    over an end included; such a sum is a difference of two running sums. So each row meets the one L + 1 before
    it by equality, whatever L is.
    """
    rows = series.withColumn("e", F.col("ret") - F.avg("ret").over(Window.partitionBy("instrument")))
    rows = rows.select("instrument", "n", "e", F.sum("e").over(by_n().rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    size = series.groupBy("instrument").agg(F.count(F.lit(1)).alias("t"))
    lags = size.withColumn("L", F.ceil(4 * F.pow(F.col("t") / 100, F.lit(0.25))).cast("int"))
    tied = rows.join(lags, "instrument")
    before = tied.select("instrument", (F.col("n") + F.col("L") + 1).alias("n"), F.col("s").alias("_s0"))
    within = tied.join(before, ["instrument", "n"], "left").withColumn("_w", F.col("s") - F.coalesce("_s0", F.lit(0.0)))
    over = F.when((F.col("n") >= F.col("t") - 1 - F.col("L")) & (F.col("n") < F.col("t") - 1), F.col("s") * F.col("s")).otherwise(0.0)
    sums = within.groupBy("instrument", "t").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), (F.sum(F.col("_w") * F.col("_w") + over) / (F.max("L") + 1)).alias("lr"))
    return sums.select("instrument", "t", (F.col("ss") / F.col("t") / F.col("lr")).alias("kpss"))


def flat_streaks(decisions: DataFrame) -> DataFrame:
    """Per instrument: the last time and the number of flat decisions in a row up to it."""
    w = by_time()
    grp = F.sum((F.col("direction") != "flat").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = decisions.withColumn("_g", grp)
    last = rows.groupBy("instrument").agg(F.max("ts").alias("last_ts"), F.max("_g").alias("_g"))
    tail = rows.join(last, ["instrument", "_g"]).groupBy("instrument", "last_ts").agg(F.count_if(F.col("direction") == "flat").alias("flat_days"))
    return tail


def snapshot(parts: DataFrame, keys: list[str]) -> DataFrame:
    """All other columns of a row as one nested JSON text."""
    rest = [c for c in parts.columns if c not in keys]
    return parts.select(*keys, F.to_json(F.struct(*rest)).alias("snapshot"))
