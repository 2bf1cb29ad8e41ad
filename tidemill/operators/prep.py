"""Point-in-time preparation of price series: repair, returns, trailing scales, anomaly flags.

Every window ends at or before the current row. w is the order of an instrument's series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(extra: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy("instrument", *(extra or [])).orderBy("ts", "seq")


def usable(price: Column) -> Column:
    return price.isNotNull() & ~F.isnan(price) & (price > 0) & (price != float("inf"))


def drop_duplicate_times(prices: DataFrame) -> DataFrame:
    """The last row (by seq) of each instrument and time."""
    last = F.max_by(F.struct(*[F.col(c) for c in prices.columns]), F.col("seq"))
    return prices.groupBy("instrument", "ts").agg(last.alias("_row")).select("_row.*")


def repair(prices: DataFrame) -> DataFrame:
    """Unusable prices replaced by the last usable one; the head without any is dropped. repaired marks them."""
    ok = usable(F.col("price"))
    filled = F.last(F.when(ok, F.col("price")), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return prices.withColumn("repaired", ~ok).withColumn("price", filled).where(F.col("price").isNotNull())


def run_length(prices: DataFrame, column: str = "price") -> DataFrame:
    """run: the number of rows so far with the current value, this one included."""
    w = series()
    changed = F.coalesce(F.col(column) != F.lag(column).over(w), F.lit(True))
    grouped = prices.withColumn("_run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.withColumn("run", F.row_number().over(series(["_run"]))).drop("_run")


def clean_report(prices: DataFrame, stale_run: int = 5) -> DataFrame:
    """Per instrument: rows, duplicate times dropped, prices repaired (the dropped head too), stale rows."""
    single = drop_duplicate_times(prices)
    bad = single.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_single"), F.count_if(~usable(F.col("price"))).alias("n_repaired"))
    stale = run_length(repair(single)).groupBy("instrument").agg(F.count_if(F.col("run") >= stale_run).alias("n_stale"))
    rows = prices.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_input"))
    joined = rows.join(bad, "instrument").join(stale, "instrument", "left")
    return joined.select("instrument", "n_input", (F.col("n_input") - F.col("n_single")).alias("n_dropped"), "n_repaired", F.coalesce("n_stale", F.lit(0)).alias("n_stale"))


def log_returns(prices: DataFrame) -> DataFrame:
    """ret: ln of the price over the price before; null on an instrument's first row."""
    return prices.withColumn("ret", F.ln("price") - F.ln(F.lag("price").over(series())))


def rebuild(returns: DataFrame) -> DataFrame:
    """rebuilt: the price path from the first price and the returns alone."""
    w = series()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("rebuilt", F.first("price").over(so_far) * F.exp(F.coalesce(F.sum("ret").over(so_far), F.lit(0.0))))


def trailing(w: WindowSpec, rows: int, current: bool = False) -> WindowSpec:
    return w.rowsBetween(-rows + 1, 0) if current else w.rowsBetween(-rows, -1)


def guarded(value: Column, column: str, w: WindowSpec, least: int) -> Column:
    """value, where the frame has so many values of the column."""
    return F.when(F.count(column).over(w) >= least, value)


def condition(returns: DataFrame, window: int = 256, least: int = 64) -> DataFrame:
    """sigma: deviation of the returns before this one; scaled: ret / sigma; sigma_next: the scale that holds
    for the return after this one."""
    w = series()
    before, now = trailing(w, window), trailing(w, window, current=True)
    sigma = guarded(F.stddev_samp("ret").over(before), "ret", before, least)
    after = guarded(F.stddev_samp("ret").over(now), "ret", now, least)
    return returns.withColumn("sigma", sigma).withColumn("scaled", F.when(F.col("sigma") > 0, F.col("ret") / F.col("sigma"))).withColumn("sigma_next", after)


def flag_anomalies(returns: DataFrame, window: int = 60, z_k: float = 3.0, vol_mult: float = 3.0) -> DataFrame:
    """z_flag, iqr_flag, vol_flag and any_flag against the returns before the current one."""
    least, w = max(10, window // 2), series()
    before = trailing(w, window)
    enough = F.count("ret").over(before) >= least
    frame = returns.where(F.col("ret").isNotNull()).withColumns({
        "_mu": F.when(enough, F.avg("ret").over(before)),
        "_sd": F.when(enough, F.stddev_samp("ret").over(before)),
        "_q1": F.when(enough, F.percentile("ret", F.lit(0.25)).over(before)),
        "_q3": F.when(enough, F.percentile("ret", F.lit(0.75)).over(before)),
    })
    now = trailing(w, window, current=True)
    frame = frame.withColumn("_rv", guarded(F.percentile("_sd", F.lit(0.5)).over(now), "_sd", now, least))
    iqr = F.col("_q3") - F.col("_q1")
    flags = {
        "z_flag": (F.col("_sd") > 0) & (F.abs((F.col("ret") - F.col("_mu")) / F.when(F.col("_sd") > 0, F.col("_sd"))) > z_k),
        "iqr_flag": (F.col("ret") < F.col("_q1") - 1.5 * iqr) | (F.col("ret") > F.col("_q3") + 1.5 * iqr),
        "vol_flag": F.col("_sd") > vol_mult * F.col("_rv"),
    }
    frame = frame.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return frame.withColumn("any_flag", F.col("z_flag") | F.col("iqr_flag") | F.col("vol_flag")).drop("_mu", "_sd", "_q1", "_q3", "_rv")


def scale_by_train(returns: DataFrame, train_rows: int) -> DataFrame:
    """z: the return on the scale of the first train_rows returns, which alone fix mean and deviation."""
    numbered = returns.where(F.col("ret").isNotNull()).withColumn("_n", F.row_number().over(series()))
    fit = numbered.where(F.col("_n") <= train_rows).groupBy("instrument").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("_sd"))
    fit = fit.select("instrument", "mu", F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(F.lit(1.0)).alias("sd"))
    return numbered.drop("_n").join(fit, "instrument").withColumn("z", (F.col("ret") - F.col("mu")) / F.col("sd"))
