"""Characterisation of return series: memory, autocorrelation, entropy, information, regimes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ladder import by_n
from .scans import lag_moments


def hurst(series: DataFrame, max_lag: int = 64) -> DataFrame:
    """Slope of ln deviation on ln lag of the differences of the cumulated returns, lags 2 to max_lag - 1."""
    path = series.withColumn("_x", F.sum("ret").over(by_n().rowsBetween(Window.unboundedPreceding, 0)))
    return lag_moments(path, "_x", range(2, max_lag)).where("sd > 0").groupBy("instrument").agg(F.regr_slope(F.ln("sd"), F.ln("lag")).alias("hurst"))


def ljung_box(series: DataFrame, lags: int = 20) -> DataFrame:
    """Q of the returns and of their squares."""
    out = None
    for name, value in (("q_ret", F.col("ret")), ("q_sq", F.col("ret") * F.col("ret"))):
        rows = series.select("instrument", "n", value.alias("v")).withColumn("e", F.col("v") - F.avg("v").over(Window.partitionBy("instrument")))
        sums = rows.select("instrument", "e", *[(F.col("e") * F.lag("e", k).over(by_n())).alias(f"l{k}") for k in range(1, lags + 1)])
        agg = sums.groupBy("instrument").agg(F.count(F.lit(1)).alias("t"), F.sum(F.col("e") * F.col("e")).alias("g"), *[F.sum(f"l{k}").alias(f"s{k}") for k in range(1, lags + 1)])
        q = sum(((F.col(f"s{k}") / F.col("g")) * (F.col(f"s{k}") / F.col("g")) / (F.col("t") - k) for k in range(1, lags + 1)), F.lit(0.0))
        part = agg.select("instrument", (F.col("t") * (F.col("t") + 2) * q).alias(name))
        out = part if out is None else out.join(part, "instrument")
    return out


def permutation_entropy(series: DataFrame) -> DataFrame:
    """Entropy of the order of three values in a row, on a scale of 0 to 1; ties go by place."""
    a, b, c = F.lag("ret", 2).over(by_n()), F.lag("ret", 1).over(by_n()), F.col("ret")
    shape = F.concat((a <= b).cast("int").cast("string"), (b <= c).cast("int").cast("string"), (a <= c).cast("int").cast("string"))
    counts = series.select("instrument", F.when(a.isNotNull(), shape).alias("s")).where("s is not null").groupBy("instrument", "s").agg(F.count(F.lit(1)).alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy("instrument"))
    return counts.withColumn("p", p).groupBy("instrument").agg((-F.sum(F.col("p") * F.ln("p")) / math.log(6)).alias("entropy"))


def mutual_information(series: DataFrame, lag: int = 1, bins: int = 16) -> DataFrame:
    """Mutual information of a return and an earlier one, over equal-width bins, in nats."""
    pairs = series.withColumn("x", F.lag("ret", lag).over(by_n())).where("x is not null").select("instrument", "x", F.col("ret").alias("y"))
    edges = pairs.groupBy("instrument").agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in (("0", F.min), ("1", F.max))])
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * bins), F.lit(bins - 1))
    counts = pairs.join(edges, "instrument").groupBy("instrument", cell("x").alias("i"), cell("y").alias("j")).agg(F.count(F.lit(1)).alias("k"))
    part = lambda *c: F.sum("k").over(Window.partitionBy("instrument", *c))
    rows = counts.withColumn("t", part()).withColumn("ki", part("i")).withColumn("kj", part("j"))
    return rows.groupBy("instrument").agg(F.sum(F.col("k") / F.col("t") * F.ln(F.col("k") * F.col("t") / (F.col("ki") * F.col("kj")))).alias("mi"))


def volatility_regimes(series: DataFrame, window: int = 20, least: int = 5) -> DataFrame:
    """vol (trailing deviation, the head takes the first known one) and regime: calm under the median, else
    turbulent. The cut is the whole run's; head marks the rows whose value comes from later ones."""
    w = by_n().rowsBetween(-window + 1, 0)
    vol = F.when(F.count("ret").over(w) >= least, F.stddev_samp("ret").over(w))
    rows = series.withColumn("_v", vol)
    first = F.first("_v", ignorenulls=True).over(by_n().rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("vol", F.coalesce("_v", first)).withColumn("head", F.col("_v").isNull()).drop("_v")
    cut = rows.groupBy("instrument").agg(F.percentile("vol", F.lit(0.5)).alias("_cut"))
    return rows.join(cut, "instrument").withColumn("regime", F.when(F.col("vol") <= F.col("_cut"), "calm").otherwise("turbulent")).drop("_cut")


def trailing_regimes(series: DataFrame, window: int = 20, least: int = 5, past: int = 250) -> DataFrame:
    """vol (trailing deviation) and regime at each row: calm under the median of the ``past`` deviations up to it,
    else turbulent. Nothing comes from later rows; rows before the first deviation are left out."""
    w = by_n().rowsBetween(-window + 1, 0)
    rows = series.withColumn("vol", F.when(F.count("ret").over(w) >= least, F.stddev_samp("ret").over(w)))
    cut = F.percentile("vol", F.lit(0.5)).over(by_n().rowsBetween(-past + 1, 0))
    return rows.withColumn("regime", F.when(F.col("vol") <= cut, "calm").otherwise("turbulent")).where("vol is not null")
