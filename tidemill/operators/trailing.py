"""Verdicts that are known at each origin: the edge horizon and the structure from what came before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ladder as lad
from . import report as rep
from .fits import _future, _steps, naive_by_step


def ar_by_step(series: DataFrame, *, horizon: int = 1, min_train: int = 252) -> DataFrame:
    """ar_rung's autoregression, fitted at every origin on all returns so far, for the steps 1 to horizon: means by
    recursion, variance times the summed squares of the moving-average weights."""
    rows = lad.ar_fits(series.withColumn("ys", _future(horizon))).where(F.col("n") >= min_train - 1)
    phi = lambda k: F.pow(F.col("_phi"), k.cast("double"))
    sums = lambda k: F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda a, j: a + phi(j))
    weights = lambda k: F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda a, j: a + phi(j) * phi(j))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    mean = F.transform(steps, lambda k: F.col("_c") * sums(k) + phi(k) * F.col("ret"))
    sigma = F.transform(steps, lambda k: F.col("_s") * F.sqrt(weights(k)))
    return _steps(rows, "ar", horizon, mean, sigma, F.array(*[F.lit(z) for z in lad.Z]))


def archive_by_step(series: DataFrame, horizon: int, min_train: int = 252) -> DataFrame:
    """The archive of the naive and the autoregressive rung for the steps 1 to horizon."""
    parts = naive_by_step(series, horizon=horizon, min_train=min_train), ar_by_step(series, horizon=horizon, min_train=min_train)
    return parts[0].unionByName(parts[1])


def trailing_edge(arc: DataFrame, steps: int, model: str = "ar", least: int = 30) -> DataFrame:
    """(instrument, origin, edge): at each origin of the model's one-step forecasts, the largest of the steps up to
    ``steps`` at which it has skill over the naive rung in the forecasts whose targets lie before the origin; 0 if
    none has, null while no step has ``least`` such forecasts. All steps share one pass: outcomes and origins stand
    in one order of time."""
    rows = lad.against_naive(arc.where(F.col("model").isin(model, "naive-rw") & (F.col("step") <= steps))).where(F.col("model") == model)
    loss = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    told = rows.select("instrument", "step", F.col("target").alias("at"), loss("mean").alias("mine"), loss("base").alias("naive"))
    asked = rows.where("step = 1").select("instrument", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.col("origin").alias("at"), "origin")
    w = Window.partitionBy("instrument", "step").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    both = told.unionByName(asked, allowMissingColumns=True)
    seen = both.select("instrument", "step", "origin", F.count("mine").over(w).alias("k"), F.sum("mine").over(w).alias("m"), F.sum("naive").over(w).alias("b")).where("origin is not null")
    enough = F.col("k") >= least
    skilled = F.max(F.when(enough & (F.col("m") < F.col("b")), F.col("step")))
    return seen.groupBy("instrument", "origin").agg(F.when(F.count_if(enough) > 0, F.coalesce(skilled, F.lit(0))).alias("edge"))


def _cuts(rows: DataFrame, at: str, window: int, every: int, last: DataFrame) -> DataFrame:
    """rows under each cut that follows them within ``window``, with (instrument, cut) as their instrument. A row
    is repeated window / every times at most."""
    first = F.ceil(F.col(at) / every) * every
    end = F.least(F.col(at) + (window - 1), F.col("_last"))
    dealt = rows.join(last, "instrument").where(first <= end).withColumn("cut", F.explode(F.sequence(first, end.cast("long"), F.lit(every).cast("long"))))
    return dealt.withColumn("instrument", F.struct("instrument", "cut")).drop("_last", "cut")


def trailing_structure(series: DataFrame, arc: DataFrame, *, window: int = 500, every: int = 125, least: int = 100) -> DataFrame:
    """(instrument, cut, structure): the structure verdict at every ``every``-th row, from the one-step forecasts with
    targets and the returns among the last ``window`` rows up to it. A cut with fewer than ``least`` forecasts of
    the naive rung has none. The verdict of a row n is that of cut n - n % every."""
    last = series.groupBy("instrument").agg(F.max("n").alias("_last"))
    seen = _cuts(arc.where("step = 1"), "target", window, every, last)
    enough = seen.where("model = 'naive-rw'").groupBy("instrument").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least).select("instrument")
    tests = rep.ljung_box_p(_cuts(series, "n", window, every, last))
    found = rep.classify(rep.readings(seen), tests).join(enough, "instrument", "left_semi")
    return found.select("instrument.instrument", "instrument.cut", "structure")


def verdict_at(rows: DataFrame, verdicts: DataFrame, n: Column, every: int = 125) -> DataFrame:
    """rows with the structure of the last cut at or before their place n; null where that cut has none."""
    placed = rows.withColumn("cut", (n - n % every).cast("long"))
    return placed.join(verdicts, ["instrument", "cut"], "left").drop("cut")
