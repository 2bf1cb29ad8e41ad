"""The meta-model: boosted trees that score whether a primary decision will gain."""

from __future__ import annotations

import itertools
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_cdf, t_p_value
from ..sources.tables import shared_folder
from . import decisions as dec
from . import indicators as ind
from .rules import probabilistic_sharpe

FEATURES = ["ret_pct", "vs_ma50", "vol5", "vol20", "atr", "rsi", "body_pct", "strength", "side"]


def training_rows(decisions: DataFrame, bars: DataFrame) -> DataFrame:
    """Labelled decisions with the features of their day; nulls are 0."""
    rows = dec.meta_labels(decisions, bars).drop("next_ts", "open_next", "close_next")
    joined = rows.join(ind.technical(bars).drop("open", "close", "high", "low"), ["instrument", "ts"])
    return joined.withColumn("side", F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)).fillna(0.0, FEATURES)


def fit_meta(rows: DataFrame, trees: int = 20, depth: int = 4, seed: int = 1):
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def decide(score: Column, half: float = 0.55, full: float = 0.70) -> Column:
    """Size by the gates: none, half, whole."""
    return F.when(score >= full, 1.0).when(score >= half, 0.5).otherwise(0.0)


def meta_scores(decisions: DataFrame, bars: DataFrame, train_share: float = 0.7) -> DataFrame:
    """(instrument, ts, label, score, size) of the decisions after the first part of each instrument's time, on
    which the model is fitted."""
    rows = training_rows(decisions, bars)
    cut = rows.groupBy("instrument").agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(train_share)).alias("_cut"))
    timed = rows.join(cut, "instrument").withColumn("_early", F.unix_micros(F.col("ts").cast("timestamp")) <= F.col("_cut"))
    folder = shared_folder(rows.sparkSession, "meta")  # boosting reads its rows many times
    timed.write.parquet(folder)
    timed = rows.sparkSession.read.schema(timed.schema).parquet(folder)
    model = fit_meta(timed.where("_early"))
    scored = model.transform(timed.where("not _early")).withColumn("score", vector_to_array("probability")[1])
    return scored.select("instrument", "ts", "label", "score", decide(F.col("score")).alias("size"))


def importance(model: PipelineModel, spark, top: int | None = None) -> DataFrame:
    """(place, feature, importance) of the trees' splits, largest first, all of them or the first so many."""
    found = sorted(zip(FEATURES, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(k + 1, n, v) for k, (n, v) in enumerate(found[:top])], "place int, feature string, importance double")


def with_next_return(rows: DataFrame, bars: DataFrame, *, from_close: bool = False) -> DataFrame:
    """rows with ret_next, the next bar's return from its open to its close, which the label judges; 0 without a
    next bar. from_close takes it from the day's own close, as the model did: label and size then share a close."""
    w = ind.by_time()
    start = F.col("close") if from_close else F.lead("open").over(w)
    moved = bars.select("instrument", "ts", (F.lead("close").over(w) / start - 1).alias("ret_next"))
    return rows.join(moved, ["instrument", "ts"]).fillna(0.0, ["ret_next"])


def cpcv_roles(rows: DataFrame, groups: int = 6, test: int = 2, purge: int = 5, embargo: int = 2) -> tuple[DataFrame, dict]:
    """rows (instrument, ts, ...) with their place, and for each path two conditions on them: test and train.

    An instrument's rows in time are cut into ``groups`` of equal size (the last takes the rest); a path tests
    on ``test`` of them and trains on the others, less the rows up to ``purge`` before and ``embargo`` after a
    test group. Fewer rows than groups are in no path.
    """
    w = ind.by_time()
    placed = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy("instrument")))
    size = F.floor(F.col("_len") / groups)
    end = lambda g: F.col("_len") if g == groups - 1 else (g + 1) * size
    some = lambda combo, before, after: (size > 0) & F.array_contains(F.array(*[(F.col("_n") >= g * size - before) & (F.col("_n") < end(g) + after) for g in combo]), True)
    paths = {k: (some(c, 0, 0), (size > 0) & ~some(c, purge, embargo)) for k, c in enumerate(itertools.combinations(range(groups), test))}
    return placed, paths


def cpcv_returns(rows: DataFrame, *, trees: int = 100, take: float = 0.55, at_once: int = 4, **how) -> DataFrame:
    """(path, instrument, ts, r) of every path's test rows: a model fitted on the path's train rows takes the rows
    that score above ``take``; a taken row gains its next return's size if its label is 1, else loses it: its side
    times the return that the label judges.

    rows: labelled decisions with FEATURES and ret_next. Paths with fewer than 30 train or 10 test rows are left
    out. Fits of several paths run at once, each a Spark job on rows written once.
    """
    spark = rows.sparkSession
    placed, paths = cpcv_roles(rows, **how)
    folder = shared_folder(spark, "cpcv")
    placed.write.parquet(f"{folder}/rows")
    placed = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    counts = placed.agg(*[F.count_if(c).alias(f"{n}{k}") for k, roles in paths.items() for n, c in zip(("test", "train"), roles)]).first()  # one row
    wanted = [k for k in paths if counts[f"train{k}"] >= 30 and counts[f"test{k}"] >= 10]
    schema = "instrument string, ts {}, r double".format(placed.schema["ts"].dataType.simpleString())

    def score(k):
        tested, train = paths[k]
        scored = fit_meta(placed.where(train), trees).transform(placed.where(tested))
        gain = (2 * F.col("label") - 1) * F.abs("ret_next")
        scored.select("instrument", "ts", F.when(vector_to_array("probability")[1] > take, gain).otherwise(0.0).alias("r")).write.parquet(f"{folder}/paths/path={k}")

    with ThreadPool(at_once) as pool:
        pool.map(score, wanted)
    if not wanted:
        return spark.createDataFrame([], f"path int, {schema}")
    return spark.read.schema(f"{schema}, path int").parquet(f"{folder}/paths").select("path", "instrument", "ts", "r")


def cpcv_report(returns: DataFrame) -> DataFrame:
    """One row: paths, mean and deviation of their yearly Sharpe ratios, the t statistic and p of a mean above 0,
    the probabilistic Sharpe ratio of all returns, and whether p < .05 with a mean above 0."""
    sd = F.stddev_pop("r")
    per = returns.groupBy("path").agg(F.when(sd > 0, F.avg("r") / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"))
    found = per.agg(F.count(F.lit(1)).alias("paths"), F.avg("sharpe").alias("sharpe_mean"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("sharpe_std"))
    spread = F.col("sharpe_std") > 1e-12
    found = found.withColumn("t", F.when(spread, F.col("sharpe_mean") / F.col("sharpe_std") * F.sqrt("paths")).otherwise(0.0))
    half = t_p_value(F.col("t"), F.greatest(F.col("paths") - 1, F.lit(1))) / 2
    found = found.withColumn("p", F.when(~spread, 1.0).when(F.col("t") > 0, half).otherwise(1 - half))
    z = probabilistic_sharpe(returns.select(F.lit("all").alias("instrument"), "r")).select("instrument", normal_cdf("psr_z").alias("psr"))
    joined = found.withColumn("instrument", F.lit("all")).join(z, "instrument", "left")
    return joined.select("paths", "sharpe_mean", "sharpe_std", "t", "p", "psr", ((F.col("p") < 0.05) & (F.col("sharpe_mean") > 0)).alias("significant"))
