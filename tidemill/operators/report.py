"""The ladder's readings, the structure verdict and the characterisation report of each instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import binomial_p, chi2_sf, t_p_value
from . import characterize as ch
from . import ladder as lad
from .fits import adf, kpss_p, structural_breaks
from .loop import kpss


def readings(arc: DataFrame) -> DataFrame:
    """Per instrument, model and step: r2, dm and its p, sign accuracy and its p, crps, and whether the model
    beats the naive one: r2 above 0 and p under .05."""
    dm = lad.diebold_mariano(arc).select(*lad.KEY, "dm", t_p_value(F.col("dm"), F.col("n") - 1).alias("dm_p"))
    signs = lad.directions(arc).withColumn("k", F.round(F.col("accuracy") * F.col("n")).cast("long"))
    signs = signs.select(*lad.KEY, "accuracy", binomial_p(F.col("k"), F.col("n")).alias("sign_p"))
    rows = lad.r2_oos(arc).join(signs, lad.KEY).join(lad.crps(lad.pinball(arc)), lad.KEY).join(dm, lad.KEY, "left")
    return rows.withColumn("beats_naive", F.coalesce((F.col("r2") > 0) & (F.col("dm") > 0) & (F.col("dm_p") < 0.05), F.lit(False)))


def signal_model(read: DataFrame, step: int = 1) -> DataFrame:
    """(instrument, signal_model): the best r2 among the models that beat the naive one, else the volatility
    rung, else the naive one."""
    best = F.max_by(F.when(F.col("beats_naive"), F.col("model")), F.when(F.col("beats_naive"), F.col("r2")))
    found = read.where(F.col("step") == step).groupBy("instrument").agg(best.alias("m"), F.max((F.col("model") == "garch").cast("int")).alias("g"))
    return found.select("instrument", F.coalesce("m", F.when(F.col("g") == 1, "garch").otherwise("naive-rw")).alias("signal_model"))


def classify(read: DataFrame, tests: DataFrame, step: int = 1) -> DataFrame:
    """(instrument, structure): nonlinear if a foundation rung beats the naive one and the best simple rung;
    linear if the autoregression does, with a real sign edge; vol_only if returns are white, squares are not and
    the volatility rung has the better density; linear if the autoregression beats the naive one at all; else
    efficient. tests: (instrument, lb_p, lb_sq_p)."""
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    wide = read.where(F.col("step") == step).groupBy("instrument").agg(
        *[of(m, c).alias(f"{n}_{c}") for m, n in (("ar", "ar"), ("garch", "garch"), ("foundation", "top"), ("naive-rw", "naive")) for c in ("r2", "beats_naive", "sign_p", "accuracy", "crps")]
    )
    simple = F.greatest(F.coalesce("ar_r2", F.lit(float("-inf"))), F.coalesce("garch_r2", F.lit(float("-inf"))))
    top = F.coalesce(F.col("top_beats_naive") & (F.col("top_r2") > simple + 1e-6), F.lit(False))
    ar = F.coalesce(F.col("ar_beats_naive"), F.lit(False))
    edge = F.coalesce((F.col("ar_sign_p") < 0.05) & (F.col("ar_accuracy") > 0.5), F.lit(False))
    vol = F.coalesce((F.col("lb_p") >= 0.05) & (F.col("lb_sq_p") < 0.01) & (F.col("garch_crps") < F.col("naive_crps")), F.lit(False))
    verdict = F.when(top, "nonlinear").when(ar & edge, "linear").when(vol, "vol_only").when(ar, "linear").otherwise("efficient")
    return wide.join(tests, "instrument", "left").select("instrument", verdict.alias("structure"))


def edge_horizon(arc: DataFrame, models: DataFrame) -> DataFrame:
    """(instrument, edge): the largest step at which the signal model has skill; 0 without any."""
    skill = lad.r2_oos(arc).join(models, "instrument").where(F.col("model") == F.col("signal_model"))
    return skill.groupBy("instrument").agg(F.coalesce(F.max(F.when(F.col("r2") > 0, F.col("step"))), F.lit(0)).alias("edge"))


def regime_skill(arc: DataFrame, regimes: DataFrame, at: str = "target") -> DataFrame:
    """(instrument, model, regime, n, r2, predictable) of one-step forecasts by the regime at their target, as a report
    looks back on them, or at their origin (at="origin"), as they were known. regimes: (instrument, n, regime)."""
    labels = regimes.select("instrument", F.col("n").alias(at), "regime")
    rows = lad.against_naive(arc.where("step = 1")).join(labels, ["instrument", at])
    sse = lambda c: F.sum((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
    found = rows.groupBy("instrument", "model", "regime").agg(F.count(F.lit(1)).alias("n"), F.when(sse("base") > 1e-24, 1 - sse("mean") / sse("base")).otherwise(0.0).alias("r2"))
    return found.withColumn("predictable", F.col("r2") > 0)


def ljung_box_p(series: DataFrame, lags: int = 20) -> DataFrame:
    """(instrument, lb_p, lb_sq_p) of returns and squares."""
    q = ch.ljung_box(series, lags)
    return q.select("instrument", chi2_sf(F.col("q_ret"), F.lit(float(lags))).alias("lb_p"), chi2_sf(F.col("q_sq"), F.lit(float(lags))).alias("lb_sq_p"))


def report(series: DataFrame, arc: DataFrame) -> DataFrame:
    """One row for each instrument: structure, edge horizon, regimes without skill, the current regime, unit-root
    and level tests, breaks, memory, autocorrelation, entropy."""
    read, tests = readings(arc), ljung_box_p(series)
    models, regimes = signal_model(read), ch.volatility_regimes(series)
    weak = regime_skill(arc, regimes).join(models, "instrument").where("model = signal_model and not predictable")
    parts = [
        classify(read, tests), models, edge_horizon(arc, models), tests, ch.hurst(series), ch.permutation_entropy(series),
        adf(series).select("instrument", F.col("p").alias("adf_p")), kpss(series).select("instrument", "t", kpss_p(F.col("kpss")).alias("kpss_p")),
        structural_breaks(series).groupBy("instrument").agg(F.array_sort(F.collect_list("break_at")).alias("breaks")),
        weak.groupBy("instrument").agg(F.array_sort(F.collect_set("regime")).alias("unpredictable")),
        regimes.groupBy("instrument").agg(F.max_by("regime", "n").alias("regime")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "instrument", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("stationary", (F.col("adf_p") < 0.05) & (F.col("kpss_p") > 0.05)).withColumn("unpredictable", F.coalesce("unpredictable", none))
    return out.withColumn("breaks", F.coalesce("breaks", F.array().cast("array<bigint>")))
