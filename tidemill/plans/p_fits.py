"""Queries over fitted rungs, unit-root tests, breaks, regimes and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characterize as ch
from ..operators import fits, prep
from ..operators import ladder as lad
from ..operators import report as rep
from ..operators.loop import kpss
from ..sources.tables import shared_folder
from .p_ladder import ARC, BREAK, N, REGIMES, S, arc, series
from .p_loop import SQL as LOOP_SQL
from .p_prep import returns
from .shared import rounded


def full_arc(spark, sf_dir, horizon=4):
    """The walk-forward archive of all rungs, written once: its scores read it many times."""
    folder = shared_folder(spark, "archive")
    rows = fits.walk_forward(series(spark, sf_dir), horizon=horizon)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def j2_ar_aic(spark, sf_dir):
    rows = fits.ar_by_aic(series(spark, sf_dir), horizon=2)
    return rounded(rows.select("instrument", "origin", "step", "y", "mean", F.element_at("q", 9).alias("q99")), 6)


def j4_garch_t(spark, sf_dir):
    rows = fits.garch_t(series(spark, sf_dir), horizon=2)
    return rounded(rows.select("instrument", "origin", "step", "mean", F.element_at("q", 1).alias("q01"), F.element_at("q", 9).alias("q99")), 6)


def j6_t_grid(spark, sf_dir):
    rows = prep.condition(returns(spark, sf_dir)).where("sigma_next is not null").withColumn("nu", (3 + F.dayofmonth("ts") % 5).cast("double"))
    g = F.transform(fits.t_grid("nu"), lambda z: z * F.col("sigma_next"))
    return rounded(rows.withColumn("g", g).select("instrument", "ts", "nu", F.element_at("g", 1).alias("q01"), F.element_at("g", 9).alias("q99")), 6)


def j7_own_rung(spark, sf_dir):
    """A rung of the user's own (the last return again) and one that has nothing to say, beside the naive one."""

    def again(series_, *, horizon, **_):
        rows = series_.select("instrument", "n", "ret", fits._future(horizon).alias("ys")).where("n >= 251")
        return fits._steps(rows, "again", horizon, F.array("ret"), F.array(F.lit(0.01)), F.array(*[F.lit(z) for z in lad.Z]))

    rows = fits.walk_forward(series(spark, sf_dir), {"naive-rw": fits.naive_by_step, "again": again, "silent": lambda *_, **__: None}, horizon=1)
    return rounded(lad.r2_oos(rows), 6)


def w2_walk_forward(spark, sf_dir):
    rows = full_arc(spark, sf_dir)
    return rounded(rows.groupBy("instrument", "model", "step").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mae")), 7)


def k1_adf(spark, sf_dir):
    return rounded(fits.adf(series(spark, sf_dir)).drop("start"), 6)


def k2_kpss_p(spark, sf_dir):
    return rounded(kpss(series(spark, sf_dir)).select("instrument", fits.kpss_p(F.col("kpss")).alias("p")), 5)


def k3_rolling_stationarity(spark, sf_dir):
    return rounded(fits.rolling_stationarity(series(spark, sf_dir)), 6)


def k4_structural_breaks(spark, sf_dir):
    return rounded(fits.structural_breaks(series(spark, sf_dir), penalty=0.5), 5)


def k4_first_break(spark, sf_dir):
    return rounded(fits.structural_breaks(series(spark, sf_dir), penalty=0.2, max_depth=1), 5)


def k10_readings(spark, sf_dir):
    a = full_arc(spark, sf_dir, 1)
    return rounded(rep.readings(a).select("instrument", "model", "r2", "dm_p", "sign_p", "beats_naive"), 5)


def k11_regime_skill(spark, sf_dir):
    return rounded(rep.regime_skill(arc(spark, sf_dir), ch.volatility_regimes(series(spark, sf_dir))), 6)


def k11_edge_horizon(spark, sf_dir):
    a = full_arc(spark, sf_dir)
    return rep.edge_horizon(a, rep.signal_model(rep.readings(a)))


def k12_report(spark, sf_dir):
    found = rep.report(series(spark, sf_dir), full_arc(spark, sf_dir))
    return rounded(found.withColumn("breaks", F.array_join("breaks", "|")).withColumn("unpredictable", F.array_join("unpredictable", "|")), 5)


def l7_markov_regimes(spark, sf_dir):
    return rounded(fits.markov_regimes(series(spark, sf_dir), every=120), 4)


def l7_regime_flips(spark, sf_dir):
    return fits.regime_flips(fits.markov_regimes(series(spark, sf_dir), every=120))


QUERIES = {f.__name__: f for f in (j2_ar_aic, j4_garch_t, j6_t_grid, j7_own_rung, w2_walk_forward, k1_adf, k2_kpss_p, k3_rolling_stationarity, k4_structural_breaks, k4_first_break, k10_readings, k11_regime_skill, k11_edge_horizon, k12_report, l7_markov_regimes, l7_regime_flips)}

KPSS = LOOP_SQL["k2_kpss"].replace("SELECT instrument, t, round(ss / t / (ee + w), 6) AS kpss FROM g JOIN p USING (instrument)", ", z AS (SELECT instrument, ss / t / (ee + w) AS s FROM g JOIN p USING (instrument))").replace(" , z AS", ", z AS")
SQL = {
    "j7_own_rung": S + f", nq AS (SELECT *, lead(ret) OVER ({N}) AS y FROM ser), k AS (SELECT * FROM nq WHERE n >= 251 AND y IS NOT NULL) SELECT instrument, 'again' AS model, 1 AS step, round(1 - sum((y - ret) * (y - ret)) / sum(y * y), 6) AS r2 FROM k GROUP BY 1 UNION ALL SELECT instrument, 'naive-rw', 1, 0.0 FROM k GROUP BY 1",
    "k2_kpss_p": KPSS + " SELECT instrument, round(CASE WHEN s <= 0.347 THEN 0.1 WHEN s <= 0.463 THEN 0.1 - 0.05 * (s - 0.347) / 0.116 WHEN s <= 0.574 THEN 0.05 - 0.025 * (s - 0.463) / 0.111 WHEN s <= 0.739 THEN 0.025 - 0.015 * (s - 0.574) / 0.165 ELSE 0.01 END, 5) AS p FROM z",
    "k4_first_break": S + BREAK + " SELECT instrument, break_at, round(stat, 5) AS stat FROM fb",
    "k11_regime_skill": ARC + REGIMES + " , j AS (SELECT b.*, regime FROM based b JOIN vr ON b.instrument = vr.instrument AND b.target = vr.n), g AS (SELECT instrument, model, regime, count(*) AS n, CASE WHEN sum((y - base) * (y - base)) > 1e-24 THEN 1 - sum((y - mean) * (y - mean)) / sum((y - base) * (y - base)) ELSE 0 END AS r2 FROM j GROUP BY 1, 2, 3) SELECT instrument, model, regime, n, round(r2, 6) AS r2, r2 > 0 AS predictable FROM g",
}
