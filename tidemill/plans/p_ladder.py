"""Queries over the walk-forward ladder of the daily bars' returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characterize as ch
from ..operators import fits
from ..operators import ladder as lad
from ..operators.prep import flag_anomalies
from ..sources.tables import shared_folder
from .p_prep import FLAGS, returns
from .shared import RETURNS, rounded


def series(spark, sf_dir):
    return lad.numbered(returns(spark, sf_dir))


def arc(spark, sf_dir):
    return lad.archive(series(spark, sf_dir))


def stored_arc(spark, sf_dir):
    """The archive written once, for queries that read it several times."""
    folder, rows = shared_folder(spark, "archive"), arc(spark, sf_dir)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def w1_splits(spark, sf_dir):
    return lad.splits(series(spark, sf_dir), horizon=5, min_train=252, step=5, embargo=5)


def j1_naive_rung(spark, sf_dir):
    rows = lad.naive_rung(series(spark, sf_dir))
    return rounded(rows.select("instrument", "origin", "y", F.element_at("q", 1).alias("q01"), F.element_at("q", 3).alias("q10"), F.element_at("q", 9).alias("q99")), 7)


def j3_ewma_rung(spark, sf_dir):
    rows = lad.ewma_rung(series(spark, sf_dir))
    return rounded(rows.select("instrument", "origin", "mean", F.element_at("q", 5).alias("q50"), F.element_at("q", 9).alias("q99")), 6)


def j2_ar_rung(spark, sf_dir):
    return rounded(lad.ar_rung(series(spark, sf_dir)).select("instrument", "origin", "y", "mean"), 6)


def i1_mase(spark, sf_dir):
    return rounded(lad.mase(arc(spark, sf_dir), series(spark, sf_dir)))


def i2_r2_oos(spark, sf_dir):
    return rounded(lad.r2_oos(arc(spark, sf_dir)))


def i3_direction(spark, sf_dir):
    return rounded(lad.directions(arc(spark, sf_dir)))


def i4_crps(spark, sf_dir):
    return rounded(lad.crps(lad.pinball(arc(spark, sf_dir))))


def i5_pit(spark, sf_dir):
    return rounded(lad.pit(lad.naive_rung(series(spark, sf_dir))).select("instrument", "origin", "pit"), 6)


def i6_pit_chi2(spark, sf_dir):
    return rounded(lad.pit_chi2(lad.naive_rung(series(spark, sf_dir))), 5)


def i7_coverage(spark, sf_dir):
    return rounded(lad.coverage(arc(spark, sf_dir)))


def i8_diebold_mariano(spark, sf_dir):
    return rounded(lad.diebold_mariano(arc(spark, sf_dir), horizon=2), 5)


def i9_scorecard(spark, sf_dir):
    return rounded(lad.scorecard(stored_arc(spark, sf_dir), series(spark, sf_dir)), 4)


def e18_realised_window(spark, sf_dir):
    return rounded(lad.realised_window(lad.ar_rung(series(spark, sf_dir))), 5)


def e19_vol_z(spark, sf_dir):
    return rounded(lad.vol_z(lad.ewma_rung(series(spark, sf_dir))).select("instrument", "origin", "vol", "z"), 4)


def v2_signals(spark, sf_dir):
    return rounded(lad.signals(arc(spark, sf_dir)), 5)


def gated(spark, sf_dir):
    """The gate over the archive with anomalies, regimes and breaks, each known at its origin."""
    rows = series(spark, sf_dir)
    odd = flag_anomalies(returns(spark, sf_dir)).where("any_flag").select("instrument", "ts")
    flags = rows.select("instrument", "ts", "n").join(odd, ["instrument", "ts"])
    return lad.gate(stored_arc(spark, sf_dir), flags=flags, regimes=ch.trailing_regimes(rows), breaks=fits.causal_breaks(rows))


def v3_calibration(spark, sf_dir):
    return rounded(lad.trailing_calibration(lad.ar_rung(series(spark, sf_dir))).select("instrument", "origin", "n_realised", "chi2", "calibrated"), 5)


def v4_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("instrument", "origin", F.array_join("reasons", "|").alias("reasons"), "gate")


def k4_causal_breaks(spark, sf_dir):
    return rounded(fits.causal_breaks(series(spark, sf_dir)), 5)


def k9_trailing_regimes(spark, sf_dir):
    return rounded(ch.trailing_regimes(series(spark, sf_dir)).select("instrument", "n", "vol", "regime"), 7)


def v5_gate_validation(spark, sf_dir):
    return rounded(lad.validate_gate(gated(spark, sf_dir)), 5)


QUERIES = {f.__name__: f for f in (w1_splits, j1_naive_rung, j2_ar_rung, j3_ewma_rung, i1_mase, i2_r2_oos, i3_direction, i4_crps, i5_pit, i6_pit_chi2, i7_coverage, i8_diebold_mariano, i9_scorecard, e18_realised_window, e19_vol_z, v2_signals, v3_calibration, v4_gate, v5_gate_validation, k4_causal_breaks, k9_trailing_regimes)}

N = "PARTITION BY instrument ORDER BY n"
S = (
    "WITH "
    + RETURNS
    + """,
ser AS (SELECT instrument, ts, (row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1)::INTEGER AS n, ret FROM rets WHERE ret IS NOT NULL)"""
)
LV = "[" + ", ".join(map(str, lad.LEVELS)) + "]::DOUBLE[]"
ZS = "[" + ", ".join(repr(z) for z in lad.Z) + "]::DOUBLE[]"
ARC = (
    S
    + f""",
nq AS (SELECT *, lead(ret) OVER ({N}) AS y, quantile_cont(ret, {LV}) OVER ({N} ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS qs FROM ser),
naive AS (SELECT instrument, 'naive-rw' AS model, n AS origin, 1 AS step, n + 1 AS target, y, 0.0::DOUBLE AS mean, list_transform(qs, lambda x: x - qs[5]) AS q FROM nq WHERE n >= 251 AND y IS NOT NULL),
eh AS (SELECT *, lead(ret) OVER ({N}) AS y, avg(ret) OVER ({N}) AS mu, var_samp(ret) OVER ({N}) AS v0, list(ret) OVER ({N}) AS h FROM ser),
ev AS (SELECT *, sqrt(greatest(list_reduce(list_prepend(v0, h), lambda a, x: 0.94::DOUBLE * a + (1 - 0.94::DOUBLE) * (x - mu) * (x - mu)), 1e-24)) AS s FROM eh WHERE n >= 251 AND y IS NOT NULL),
garch AS (SELECT instrument, 'garch' AS model, n AS origin, 1 AS step, n + 1 AS target, y, mu AS mean, list_transform({ZS}, lambda z: mu + s * z) AS q FROM ev),
ax AS (SELECT *, lead(ret) OVER ({N}) AS y, lag(ret) OVER ({N}) AS x FROM ser),
asum AS (SELECT *, count(x) OVER w AS k, sum(x) OVER w AS sx, sum(CASE WHEN x IS NOT NULL THEN ret END) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(x * ret) OVER w AS sxy, sum(CASE WHEN x IS NOT NULL THEN ret * ret END) OVER w AS syy FROM ax WINDOW w AS ({N})),
ac AS (SELECT *, sxx - sx * sx / k AS cxx, sxy - sx * sy / k AS cxy, syy - sy * sy / k AS cyy FROM asum),
ap AS (SELECT *, CASE WHEN cxx > 0 THEN cxy / cxx ELSE 0 END AS phi FROM ac WHERE n >= 251 AND y IS NOT NULL),
am AS (SELECT *, (sy - phi * sx) / k + phi * ret AS m, sqrt(greatest((cyy - phi * cxy) / greatest(k - 2, 1), 1e-24)) AS s FROM ap),
ar AS (SELECT instrument, 'ar' AS model, n AS origin, 1 AS step, n + 1 AS target, y, m AS mean, list_transform({ZS}, lambda z: m + s * z) AS q FROM am),
arc AS (SELECT * FROM naive UNION ALL SELECT * FROM garch UNION ALL SELECT * FROM ar),
based AS (SELECT a.*, b.mean AS base FROM arc a JOIN naive b USING (instrument, step, origin))"""
)
K = "instrument, model, step"
PIT = f"""CASE WHEN y <= q[1] THEN CASE WHEN q[1] <> 0 THEN least(0.01 * (y / q[1]), 0.01) ELSE 0.01 END WHEN y >= q[9] THEN 0.99
 ELSE (SELECT lv[k] + (lv[k + 1] - lv[k]) * (y - q[k]) / (q[k + 1] - q[k]) FROM (SELECT len(list_filter(q, lambda x: x <= y)) AS k, {LV} AS lv)) END"""
PITS = f", pits AS (SELECT *, greatest(0, least(1, {PIT})) AS pit FROM naive)"
SQL = {
    "w1_splits": S + ", l AS (SELECT instrument, count(*)::INTEGER AS len FROM ser GROUP BY 1), o AS (SELECT instrument, unnest(generate_series(256, len - 6, 5))::INTEGER AS origin FROM l WHERE len > 261) SELECT instrument, origin, 0 AS train_start, origin - 4 AS train_stop, origin + 1 AS test_start, origin + 6 AS test_stop, (256 + 5 * ((origin - 256) // 5 - ((origin - 256) // 5) % 21))::INTEGER AS refit_origin FROM o",
    "j1_naive_rung": ARC + " SELECT instrument, origin, round(y, 7) AS y, round(q[1], 7) AS q01, round(q[3], 7) AS q10, round(q[9], 7) AS q99 FROM naive",
    "j2_ar_rung": ARC + " SELECT instrument, origin, round(y, 6) AS y, round(mean, 6) AS mean FROM ar",
    "j3_ewma_rung": ARC + " SELECT instrument, origin, round(mean, 6) AS mean, round(q[5], 6) AS q50, round(q[9], 6) AS q99 FROM garch",
    "i1_mase": ARC + f", d AS (SELECT instrument, n, abs(ret - lag(ret) OVER ({N})) AS d FROM ser), sc AS (SELECT instrument, greatest(avg(d), 1e-12) AS s FROM d WHERE n < 252 GROUP BY 1) SELECT {K}, round(avg(abs(y - mean)) / any_value(s), 6) AS mase FROM arc JOIN sc USING (instrument) GROUP BY {K}",
    "i2_r2_oos": ARC + f" SELECT {K}, round(CASE WHEN sum((y - base) * (y - base)) > 1e-24 THEN 1 - sum((y - mean) * (y - mean)) / sum((y - base) * (y - base)) ELSE 0 END, 6) AS r2 FROM based GROUP BY {K}",
    "i3_direction": ARC + f" SELECT {K}, round(coalesce(avg((sign(y) = sign(mean))::INT) FILTER (WHERE y <> 0), 0), 6) AS accuracy, count(*) FILTER (WHERE y <> 0) AS n FROM arc GROUP BY {K}",
    "i4_crps": ARC + f", f AS (SELECT {K}, y, unnest(q) AS p, unnest({LV}) AS level FROM arc), l AS (SELECT {K}, level, avg(greatest(level * (y - p), (level - 1) * (y - p))) AS loss FROM f GROUP BY ALL), t AS (SELECT *, (lead(level) OVER w - level) * (lead(loss) OVER w + loss) / 2 AS piece FROM l WINDOW w AS (PARTITION BY {K} ORDER BY level)) SELECT {K}, round(2 * sum(piece), 6) AS crps FROM t GROUP BY {K}",
    "i5_pit": ARC + PITS + " SELECT instrument, origin, round(pit, 6) AS pit FROM pits",
    "i6_pit_chi2": ARC + PITS + f", c AS (SELECT {K}, least(floor(pit * 10), 9) AS b, count(*) AS c FROM pits GROUP BY ALL), t AS (SELECT {K}, sum(c)::BIGINT AS n, sum(c * c) AS cc FROM c GROUP BY {K}) SELECT {K}, n, round(CASE WHEN n >= 50 THEN cc / (n / 10) - n END, 5) AS chi2 FROM t",
    "i7_coverage": ARC + f" SELECT {K}, round(avg((y BETWEEN q[2] AND q[8])::INT), 6) AS coverage FROM arc GROUP BY {K}",
    "i8_diebold_mariano": ARC + f", d AS (SELECT {K}, origin, (y - base) * (y - base) - (y - mean) * (y - mean) AS d FROM based WHERE model <> 'naive-rw'), e AS (SELECT *, d - avg(d) OVER (PARTITION BY {K}) AS e FROM d), l AS (SELECT *, e * lag(e) OVER (PARTITION BY {K} ORDER BY origin) AS l1 FROM e), g AS (SELECT {K}, count(*) AS n, avg(d) AS m, avg(e * e) + avg(l1) AS lrv FROM l GROUP BY {K}) SELECT {K}, n, round(CASE WHEN n >= 8 AND lrv > 1e-24 THEN m / sqrt(lrv / n) * sqrt((n + 1 - 4 + 2 / n) / n) ELSE 0 END, 5) AS dm FROM g",
    "e18_realised_window": ARC + f", w AS (SELECT {K}, origin, count(*) OVER b AS n, stddev_pop(mean) OVER b / greatest(stddev_pop(y) OVER b, 1e-12) AS r FROM ar WINDOW b AS (PARTITION BY {K} ORDER BY target ROWS BETWEEN 121 PRECEDING AND 2 PRECEDING)) SELECT {K}, origin, n AS n_realised, round(CASE WHEN n >= 30 THEN r END, 5) AS std_ratio FROM w",
    "e19_vol_z": ARC + f", v AS (SELECT {K}, origin, (q[7] - q[3]) / 2 AS vol FROM garch), w AS (SELECT *, count(*) OVER b AS n, stddev_pop(vol) OVER b AS sd, avg(vol) OVER b AS m FROM v WINDOW b AS (PARTITION BY {K} ORDER BY origin ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)) SELECT instrument, origin, round(vol, 4) AS vol, round(CASE WHEN n > 10 AND sd > 0 THEN (vol - m) / sd END, 4) AS z FROM w",
}
SIGNALS = ", sp AS (SELECT instrument, step, origin, stddev_pop(mean) AS sd, count(*) AS k FROM arc WHERE model <> 'naive-rw' GROUP BY ALL), mine AS (SELECT *, (q[7] - q[3]) / 2 AS vol FROM ar), sig AS (SELECT m.instrument, m.step, m.origin, y, tanh(mean / greatest(vol, 1e-12)) AS direction, CASE WHEN k < 2 THEN 0.5 ELSE greatest(0, least(1, 1 - sd / greatest(vol, 1e-12))) END AS conviction, vol FROM mine m JOIN sp USING (instrument, step, origin))"
SQL["v2_signals"] = ARC + SIGNALS + " SELECT instrument, step, origin, round(y, 5) AS y, round(direction, 5) AS direction, round(conviction, 5) AS conviction, round(vol, 5) AS vol FROM sig"
CHI = "list_sum(list_transform(range(10), lambda k: pow(len(list_filter(bins, lambda b: b = k)) - n120 / 10, 2) / (n120 / 10)))"
KNOWN = f", pr AS (SELECT *, greatest(0, least(1, {PIT})) AS pit FROM based WHERE model = 'ar'), kn AS (SELECT * EXCLUDE (pit), count(*) OVER b AS n120, list(least(floor(pit * 10), 9)) OVER b AS bins, stddev_pop(mean) OVER b / greatest(stddev_pop(y) OVER b, 1e-12) AS ratio, count(*) FILTER (WHERE y <> 0) OVER a AS ns, count(*) FILTER (WHERE y <> 0 AND sign(y) = sign(mean)) OVER a AS ks FROM pr WINDOW b AS (PARTITION BY {K} ORDER BY target ROWS BETWEEN 121 PRECEDING AND 2 PRECEDING), a AS (PARTITION BY {K} ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)), ct AS (SELECT *, CASE WHEN n120 >= 50 THEN {CHI} END AS chi2 FROM kn)"
SQL["v3_calibration"] = ARC + KNOWN + f" SELECT instrument, origin, n120 AS n_realised, round(chi2, 5) AS chi2, coalesce(chi2 <= {lad.PIT_LIMIT!r}, true) AS calibrated FROM ct"
REGIMES = f", vv AS (SELECT instrument, n, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS v FROM ser WINDOW w AS ({N} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), vf AS (SELECT instrument, n, coalesce(v, first_value(v IGNORE NULLS) OVER ({N} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM vv), vr AS (SELECT f.instrument, n, CASE WHEN v <= c THEN 'calm' ELSE 'turbulent' END AS regime FROM vf f JOIN (SELECT instrument, quantile_cont(v, 0.5) AS c FROM vf GROUP BY 1) USING (instrument))"
BREAK = f", bc AS (SELECT instrument, n, abs(sum(ret * ret) OVER ({N}) / (sum(ret * ret) OVER (PARTITION BY instrument) + 1e-12) - n / (count(*) OVER (PARTITION BY instrument) - 1)) AS dev, count(*) OVER (PARTITION BY instrument) AS len FROM ser), bt AS (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY dev DESC, n) = 1), fb AS (SELECT instrument, n::BIGINT AS break_at, dev * sqrt(len) AS stat FROM bt WHERE len >= 120 AND dev * sqrt(len) > 0.2 AND n BETWEEN 60 AND len - 60)"
TRAILING = f", tv AS (SELECT instrument, n, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS v FROM ser WINDOW w AS ({N} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), tc AS (SELECT *, quantile_cont(v, 0.5) OVER ({N} ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS c FROM tv), vr AS (SELECT instrument, n, CASE WHEN v <= c THEN 'calm' ELSE 'turbulent' END AS regime FROM tc WHERE v IS NOT NULL)"
CAUSAL = f", cz AS (SELECT instrument, n, CASE WHEN count(ret) OVER w >= 60 AND avg(ret * ret) OVER w > 0 THEN least(10, ret * ret / avg(ret * ret) OVER w) - 1 END AS z FROM ser WINDOW w AS ({N} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)), cx AS (SELECT instrument, n, side, coalesce(sum(CASE side WHEN 'up' THEN z ELSE -z END - 0.5::DOUBLE) OVER (PARTITION BY instrument, side ORDER BY n), 0) AS x FROM cz, (VALUES ('up'), ('down')) d(side)), cs AS (SELECT *, x - least(0, min(x) OVER (PARTITION BY instrument, side ORDER BY n)) AS stat FROM cx), fb AS (SELECT instrument, n::BIGINT AS break_at, stat, side FROM cs QUALIFY stat > 20 AND coalesce(lag(stat) OVER (PARTITION BY instrument, side ORDER BY n), 0) <= 20), fd AS (SELECT DISTINCT instrument, unnest(range(break_at, break_at + 40)) AS origin FROM fb)"
ODD = FLAGS[len("WITH " + RETURNS) :]
SIGN_P = "least(1, 2 * list_sum(list_transform(range(least(ks, ns - ks) + 1), lambda k: exp(lgamma(ns + 1) - lgamma(k + 1) - lgamma(ns - k + 1) - ns * ln(2)))))"
GATE = (
    ODD
    + SIGNALS
    + KNOWN
    + TRAILING
    + CAUSAL
    + f", vz AS (SELECT instrument, origin, CASE WHEN count(*) OVER b > 10 AND stddev_pop(vol) OVER b > 0 THEN (vol - avg(vol) OVER b) / stddev_pop(vol) OVER b END AS z FROM mine WINDOW b AS (PARTITION BY {K} ORDER BY origin ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)), rg AS (SELECT c.*, count(*) OVER r >= 30 AND sum((y - mean) * (y - mean)) OVER r >= sum((y - base) * (y - base)) OVER r AS weak FROM ct c LEFT JOIN vr ON c.instrument = vr.instrument AND c.origin = vr.n WINDOW r AS (PARTITION BY c.instrument, regime ORDER BY target RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)), dq AS (SELECT s.instrument, s.n AS origin FROM ser s JOIN flags f ON s.instrument = f.instrument AND s.ts = f.ts WHERE z_flag OR iqr_flag OR vol_flag), gated AS (SELECT s.*, list_filter([CASE WHEN n120 >= 30 AND ratio < 0.05 THEN 'degenerate' END, CASE WHEN chi2 > {lad.PIT_LIMIT!r} THEN 'miscalibrated' END, CASE WHEN weak THEN 'bad_regime' END, CASE WHEN fd.origin IS NOT NULL THEN 'structural_break' END, CASE WHEN dq.origin IS NOT NULL THEN 'data_quality' END, CASE WHEN conviction < 0.35 THEN 'low_conviction' END, CASE WHEN ns >= 30 AND {SIGN_P} > 0.1 THEN 'weak_direction' END, CASE WHEN n120 >= 120 AND z > 1.5 THEN 'high_vol' END], lambda x: x IS NOT NULL) AS rs FROM sig s JOIN rg USING (instrument, origin) JOIN vz USING (instrument, origin) LEFT JOIN fd ON s.instrument = fd.instrument AND fd.origin = s.origin LEFT JOIN dq ON s.instrument = dq.instrument AND s.origin = dq.origin), states AS (SELECT *, CASE WHEN list_has_any(rs, ['degenerate', 'miscalibrated', 'bad_regime', 'structural_break', 'data_quality']) THEN 'VETO' WHEN len(rs) > 0 THEN 'GO_REDUCED' ELSE 'GO' END AS gate FROM gated)"
)
SQL["k4_causal_breaks"] = S + CAUSAL + " SELECT instrument, break_at, round(stat, 5) AS stat, side FROM fb"
SQL["k9_trailing_regimes"] = S + TRAILING + " SELECT instrument, n, round(v, 7) AS vol, regime FROM vr JOIN tc USING (instrument, n)"
SQL["v4_gate"] = ARC + GATE + " SELECT instrument, origin, array_to_string(rs, '|') AS reasons, gate FROM states"
SQL["v5_gate_validation"] = ARC + GATE + ", p AS (SELECT *, direction * conviction AS raw, CASE gate WHEN 'VETO' THEN 0 WHEN 'GO_REDUCED' THEN 0.5 ELSE 1 END * direction * conviction * y AS g FROM states), x AS (SELECT *, raw * y AS u, raw <> 0 AND y <> 0 AND sign(raw) <> sign(y) AS lost FROM p) SELECT instrument, round(avg((gate = 'VETO')::INT), 5) AS veto_rate, round(avg((gate = 'GO_REDUCED')::INT), 5) AS reduced_rate, round(avg((gate = 'GO')::INT), 5) AS go_rate, round(CASE WHEN stddev_pop(u) > 0 THEN avg(u) / stddev_pop(u) * sqrt(252) ELSE 0 END, 5) AS sharpe_ungated, round(CASE WHEN stddev_pop(g) > 0 THEN avg(g) / stddev_pop(g) * sqrt(252) ELSE 0 END, 5) AS sharpe_gated, round(CASE WHEN count(*) FILTER (WHERE gate = 'VETO') > 0 THEN count(*) FILTER (WHERE gate = 'VETO' AND u < 0) / count(*) FILTER (WHERE gate = 'VETO') ELSE 0 END, 5) AS veto_precision, round(CASE WHEN count(*) FILTER (WHERE lost) > 0 THEN count(*) FILTER (WHERE lost AND gate = 'VETO') / count(*) FILTER (WHERE lost) ELSE 0 END, 5) AS veto_recall FROM x GROUP BY instrument"
