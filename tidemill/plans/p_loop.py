"""Queries over the closed loop and the characterisation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import loop, report
from ..operators.bars import session_date
from ..sources.tables import daily_bars
from .p_decisions import BACK, DECIDED, decided
from .p_ladder import S, series, stored_arc
from .p_tape import NY, W, good
from .shared import dated, rounded


def sessions(spark, sf_dir):
    return good(spark, sf_dir).withColumn("session_date", session_date(F.col("ts")))


def sides(spark, sf_dir):
    """A side for each instrument and session: long on even days of the month."""
    days = sessions(spark, sf_dir).select("instrument", "session_date").distinct()
    return days.withColumn("side", F.when(F.dayofmonth("session_date") % 2 == 0, "long").otherwise("short"))


def m1_events(spark, sf_dir):
    d = decided(spark, sf_dir).withColumn("fallback", F.when(F.dayofmonth("ts") % 5 == 0, "long").otherwise("flat"))
    return rounded(loop.extract_events(d))


def m2_opportunity(spark, sf_dir):
    return dated(rounded(loop.opportunity(sides(spark, sf_dir), sessions(spark, sf_dir)).select("instrument", "session_date", "side", "mfe", "mae", "close_return", "path_ratio"), 4))


def m4_slippage(spark, sf_dir):
    t = sessions(spark, sf_dir)
    fills = t.where("seq % 20 = 0").select("instrument", "session_date", (F.col("price") * 0.0001).alias("fill"))
    expected = t.groupBy("instrument", "session_date").agg((F.min_by("price", F.struct("ts", "seq")) * 0.0001).alias("entry"))
    return rounded(loop.slippage(fills, expected).select("instrument", "n", "slip", "max_spread"), 5)


def l17_intraday_replay(spark, sf_dir):
    return dated(rounded(loop.intraday_replay(sessions(spark, sf_dir), sides(spark, sf_dir)), 4))


def l23_stress_windows(spark, sf_dir):
    windows = spark.createDataFrame([("early", "1992-06-01", "1993-06-01"), ("late", "1996-01-01", "1997-01-01")], "name string, lo string, hi string")
    windows = windows.select("name", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"))
    curve = dec.backtest(decided(spark, sf_dir), daily_bars(spark, sf_dir))
    return rounded(loop.stress_windows(curve, windows), 2, "worst_day")


def k2_kpss(spark, sf_dir):
    return rounded(loop.kpss(series(spark, sf_dir)))


def k10_structure(spark, sf_dir):
    """The structure verdict of each instrument from the ladder's readings and the autocorrelation tests."""
    return report.classify(report.readings(stored_arc(spark, sf_dir)), report.ljung_box_p(series(spark, sf_dir)))


def e20_flat_streaks(spark, sf_dir):
    return loop.flat_streaks(decided(spark, sf_dir))


def a15_snapshot(spark, sf_dir):
    return loop.snapshot(decided(spark, sf_dir).select("instrument", "ts", "direction", F.col("size").cast("string").alias("size")), ["instrument", "ts"])


def l14_gated_predictions(spark, sf_dir):
    """Sizes by the probability gates; an efficient structure or a flat primary stays flat."""
    from ..operators.meta import decide

    d = decided(spark, sf_dir).withColumn("p", 0.5 + F.col("strength") / 2)
    flat = (F.col("direction") == "flat") | (F.dayofweek("ts") == 2)
    return d.select("instrument", "ts", F.when(flat, "flat").otherwise(F.col("direction")).alias("direction"), F.when(flat, 0.0).otherwise(decide(F.col("p"))).alias("size"))


QUERIES = {f.__name__: f for f in (m1_events, m2_opportunity, m4_slippage, l17_intraday_replay, l23_stress_windows, k2_kpss, k10_structure, e20_flat_streaks, a15_snapshot, l14_gated_predictions)}

SES = W + f", ss AS (SELECT *, ({NY} + INTERVAL 7 HOUR)::DATE AS sd FROM good), d AS (SELECT instrument, sd, first(price ORDER BY ts, seq) AS en, last(price ORDER BY ts, seq) AS ex, max(price) AS hi, min(price) AS lo, CASE WHEN day(sd) % 2 = 0 THEN 1 ELSE -1 END AS sg FROM ss GROUP BY instrument, sd)"
SQL = {
    "m1_events": DECIDED + " SELECT instrument, ts, CASE WHEN direction <> 'flat' THEN direction ELSE 'long' END AS side, round(strength, 6) AS confidence FROM dcs WHERE direction <> 'flat' OR day(ts) % 5 = 0",
    "m2_opportunity": SES + ", x AS (SELECT *, CASE WHEN sg > 0 THEN hi - en ELSE en - lo END / 0.0001::DOUBLE AS mfe, CASE WHEN sg > 0 THEN lo - en ELSE en - hi END / 0.0001::DOUBLE AS mae, CASE WHEN sg > 0 THEN ex - en ELSE en - ex END / 0.0001::DOUBLE AS cr FROM d) SELECT instrument, sd::VARCHAR AS session_date, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END AS side, round(mfe, 4) AS mfe, round(mae, 4) AS mae, round(cr, 4) AS close_return, round(CASE WHEN mfe - mae > 0 THEN mfe / (mfe - mae) ELSE 0.5 END, 4) AS path_ratio FROM x",
    "m4_slippage": SES + ", m AS (SELECT s.instrument, count(*) AS n, avg(abs(s.price * 0.0001::DOUBLE - en * 0.0001::DOUBLE) / 0.0001::DOUBLE) AS slip FROM ss s JOIN d USING (instrument, sd) WHERE seq % 20 = 0 GROUP BY 1) SELECT instrument, n, round(slip, 5) AS slip, CASE WHEN slip > 1 THEN greatest(1.0, round(2.0 - 0.5 * (slip - 1), 2)) ELSE 2.0 END AS max_spread FROM m",
    "l17_intraday_replay": SES + " SELECT instrument, sd::VARCHAR AS session_date, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END AS side, round(100 * (sg * (CASE WHEN sg > 0 THEN hi ELSE lo END - en) / en), 4) AS mfe_pct, round(100 * (sg * (CASE WHEN sg > 0 THEN lo ELSE hi END - en) / en), 4) AS mae_pct, round(100000 * (sg * (ex - en) / en), 4) AS pnl FROM d",
    "l23_stress_windows": BACK + ", w AS (SELECT * FROM (VALUES ('early', TIMESTAMP '1992-06-01', TIMESTAMP '1993-06-01'), ('late', TIMESTAMP '1996-01-01', TIMESTAMP '1997-01-01')) t(name, lo, hi)), j AS (SELECT name, cv.*, equity - max(equity) OVER (PARTITION BY name, instrument ORDER BY ts) AS dd FROM cv JOIN w ON ts >= lo AND ts < hi), wt AS (SELECT name, instrument, ts AS t0, equity - dd AS pk FROM j QUALIFY row_number() OVER (PARTITION BY name, instrument ORDER BY dd, ts) = 1), rc AS (SELECT name, instrument, date_diff('day', min(t0)::DATE, min(ts)::DATE)::INTEGER AS days_to_recover FROM j JOIN wt USING (name, instrument) WHERE ts > t0 AND equity >= pk GROUP BY 1, 2), g AS (SELECT name, instrument, round(min(dd), 2) AS max_loss, min(pnl) AS worst_day, round(avg((direction = 'flat')::INT), 2) AS flat_share, round(avg(size), 2) AS mean_size FROM j GROUP BY 1, 2) SELECT * FROM g LEFT JOIN rc USING (name, instrument)",
    "k2_kpss": S + ", e AS (SELECT instrument, n, ret - avg(ret) OVER (PARTITION BY instrument) AS e, count(*) OVER (PARTITION BY instrument) AS t FROM ser), s AS (SELECT *, sum(e) OVER (PARTITION BY instrument ORDER BY n) AS s, ceil(4 * pow(t / 100, 0.25))::INTEGER AS lg FROM e), p AS (SELECT a.instrument, sum(2 * (1 - (a.n - b.n) / (a.lg + 1)) * a.e * b.e) AS w FROM s a JOIN s b ON a.instrument = b.instrument AND b.n < a.n AND b.n >= a.n - a.lg GROUP BY 1), g AS (SELECT instrument, t, sum(s * s) AS ss, sum(e * e) AS ee FROM s GROUP BY 1, 2) SELECT instrument, t, round(ss / t / (ee + w), 6) AS kpss FROM g JOIN p USING (instrument)",
    "e20_flat_streaks": DECIDED + ", g AS (SELECT *, sum((direction <> 'flat')::INT) OVER (PARTITION BY instrument ORDER BY ts) AS g FROM dcs), l AS (SELECT instrument, max(ts) AS last_ts, max(g) AS g FROM g GROUP BY 1) SELECT instrument, last_ts, count(*) FILTER (WHERE direction = 'flat') AS flat_days FROM g JOIN l USING (instrument, g) GROUP BY 1, 2",
    "a15_snapshot": DECIDED + """ SELECT instrument, ts, '{"direction":"' || direction || '","size":"' || CASE size WHEN 1 THEN '1.0' WHEN 0.5 THEN '0.5' ELSE '0.0' END || '"}' AS snapshot FROM dcs""",
    "l14_gated_predictions": DECIDED + " SELECT instrument, ts, CASE WHEN direction = 'flat' OR isodow(ts) = 1 THEN 'flat' ELSE direction END AS direction, CASE WHEN direction = 'flat' OR isodow(ts) = 1 THEN 0 WHEN 0.5 + strength / 2 >= 0.7 THEN 1 WHEN 0.5 + strength / 2 >= 0.55 THEN 0.5 ELSE 0 END::DOUBLE AS size FROM dcs",
}
