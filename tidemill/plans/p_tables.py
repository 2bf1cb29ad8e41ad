"""Queries that use a data source or table functions of the library, and those on two bar lengths at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import register
from ..operators import bars
from ..operators import decisions as dec
from ..operators import indicators as ind
from ..sources.days import read_days, write_days
from ..sources.tables import shared_folder
from .p_decisions import VPIN
from .p_ladder import SQL as LADDER_SQL
from .p_ladder import S, series
from .p_tape import NY, W, good
from .shared import OHLCV, dated, rounded


def a4_zst_days(spark, sf_dir):
    """The tape written as Zstandard CSV by day, and a range of days read back."""
    folder = shared_folder(spark, "days")
    write_days(good(spark, sf_dir).select("instrument", "seq", "price", "size", F.to_date("ts").alias("day")), folder)
    rows = read_days(spark, folder, "day date, instrument string, seq long, price double, size long", "2024-01-05", "2024-01-12")
    return dated(rows.groupBy("day", "instrument").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.max("price").alias("high")))


def p3_splits(spark, sf_dir):
    """Walk-forward splits of each series, in SQL text."""
    register(spark)
    rows = series(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).cast("int").alias("len"))
    return spark.sql("SELECT instrument, s.* FROM {rows}, LATERAL walk_splits(len, 5, 252, 5, 5) s", rows=rows)


def p3_split_lags(spark, sf_dir):
    """How many origins of each series have each lag, in SQL text."""
    register(spark)
    rows = series(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).cast("int").alias("len"))
    return spark.sql("SELECT instrument, lag, count(*) AS n, min(train_stop) AS first_stop FROM {rows}, LATERAL split_lags(len, 1, 300, 7, 2, 4) s GROUP BY instrument, lag", rows=rows)


def p3_volume_buckets(spark, sf_dir):
    """Volume buckets of the tape, in SQL text."""
    register(spark)
    trades = good(spark, sf_dir).select("instrument", "ts", "seq", "size", "side")
    trades.createOrReplaceTempView("bucket_trades")
    return spark.sql("SELECT * FROM volume_buckets(TABLE(bucket_trades) PARTITION BY instrument ORDER BY (ts, seq), 500)")


def sessions(spark, sf_dir):
    """The tape's sessions with what their four-hour bars show."""
    trades = good(spark, sf_dir)
    return ind.with_h4(bars.session_bars(trades), bars.h4_bars(trades))


def e12_h4_rows(spark, sf_dir):
    return rounded(dated(sessions(spark, sf_dir).select("instrument", "session_date", *ind.H4_PART)))


def l4_session_confirmations(spark, sf_dir):
    """All confirmations of a side that goes by the day, on the tape's sessions."""
    rows = sessions(spark, sf_dir).withColumnRenamed("session_date", "ts")
    tech = ind.patterns(ind.technical(rows)).withColumn("direction", F.when(F.dayofmonth("ts") % 2 == 0, "long").otherwise("short"))
    checks = dec.confirmations(tech)
    return dated(checks.groupBy("ts", "check").agg(F.count(F.lit(1)).alias("n"), F.count_if("confirmed").alias("n_confirmed")))


def l4_timeframes(spark, sf_dir):
    rows = sessions(spark, sf_dir).withColumnRenamed("session_date", "ts")
    tech = ind.patterns(ind.technical(rows)).withColumn("direction", F.when(F.dayofmonth("ts") % 2 == 0, "long").otherwise("short"))
    return dated(dec.confirmations(tech).where("check = 'timeframes'"))


QUERIES = {f.__name__: f for f in (a4_zst_days, p3_splits, p3_split_lags, p3_volume_buckets, e12_h4_rows, l4_session_confirmations, l4_timeframes)}
#: Four-hour bars end on sessions' ends, so a bar is known to the session it lies in.
H4 = (
    W
    + f""",
d AS (SELECT DISTINCT instrument, ({NY} + INTERVAL 7 HOUR)::DATE AS sd FROM good),
b4 AS (SELECT instrument, date_trunc('hour', {NY}) - to_hours((((hour({NY}) - 17 + 24) % 24) % 4)::INTEGER) AS bs, {OHLCV} FROM good GROUP BY ALL),
h0 AS (SELECT *, (bs + INTERVAL 7 HOUR)::DATE AS sd, close / lag(close) OVER w - 1 AS r, CASE WHEN close > open THEN 1 ELSE -1 END AS di FROM b4 WINDOW w AS (PARTITION BY instrument ORDER BY bs)),
h1 AS (SELECT *, count(*) OVER s AS k, first(close) OVER s AS c6, count(r) OVER s AS kr, stddev_samp(r) OVER s AS v, di + lag(di) OVER w AS two FROM h0
       WINDOW w AS (PARTITION BY instrument ORDER BY bs), s AS (PARTITION BY instrument ORDER BY bs ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
h4 AS (SELECT d.instrument, d.sd, round(100 * r, 6) AS h4_return_pct, CASE WHEN r IS NOT NULL THEN sign(close - open)::INTEGER END AS h4_body,
              round(CASE WHEN k >= 6 THEN 100 * (close / c6 - 1) END, 6) AS h4_trend6_pct, round(CASE WHEN kr >= 2 THEN v END, 6) AS h4_vol6, two AS h4_two
       FROM d JOIN h1 ON h1.instrument = d.instrument AND h1.sd <= d.sd QUALIFY row_number() OVER (PARTITION BY d.instrument, d.sd ORDER BY bs DESC) = 1)"""
)
SQL = {
    "e12_h4_rows": H4 + " SELECT instrument, sd::VARCHAR AS session_date, h4_return_pct, h4_body, h4_trend6_pct, h4_vol6, h4_two FROM h4",
    "l4_timeframes": H4 + " SELECT instrument, sd::VARCHAR AS ts, 'timeframes' AS check, coalesce(CASE WHEN day(sd) % 2 = 0 THEN h4_two = 2 ELSE h4_two = -2 END, false) AS confirmed FROM h4",
    "a4_zst_days": W + " SELECT ts::DATE::VARCHAR AS day, instrument, count(*) AS n, sum(size)::BIGINT AS volume, max(price) AS high FROM good WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY ALL",
    "p3_splits": LADDER_SQL["w1_splits"],
    "p3_split_lags": S + ", l AS (SELECT instrument, count(*)::INTEGER AS len FROM ser GROUP BY 1), o AS (SELECT instrument, unnest(generate_series(301, len - 2, 7))::INTEGER AS origin FROM l WHERE len > 302) SELECT instrument, lag::INTEGER AS lag, count(*) AS n, min(origin - 1)::INTEGER AS first_stop FROM o, (VALUES (1), (2), (3), (4)) k(lag) GROUP BY ALL",
    "p3_volume_buckets": W + VPIN + " SELECT * FROM vb",
}
