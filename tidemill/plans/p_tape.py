"""Queries over the trade tape: scans, filters, front contracts, bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, tape
from ..sources.tables import read, tape as events_tape
from .shared import OHLCV, TAPE, dated, rounded


def good(spark, sf_dir):
    return events_tape(spark, sf_dir).where("price > 0 and size > 0")


def a1_load_trades(spark, sf_dir):
    return tape.clean_trades(events_tape(spark, sf_dir)).select("instrument", "ts", "seq", "price", "size")


def b1_outright_trades(spark, sf_dir):
    messages = events_tape(spark, sf_dir).withColumn("action", F.when(F.col("side") == "N", "A").otherwise("T"))
    spreads = messages.withColumn("symbol", F.when(F.col("seq") % 7 == 0, F.concat("symbol", F.lit("-X"))).otherwise(F.col("symbol")))
    return tape.outright_trades(spreads).select("instrument", "ts", "seq", "symbol", "price")


def b2_price_decode(spark, sf_dir):
    nano = F.round(F.col("price") * 1e9).cast("long").cast("string")
    text = F.when(F.col("seq") % 2 == 0, F.col("price").cast("decimal(20,6)").cast("string")).otherwise(nano)
    return events_tape(spark, sf_dir).select("seq", F.round(tape.decode_price(text), 6).alias("price"))


def b3_parse_utc(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    return events_tape(spark, sf_dir).select("seq", tape.parse_utc(text).alias("ts"))


def b4_regular_hours(spark, sf_dir):
    return good(spark, sf_dir).where(tape.regular_hours(F.col("ts"))).select("instrument", "ts", "seq", "price")


def b5_maintenance(spark, sf_dir):
    return good(spark, sf_dir).groupBy("instrument").agg(F.count_if(tape.maintenance(F.col("ts"))).alias("n_in"), F.count_if(~tape.maintenance(F.col("ts"))).alias("n_out"))


def b9_series_violations(spark, sf_dir):
    return tape.violations(events_tape(spark, sf_dir))


def c1_front_by_count(spark, sf_dir):
    return dated(tape.front_trades(good(spark, sf_dir))).select("instrument", "trade_date", "symbol", "seq", "price")


def c2_front_by_volume(spark, sf_dir):
    trades = good(spark, sf_dir)
    return trades.join(tape.front_by_volume(trades), ["instrument", "symbol"], "left_semi").groupBy("instrument", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))


def d1_volume_bars(spark, sf_dir):
    return bars.volume_bars(good(spark, sf_dir), 500)


def d2_session_bars(spark, sf_dir):
    return dated(bars.session_bars(good(spark, sf_dir)))


def d3_h4_bars(spark, sf_dir):
    return bars.h4_bars(good(spark, sf_dir))


def d11_bar_dates(spark, sf_dir):
    return dated(bars.session_bars(good(spark, sf_dir)).select("session_date").distinct())


def d12_latest_per_key(spark, sf_dir):
    latest = events_tape(spark, sf_dir, "user_id").groupBy("instrument").agg(F.max_by(F.struct("ts", "seq", "price"), F.struct("ts", "seq")).alias("x"))
    return latest.select("instrument", "x.*")


def e15_bar_formation(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("instrument").orderBy("bar_seq")
    took = F.timestamp_diff("MICROSECOND", F.lag("close_ts").over(w), F.col("close_ts"))
    return bars.volume_bars(good(spark, sf_dir), 500).select("instrument", "bar_seq", took.alias("micros"))


def f1_latest_bars(spark, sf_dir):
    from pyspark.sql import Window

    newest = Window.partitionBy("instrument").orderBy(F.desc("session_date"))
    found = bars.session_bars(good(spark, sf_dir)).withColumn("k", F.row_number().over(newest)).where("k <= 10")
    return dated(found.select("instrument", "session_date", "close", "k"))


def d4_bar_size(spark, sf_dir):
    return bars.choose_bar_size(good(spark, sf_dir), [k * 500 for k in range(1, 21)], 45.0)


def g4_concat_tapes(spark, sf_dir):
    trades = good(spark, sf_dir)
    return trades.where("side = 'B'").unionByName(trades.where("side != 'B'")).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))


def n4_top_of_book(spark, sf_dir):
    """Each trade's quote one tick around it: the imbalance of sizes."""
    quotes = events_tape(spark, sf_dir).select("instrument", "ts", "seq", (F.col("price") - 0.01).alias("bid_px"), (F.col("price") + 0.01).alias("ask_px"), "size", ((F.col("seq") * 7) % 50).alias("ask_sz"))
    total = F.col("size") + F.col("ask_sz")
    return rounded(quotes.select("instrument", "seq", ((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"), F.when(total > 0, (F.col("size") - F.col("ask_sz")) / total).alias("imbalance")))


NY = "(ts - INTERVAL 5 HOUR)"
VOLUME_BARS = (
    "WITH RECURSIVE "
    + TAPE
    + """,
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY instrument ORDER BY ts, seq)::BIGINT AS cum FROM good),
ends AS (
  SELECT instrument, 0::BIGINT AS bar_seq, min(cum) AS upto FROM summed WHERE cum >= 500 GROUP BY instrument
  UNION ALL
  SELECT e.instrument, e.bar_seq + 1, (SELECT min(s.cum) FROM summed s WHERE s.instrument = e.instrument AND s.cum >= e.upto + 500)
  FROM ends e WHERE e.upto IS NOT NULL),
edges AS (
  SELECT instrument, bar_seq, coalesce(lag(upto) OVER (PARTITION BY instrument ORDER BY bar_seq), 0) AS lo, upto
  FROM ends WHERE upto IS NOT NULL),
vbars AS (
  SELECT s.instrument, bar_seq, max(ts) AS close_ts, """
    + OHLCV
    + """
  FROM summed s JOIN edges e ON s.instrument = e.instrument AND s.cum > e.lo AND s.cum <= e.upto
  GROUP BY s.instrument, bar_seq)
"""
)

QUERIES = {f.__name__: f for f in (a1_load_trades, b1_outright_trades, b2_price_decode, b3_parse_utc, b4_regular_hours, b5_maintenance, b9_series_violations, c1_front_by_count, c2_front_by_volume, d1_volume_bars, d2_session_bars, d3_h4_bars, d4_bar_size, d11_bar_dates, d12_latest_per_key, e15_bar_formation, f1_latest_bars, g4_concat_tapes, n4_top_of_book)}

W = "WITH " + TAPE
SQL = {
    "a1_load_trades": W + "SELECT instrument, ts, seq, price, size FROM good",
    "b1_outright_trades": W + "SELECT instrument, ts, seq, symbol, price FROM tape WHERE side <> 'N' AND seq % 7 <> 0",
    "b2_price_decode": W + "SELECT seq, round(CASE WHEN seq % 2 = 0 THEN price::DECIMAL(20,6)::DOUBLE ELSE round(price * 1e9) * 1e-9 END, 6) AS price FROM tape",
    "b3_parse_utc": W + "SELECT seq, ts FROM tape",
    "b4_regular_hours": W + "SELECT instrument, ts, seq, price FROM good WHERE hour(ts) * 60 + minute(ts) BETWEEN 810 AND 1199",
    "b5_maintenance": W + "SELECT instrument, count(*) FILTER (WHERE m) AS n_in, count(*) FILTER (WHERE NOT m) AS n_out FROM (SELECT *, hour(ts) * 60 + minute(ts) BETWEEN 1260 AND 1324 AS m FROM good) GROUP BY instrument",
    "b9_series_violations": W + "SELECT instrument, count(*) AS n_rows, count(*) FILTER (WHERE price IS NULL OR price <= 0) AS n_bad_price, count(*) FILTER (WHERE tie) AS n_not_increasing FROM (SELECT *, ts <= lag(ts) OVER (PARTITION BY instrument ORDER BY ts, seq) AS tie FROM tape) GROUP BY instrument",
    "c1_front_by_count": W + f", days AS (SELECT instrument, {NY}::DATE::VARCHAR AS trade_date, symbol, count(*) AS n FROM good GROUP BY ALL), best AS (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY instrument, trade_date ORDER BY n DESC, symbol) = 1) SELECT g.instrument, b.trade_date, g.symbol, seq, price FROM good g JOIN best b ON g.instrument = b.instrument AND g.symbol = b.symbol AND {NY}::DATE::VARCHAR = b.trade_date",
    "c2_front_by_volume": W + "SELECT instrument, symbol, count(*) AS n, sum(size)::BIGINT AS volume FROM good GROUP BY instrument, symbol QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY sum(size) DESC, symbol) = 1",
    "d1_volume_bars": VOLUME_BARS + "SELECT * FROM vbars",
    "d2_session_bars": W + f"SELECT instrument, ({NY} + INTERVAL 7 HOUR)::DATE::VARCHAR AS session_date, {OHLCV} FROM good GROUP BY ALL",
    "d3_h4_bars": W + f"SELECT instrument, date_trunc('hour', {NY}) - to_hours((((hour({NY}) - 17 + 24) % 24) % 4)::INTEGER) AS bar_start, {OHLCV} FROM good GROUP BY ALL",
    "d4_bar_size": "WITH RECURSIVE " + TAPE + f""",
dated AS (SELECT instrument, ts, seq, size, ({NY} + INTERVAL 7 HOUR)::DATE AS d FROM good),
part AS (SELECT *, sum(size) OVER (PARTITION BY instrument ORDER BY ts, seq)::BIGINT AS cum
         FROM (SELECT *, dense_rank() OVER (PARTITION BY instrument ORDER BY d) AS k FROM dated) WHERE k <= 5),
ends AS (
  SELECT instrument, bar_size, 0::BIGINT AS bar_seq, min(cum) FILTER (WHERE cum >= bar_size) AS upto
  FROM part, (SELECT unnest(range(500, 10001, 500)) AS bar_size) GROUP BY ALL
  UNION ALL
  SELECT e.instrument, e.bar_size, e.bar_seq + 1, (SELECT min(s.cum) FROM part s WHERE s.instrument = e.instrument AND s.cum >= e.upto + e.bar_size)
  FROM ends e WHERE e.upto IS NOT NULL),
closes AS (SELECT e.instrument, bar_size, bar_seq, ts FROM ends e JOIN part p ON p.instrument = e.instrument AND p.cum = e.upto),
took AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY instrument, bar_size ORDER BY bar_seq), ts) / 1e6 AS s FROM closes),
medians AS (SELECT instrument, bar_size, quantile_cont(s, 0.5) AS median_seconds FROM took
            WHERE s IS NOT NULL AND hour(ts) * 60 + minute(ts) BETWEEN 810 AND 1199 GROUP BY ALL)
SELECT instrument, min(bar_size)::BIGINT AS bar_size, arg_min(median_seconds, bar_size) AS median_seconds
FROM medians WHERE median_seconds >= 45 GROUP BY instrument""",
    "d11_bar_dates": W + f"SELECT DISTINCT ({NY} + INTERVAL 7 HOUR)::DATE::VARCHAR AS session_date FROM good",
    "d12_latest_per_key": W + "SELECT user_id::VARCHAR AS instrument, ts, seq, price FROM tape QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) = 1",
    "e15_bar_formation": VOLUME_BARS + "SELECT instrument, bar_seq, date_diff('microsecond', lag(close_ts) OVER (PARTITION BY instrument ORDER BY bar_seq), close_ts) AS micros FROM vbars",
    "f1_latest_bars": W + f"SELECT instrument, ({NY} + INTERVAL 7 HOUR)::DATE::VARCHAR AS session_date, last(price ORDER BY ts, seq) AS close, row_number() OVER (PARTITION BY instrument ORDER BY session_date DESC)::INTEGER AS k FROM good GROUP BY instrument, session_date QUALIFY k <= 10",
    "g4_concat_tapes": W + "SELECT side, count(*) AS n, sum(size)::BIGINT AS volume FROM good GROUP BY side",
    "n4_top_of_book": W + "SELECT instrument, seq, round(((price - 0.01) + (price + 0.01)) / 2, 6) AS mid, round(CASE WHEN size + (seq * 7) % 50 > 0 THEN (size - (seq * 7) % 50) / (size + (seq * 7) % 50) END, 6) AS imbalance FROM tape",
}
