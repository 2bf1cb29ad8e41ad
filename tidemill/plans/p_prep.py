"""Queries over conditioned series and indicators of the daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import prep
from ..sources.tables import daily_bars, macro, tape
from .shared import BARS, RETURNS, TAPE, rounded


def closes(spark, sf_dir):
    """Daily closes as a price series: (instrument, ts, seq, price)."""
    return daily_bars(spark, sf_dir).select("instrument", "ts", F.lit(0).alias("seq"), F.col("close").alias("price"))


def returns(spark, sf_dir):
    return prep.log_returns(closes(spark, sf_dir))


def dirty(spark, sf_dir):
    """The tape's prices with errors: every 11th is zero, every 13th repeats the time before it."""
    t = tape(spark, sf_dir).select("instrument", "ts", "seq", F.when(F.col("seq") % 11 == 0, 0.0).otherwise(F.round("price")).alias("price"))
    w = Window.partitionBy("instrument").orderBy("ts", "seq")
    return t.withColumn("ts", F.when(F.col("seq") % 13 == 0, F.coalesce(F.lag("ts").over(w), F.col("ts"))).otherwise(F.col("ts")))


def a2_close_series(spark, sf_dir):
    return closes(spark, sf_dir).select("instrument", "ts", "price")


def d5_clean_report(spark, sf_dir):
    return prep.clean_report(dirty(spark, sf_dir), 2)


def d6_anomaly_rate(spark, sf_dir):
    return rounded(prep.flag_anomalies(returns(spark, sf_dir)).groupBy("instrument").agg(F.avg(F.col("any_flag").cast("double")).alias("rate")), 9)


def e1_log_returns(spark, sf_dir):
    return rounded(prep.rebuild(returns(spark, sf_dir)).select("instrument", "ts", "ret", "rebuilt"))


def e2_conditioned_bars(spark, sf_dir):
    return rounded(prep.condition(returns(spark, sf_dir)).select("instrument", "ts", "price", "ret", "sigma", "scaled", "sigma_next"), 6, "price")


def e3_anomaly_flags(spark, sf_dir):
    return prep.flag_anomalies(returns(spark, sf_dir)).select("instrument", "ts", "z_flag", "iqr_flag", "vol_flag", "any_flag")


def e4_repair(spark, sf_dir):
    return prep.repair(prep.drop_duplicate_times(dirty(spark, sf_dir))).select("instrument", "ts", "price", "repaired")


def e5_stale_runs(spark, sf_dir):
    runs = prep.run_length(prep.repair(prep.drop_duplicate_times(dirty(spark, sf_dir))))
    return runs.groupBy("instrument", "run").agg(F.count(F.lit(1)).alias("n"))


def e6_train_scale(spark, sf_dir):
    return rounded(prep.scale_by_train(returns(spark, sf_dir), 252).select("instrument", "ts", "z", "mu", "sd"))


def e7_atr(spark, sf_dir):
    return rounded(ind.atr(daily_bars(spark, sf_dir)).select("instrument", "ts", "tr", "atr"), 7)


def e8_rsi(spark, sf_dir):
    return rounded(ind.rsi(daily_bars(spark, sf_dir)).select("instrument", "ts", "rsi"))


def e9_moving_averages(spark, sf_dir):
    bars = ind.ema(daily_bars(spark, sf_dir), 12, "ema12")
    return rounded(bars.select("instrument", "ts", ind.sma("close", 50).alias("ma50"), ind.sma("close", 200).alias("ma200"), "ema12"))


def e10_candle_body(spark, sf_dir):
    return rounded(ind.body(daily_bars(spark, sf_dir)).select("instrument", "ts", "body_dir", "body_pct", "upper_wick", "lower_wick"))


def e11_candle_patterns(spark, sf_dir):
    found = ind.patterns(ind.body(daily_bars(spark, sf_dir)))
    return found.select("instrument", "ts", "engulfing_bull", "engulfing_bear", "pin_bull", "pin_bear", "inside_bar", "doji")


def e12_technical_rows(spark, sf_dir):
    return rounded(ind.technical(daily_bars(spark, sf_dir)).select("instrument", "ts", "ret_pct", "vs_ma50", "vs_ma200", "vol5", "vol20", "atr", "rsi", "body_pct"))


def e13_yield_changes(spark, sf_dir):
    from ..operators.macro import spread_changes

    return rounded(spread_changes(macro(spark, sf_dir)), 9)


def e14_run_days(spark, sf_dir):
    signs = returns(spark, sf_dir).where("ret is not null").withColumn("state", (F.col("ret") > 0).cast("int"))
    return prep.run_length(signs, "state").select("instrument", "ts", "state", F.col("run").cast("long").alias("days"))


QUERIES = {f.__name__: f for f in (a2_close_series, d5_clean_report, d6_anomaly_rate, e1_log_returns, e2_conditioned_bars, e3_anomaly_flags, e4_repair, e5_stale_runs, e6_train_scale, e7_atr, e8_rsi, e9_moving_averages, e10_candle_body, e11_candle_patterns, e12_technical_rows, e13_yield_changes, e14_run_days)}

P = "PARTITION BY instrument ORDER BY ts"
B, R = "WITH " + BARS + " ", "WITH " + RETURNS + " "
FLAGS = (
    "WITH "
    + RETURNS
    + f""",
base AS (SELECT instrument, ts, ret FROM rets WHERE ret IS NOT NULL),
s AS (
  SELECT *, count(ret) OVER b AS n, avg(ret) OVER b AS mu0, stddev_samp(ret) OVER b AS sd0,
         quantile_cont(ret, 0.25) OVER b AS q10, quantile_cont(ret, 0.75) OVER b AS q30
  FROM base WINDOW b AS ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
g AS (SELECT instrument, ts, ret, CASE WHEN n >= 30 THEN mu0 END AS mu, CASE WHEN n >= 30 THEN sd0 END AS sd,
             CASE WHEN n >= 30 THEN q10 END AS q1, CASE WHEN n >= 30 THEN q30 END AS q3 FROM s),
m AS (
  SELECT *, count(sd) OVER c AS k, quantile_cont(sd, 0.5) OVER c AS rv0
  FROM g WINDOW c AS ({P} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
flags AS (
  SELECT instrument, ts, coalesce(sd > 0 AND abs((ret - mu) / sd) > 3, false) AS z_flag,
         coalesce(ret < q1 - 1.5 * (q3 - q1) OR ret > q3 + 1.5 * (q3 - q1), false) AS iqr_flag,
         coalesce(sd > 3 * CASE WHEN k >= 30 THEN rv0 END, false) AS vol_flag FROM m)
"""
)
DIRTY = (
    "WITH "
    + TAPE
    + """,
moved AS (
  SELECT instrument, seq, CASE WHEN seq % 11 = 0 THEN 0.0 ELSE round(price) END AS price,
         CASE WHEN seq % 13 = 0 THEN coalesce(lag(ts) OVER (PARTITION BY instrument ORDER BY ts, seq), ts) ELSE ts END AS ts
  FROM tape),
single AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY instrument, ts ORDER BY seq DESC) = 1),
fixed AS (
  SELECT instrument, ts, seq, price <= 0 AS repaired,
         last_value(CASE WHEN price > 0 THEN price END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
  FROM single),
usable AS (SELECT * FROM fixed WHERE price IS NOT NULL),
marked AS (SELECT *, coalesce(price <> lag(price) OVER (PARTITION BY instrument ORDER BY ts, seq), true)::INT AS ch FROM usable),
islands AS (SELECT *, sum(ch) OVER (PARTITION BY instrument ORDER BY ts, seq) AS grp FROM marked),
runs AS (SELECT *, row_number() OVER (PARTITION BY instrument, grp ORDER BY ts, seq)::INTEGER AS run FROM islands)
"""
)


def ewm_sql(source: str, column: str, alpha: str) -> str:
    """adjust=False recurrence as a fold over each row's history."""
    return f"list_reduce(list({column}) OVER ({P}), lambda a, x: a * (1 - {alpha}) + x * {alpha})"


ATR = B + f", t AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({P})), 0), coalesce(abs(low - lag(close) OVER ({P})), 0)) AS tr FROM bars)"
SQL = {
    "a2_close_series": B + "SELECT instrument, ts, close AS price FROM bars",
    "d5_clean_report": DIRTY + "SELECT i.instrument, n_input, n_input - n_single AS n_dropped, n_repaired, coalesce(n_stale, 0) AS n_stale FROM (SELECT instrument, count(*) AS n_input FROM moved GROUP BY 1) i JOIN (SELECT instrument, count(*) AS n_single, count(*) FILTER (WHERE price <= 0) AS n_repaired FROM single GROUP BY 1) s USING (instrument) LEFT JOIN (SELECT instrument, count(*) FILTER (WHERE run >= 2) AS n_stale FROM runs GROUP BY 1) r USING (instrument)",
    "d6_anomaly_rate": FLAGS + "SELECT instrument, round(avg((z_flag OR iqr_flag OR vol_flag)::INT), 9) AS rate FROM flags GROUP BY instrument",
    "e1_log_returns": R + f"SELECT instrument, ts, round(ret, 6) AS ret, round(first_value(close) OVER ({P}) * exp(coalesce(sum(ret) OVER ({P}), 0)), 6) AS rebuilt FROM rets",
    "e2_conditioned_bars": R + f", s AS (SELECT *, CASE WHEN count(ret) OVER b >= 64 THEN stddev_samp(ret) OVER b END AS sg, CASE WHEN count(ret) OVER c >= 64 THEN stddev_samp(ret) OVER c END AS nx FROM rets WINDOW b AS ({P} ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING), c AS ({P} ROWS BETWEEN 255 PRECEDING AND CURRENT ROW)) SELECT instrument, ts, close AS price, round(ret, 6) AS ret, round(sg, 6) AS sigma, round(CASE WHEN sg > 0 THEN ret / sg END, 6) AS scaled, round(nx, 6) AS sigma_next FROM s",
    "e3_anomaly_flags": FLAGS + "SELECT *, z_flag OR iqr_flag OR vol_flag AS any_flag FROM flags",
    "e4_repair": DIRTY + "SELECT instrument, ts, price, repaired FROM usable",
    "e5_stale_runs": DIRTY + "SELECT instrument, run, count(*) AS n FROM runs GROUP BY ALL",
    "e6_train_scale": R + f", n AS (SELECT *, row_number() OVER ({P}) AS k FROM rets WHERE ret IS NOT NULL), f AS (SELECT instrument, avg(ret) AS mu, CASE WHEN stddev_samp(ret) > 1e-12 THEN stddev_samp(ret) ELSE 1.0 END AS sd FROM n WHERE k <= 252 GROUP BY 1) SELECT instrument, ts, round((ret - mu) / sd, 6) AS z, round(mu, 6) AS mu, round(sd, 6) AS sd FROM n JOIN f USING (instrument)",
    "e7_atr": ATR + f" SELECT instrument, ts, round(tr, 7) AS tr, round({ewm_sql('t', 'tr', '2 / 15.0::DOUBLE')}, 7) AS atr FROM t",
    "e9_moving_averages": B + f"SELECT instrument, ts, round(CASE WHEN count(*) OVER a >= 50 THEN avg(close) OVER a END, 6) AS ma50, round(CASE WHEN count(*) OVER b >= 200 THEN avg(close) OVER b END, 6) AS ma200, round({ewm_sql('bars', 'close', '2 / 13.0::DOUBLE')}, 6) AS ema12 FROM bars WINDOW a AS ({P} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS ({P} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)",
    "e8_rsi": B + f", m AS (SELECT *, greatest(coalesce(close - lag(close) OVER ({P}), 0), 0) AS gain, greatest(-coalesce(close - lag(close) OVER ({P}), 0), 0) AS loss, row_number() OVER ({P}) AS n FROM bars), w AS (SELECT *, list_reduce(list(gain) OVER ({P}), lambda a, x: a * (13 / 14.0::DOUBLE) + x) AS up, list_reduce(list(loss) OVER ({P}), lambda a, x: a * (13 / 14.0::DOUBLE) + x) AS dn FROM m) SELECT instrument, ts, round(CASE WHEN n >= 14 AND dn <> 0 THEN 100 - 100 / (1 + up / dn) ELSE 50 END, 6) AS rsi FROM w",
    "e10_candle_body": B + "SELECT instrument, ts, sign(close - open)::INTEGER AS body_dir, round(CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END, 6) AS body_pct, round(CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END, 6) AS upper_wick, round(CASE WHEN high > low THEN (least(open, close) - low) / (high - low) ELSE 0 END, 6) AS lower_wick FROM bars",
    "e11_candle_patterns": B + f", c AS (SELECT *, sign(close - open) AS d, abs(close - open) AS s, CASE WHEN high > low THEN high - low END AS r FROM bars), q AS (SELECT *, lag(d) OVER ({P}) AS pd, lag(s) OVER ({P}) AS ps, lag(high) OVER ({P}) AS ph, lag(low) OVER ({P}) AS pl FROM c) SELECT instrument, ts, coalesce(d = 1 AND pd = -1 AND s > ps, false) AS engulfing_bull, coalesce(d = -1 AND pd = 1 AND s > ps, false) AS engulfing_bear, coalesce((least(open, close) - low) / r > 0.6 AND s / r < 0.25, false) AS pin_bull, coalesce((high - greatest(open, close)) / r > 0.6 AND s / r < 0.25, false) AS pin_bear, coalesce(high <= ph AND low >= pl, false) AS inside_bar, coalesce(s / r < 0.1, false) AS doji FROM q",
    "e13_yield_changes": "WITH y AS (SELECT o_orderdate AS date, avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') / 1e5 AS us, avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') / 1e5 AS de0 FROM orders GROUP BY 1), f AS (SELECT date, us, last_value(de0 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS de FROM y WHERE us IS NOT NULL), s AS (SELECT date, us, de, (us - de) * 100 AS bps FROM f WHERE de IS NOT NULL) SELECT date, round(bps, 9) AS spread_bps, round(bps - lag(bps, 5) OVER w, 9) AS spread_d5, round(bps - lag(bps, 20) OVER w, 9) AS spread_d20, round(us - lag(us, 1) OVER w, 9) AS us_d1, round(us - lag(us, 5) OVER w, 9) AS us_d5, round(us - lag(us, 20) OVER w, 9) AS us_d20 FROM s WINDOW w AS (ORDER BY date)",
    "e14_run_days": R + f", s AS (SELECT instrument, ts, (ret > 0)::INTEGER AS state FROM rets WHERE ret IS NOT NULL), c AS (SELECT *, coalesce(state <> lag(state) OVER ({P}), true)::INT AS ch FROM s), g AS (SELECT *, sum(ch) OVER ({P}) AS grp FROM c) SELECT instrument, ts, state, row_number() OVER (PARTITION BY instrument, grp ORDER BY ts) AS days FROM g",
}
SQL["e12_technical_rows"] = (
    ATR
    + ", rsi AS ("
    + SQL["e8_rsi"].replace(B, "WITH ", 1).replace("WITH , m AS", "WITH m AS", 1)
    + f"), x AS (SELECT t.*, {ewm_sql('t', 'tr', '2 / 15.0::DOUBLE')} AS atr, close / lag(close) OVER ({P}) - 1 AS r FROM t) SELECT x.instrument, x.ts, round(100 * r, 6) AS ret_pct, round(CASE WHEN count(*) OVER a >= 50 THEN close / (avg(close) OVER a) - 1 END, 6) AS vs_ma50, round(CASE WHEN count(*) OVER b >= 200 THEN close / (avg(close) OVER b) - 1 END, 6) AS vs_ma200, round(CASE WHEN count(r) OVER c >= 5 THEN stddev_samp(r) OVER c END, 6) AS vol5, round(CASE WHEN count(r) OVER d >= 20 THEN stddev_samp(r) OVER d END, 6) AS vol20, round(atr, 6) AS atr, rsi, round(CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END, 6) AS body_pct FROM x JOIN rsi USING (instrument, ts) WINDOW a AS (PARTITION BY x.instrument ORDER BY x.ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (PARTITION BY x.instrument ORDER BY x.ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), c AS (PARTITION BY x.instrument ORDER BY x.ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), d AS (PARTITION BY x.instrument ORDER BY x.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
)
