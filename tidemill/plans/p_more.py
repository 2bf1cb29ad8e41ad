"""Queries over keyed tables, rules, alerts and cross-validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import indicators as ind
from ..operators import ladder as lad
from ..operators import micro, prep, records, rules
from ..operators.asof import asof_day
from ..operators.bars import session_bars
from ..operators.macro import spread_changes
from ..operators.report import readings, signal_model
from ..sources.feeds import sampled_paths
from ..sources.tables import daily_bars, macro, read, tape
from .p_decisions import ALIGNED, BACK, DECIDED, VPIN, decided
from .p_ladder import ARC, GATE, K, S, arc, gated, series, stored_arc
from .p_prep import ATR, B, P, R, ewm_sql, returns
from .p_tape import NY, W, good
from .shared import dated, rounded


def a8_upsert(spark, sf_dir):
    rows = tape(spark, sf_dir, "user_id").select("instrument", "ts", "seq", "price")
    return records.upsert(rows.where("seq % 3 = 0"), rows.where("seq % 3 != 0"), ["instrument"], order="seq")


def a11_features_extra(spark, sf_dir):
    rows = prep.log_returns(daily_bars(spark, sf_dir).select("instrument", "ts", F.lit(0).alias("seq"), F.col("close").alias("price"), "n_trades", "volume"))
    return records.features_with_extra(rows.select("instrument", "ts", "n_trades", "volume"), ["instrument", "ts"])


def a12_days_not_done(spark, sf_dir):
    days = session_bars(good(spark, sf_dir)).select("session_date").distinct()
    done = session_bars(good(spark, sf_dir).where("side = 'B' and size > 95")).select("session_date").distinct()
    return dated(records.not_done(days, done, "session_date"))


def a13_next_pull(spark, sf_dir):
    rows = good(spark, sf_dir).select("instrument", "ts", "seq")
    done = rows.where("seq % 50 = 0 and instrument != 'view'").select("instrument", F.col("ts").alias("ts_end"), F.when(F.col("seq") % 100 == 0, "ok").otherwise("error").alias("status"))
    return records.next_pull(rows, done, "ts", F.lit("2024-12-31").cast("timestamp_ntz"), 240)


def a13_catch_up(spark, sf_dir):
    """The same where instruments that are more than five days behind pull half a day."""
    rows = good(spark, sf_dir).select("instrument", "ts", "seq")
    done = rows.where("seq % 100 = 0").select("instrument", F.col("ts").alias("ts_end"), F.when(F.col("instrument") == "view", "error").otherwise("ok").alias("status"))
    late = F.lit("2024-01-06").cast("timestamp_ntz")
    return records.next_pull(rows, done.where(F.col("ts_end") < late), "ts", F.lit("2024-12-31").cast("timestamp_ntz"), 60, now=F.lit("2024-01-08").cast("timestamp_ntz"), catch_up_minutes=720, behind_minutes=7200)


def n8_tick_returns(spark, sf_dir):
    """Returns of the tape's prices on each row's scale, clipped by each row's regime."""
    names = F.array(*[F.lit(x) for x in ("low_vol", "high_vol_choppy", "high_vol_crash", "unknown")])
    ticks = good(spark, sf_dir).select("instrument", "ts", "seq", F.col("price").alias("level"), (F.col("size") / 100).alias("scale"), F.element_at(names, (F.col("seq") % 4 + 1).cast("int")).alias("regime"))
    return rounded(micro.tick_returns(ticks, "scale", "regime").select("instrument", "seq", "scaled_return"), 6)


def a14_delete_range(spark, sf_dir):
    rows = good(spark, sf_dir).select("instrument", "ts", "seq")
    inside = F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return records.delete_where(rows, inside & (F.col("instrument") == "view")).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


def b6_fresh_forecast(spark, sf_dir):
    rows = good(spark, sf_dir).withColumn("now", F.lead("ts").over(Window.partitionBy("instrument").orderBy("ts", "seq")))
    return rows.select("instrument", "seq", rules.fresh(F.col("price"), F.col("ts"), F.col("now"), 15).alias("price"))


def b7_above_noise(spark, sf_dir):
    rows = prep.condition(returns(spark, sf_dir))
    return rows.where(rules.above_noise(F.col("scaled"), F.col("sigma"), 0.5)).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


def b8_trading_calendar(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    holidays = orders.groupBy("day").agg(F.min("o_orderkey").alias("k")).where("k % 10 = 0").select("day")
    return dated(rules.calendar(orders.select("day").distinct(), holidays))


def b10_dense_features(spark, sf_dir):
    rows = prep.condition(returns(spark, sf_dir)).select("instrument", "ts", "ret", "sigma")
    return rounded(records.dense(rows, ["sigma", "rsi", "ret"], ["instrument", "ts"]), 6)


def b11_encode(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", rules.encode(F.col("o_orderstatus"), {"O": 0, "F": 1}).alias("code"))


def b12_quote_repair(spark, sf_dir):
    t = tape(spark, sf_dir).withColumn("bid", F.when(F.col("seq") % 5 != 0, F.col("price") - 0.01)).withColumn("ask", F.when(F.col("seq") % 7 == 0, F.col("price") - 0.02).otherwise(F.col("price") + 0.01))
    bid, ask = rules.repaired_quote(F.col("bid"), F.col("ask"), F.col("price"), 0.0002)
    return rounded(t.select("seq", bid.alias("bid"), ask.alias("ask")), 6)


def c11_archive_regimes(spark, sf_dir):
    from ..operators.characterize import volatility_regimes

    regimes = volatility_regimes(series(spark, sf_dir)).select("instrument", F.col("n").alias("target"), "regime")
    rows = lad.against_naive(arc(spark, sf_dir)).join(regimes, ["instrument", "target"])
    sse = lambda c: F.sum((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
    return rounded(rows.where("model = 'ar'").groupBy("instrument", "regime").agg((1 - sse("mean") / sse("base")).alias("r2")), 6)


def c12_losses_against_naive(spark, sf_dir):
    rows = lad.against_naive(arc(spark, sf_dir)).where("model = 'garch'")
    return rounded(rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("mean")) - F.abs(F.col("y") - F.col("base"))).alias("d")), 8)


def c13_latest_with_recent(spark, sf_dir):
    t = good(spark, sf_dir)
    last = t.groupBy("instrument").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "seq")).alias("x")).select("instrument", F.col("x.ts").alias("last_ts"), F.col("x.price").alias("price"))
    recent = t.join(last.select("instrument", "last_ts"), "instrument").where("ts > last_ts - interval 15 minutes")
    counts = recent.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_recent"), F.count_if(F.col("size") > 90).alias("n_large"))
    return last.join(counts, "instrument", "left").select("instrument", "last_ts", "price", "n_recent", (F.col("n_large") / F.greatest("n_recent", F.lit(1))).alias("share"))


def c15_daily_scale(spark, sf_dir):
    rows = prep.condition(prep.log_returns(good(spark, sf_dir).select("instrument", "ts", "seq", "price")))
    last = rows.groupBy("instrument").agg(F.max_by(F.struct("ts", "price", "sigma_next"), F.struct("ts", "seq")).alias("x")).select("instrument", F.col("x.ts").alias("t1"), "x.price", "x.sigma_next")
    day = rows.join(last.select("instrument", "t1"), "instrument").where("ts > t1 - interval 24 hours").groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))
    return rounded(last.join(day, "instrument").select("instrument", "n", (F.col("sigma_next") * F.sqrt("n") * F.col("price")).alias("scale")), 5)


def d7_gate_mix(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def d9_recent_ticks(spark, sf_dir):
    t = tape(spark, sf_dir, "user_id")
    w = Window.partitionBy("instrument").orderBy(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")).rangeBetween(-900, 0)
    return t.select("instrument", "seq", F.count(F.lit(1)).over(w).alias("n15"), F.count_if(F.col("size") > 90).over(w).alias("large15"))


def d10_realised_pnl(spark, sf_dir):
    t = good(spark, sf_dir).withColumn("day", F.to_date(F.col("ts") - F.expr("INTERVAL 5 HOURS")))
    w = Window.partitionBy("instrument", "day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("side") == "B", 1).when(F.col("side") == "A", -1).otherwise(0)
    return rounded(t.select("instrument", "seq", F.sum(sign * F.col("price")).over(w).alias("pnl")), 4)


def d13_run_status(spark, sf_dir):
    errors = tape(spark, sf_dir, "user_id").groupBy("instrument").agg(F.count_if((F.col("size") > 97)).alias("errors"))
    return errors.select("instrument", rules.run_status(F.col("errors")).alias("status"))


def f3_signal_model(spark, sf_dir):
    """The best model that beats the naive one, else the volatility rung."""
    return signal_model(readings(stored_arc(spark, sf_dir)))


def g3_purged_train(spark, sf_dir):
    return rules.cpcv_members(series(spark, sf_dir).select("instrument", "n"), rules.cpcv_paths(spark))


def i10_ladder(spark, sf_dir):
    found = readings(stored_arc(spark, sf_dir)).where("model != 'naive-rw'")
    return rounded(found.select("instrument", "model", "step", "r2", "dm", "beats_naive"), 5)


def j5_path_quantiles(spark, sf_dir):
    paths = sampled_paths(read(spark, sf_dir, "embeddings"))
    q = rules.path_quantiles(paths, lad.LEVELS)
    return rounded(q.select("origin", "step", "mean", F.element_at("q", 1).alias("q01"), F.element_at("q", 5).alias("q50"), F.element_at("q", 9).alias("q99")), 6)


def l13_probabilistic_sharpe(spark, sf_dir):
    rows = returns(spark, sf_dir).where("ret is not null").select("instrument", (F.col("ret") - 0.01).alias("r"))
    return rounded(rules.probabilistic_sharpe(rows), 5)


def l18_trade_summary(spark, sf_dir):
    t = dec.backtest(decided(spark, sf_dir), daily_bars(spark, sf_dir)).where("direction != 'flat' and size > 0")
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    return rounded(t.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), (F.sum(win) / -F.sum(loss)).alias("profit_factor"), F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae")), 5)


def l22_cost_sweep(spark, sf_dir):
    """Total profit for each cost of a one-at-a-time grid."""
    t = dec.backtest(decided(spark, sf_dir), daily_bars(spark, sf_dir), ticks_per_side=0.0)
    grid = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 2.0, 4.0)])).alias("ticks")
    cost = F.when(F.col("direction") != "flat", F.col("ticks") * 0.5).otherwise(0.0)
    swept = t.select("instrument", "direction", "size", "net_points", grid)
    return rounded(swept.groupBy("instrument", "ticks").agg(F.sum(F.col("size") * 50 * (F.col("net_points") - cost)).alias("pnl")), 1)


def l22_sensitivity(spark, sf_dir):
    """How far profit moves with the cost, relative to one tick a side."""
    swept = l22_cost_sweep(spark, sf_dir).select("instrument", F.col("ticks").alias("value"), F.col("pnl").alias("score"))
    return rounded(dec.sensitivity(swept), 4)


def l24_alerts(spark, sf_dir):
    rows = ind.atr(daily_bars(spark, sf_dir)).join(decided(spark, sf_dir).select("instrument", "ts", "direction"), ["instrument", "ts"])
    known = spread_changes(macro(spark, sf_dir)).where("spread_d5 is not null")
    rows = asof_day(rows, known, "ts", "date", ["spread_d5"])
    return rules.alerts(rows).groupBy("instrument", "alert").agg(F.count(F.lit(1)).alias("n"))


def l25_target_position(spark, sf_dir):
    return rules.target_position(decided(spark, sf_dir)).select("instrument", "ts", "position", "change")


def m5_daily_swap(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return rounded(bars.select("instrument", "ts", rules.daily_swap(F.lit(0.02), F.col("close"), F.to_date("ts")).alias("pips")), 3)


def v1_predictive_std(spark, sf_dir):
    rows = lad.ar_rung(series(spark, sf_dir))
    return rounded(rows.select("instrument", "origin", ((F.element_at("q", 7) - F.element_at("q", 3)) / 2).alias("std"), (F.element_at("q", 8) - F.element_at("q", 2)).alias("width90")), 5)


def v7_price_levels(spark, sf_dir):
    rows = prep.condition(returns(spark, sf_dir))
    newest = rows.groupBy("instrument").agg(F.max_by(F.struct("price", "sigma_next"), "ts").alias("x")).select("instrument", "x.*")
    q = lambda z: F.col("price") * F.exp(z * F.col("sigma_next"))
    return rounded(newest.select("instrument", q(-1.2815515655446004).alias("p10"), q(0.0).alias("p50"), q(1.2815515655446004).alias("p90")), 6)


QUERIES = {f.__name__: f for f in (a8_upsert, a11_features_extra, a12_days_not_done, a13_next_pull, a13_catch_up, n8_tick_returns, a14_delete_range, b6_fresh_forecast, b7_above_noise, b8_trading_calendar, b10_dense_features, b11_encode, b12_quote_repair, c11_archive_regimes, c12_losses_against_naive, c13_latest_with_recent, c15_daily_scale, d7_gate_mix, d9_recent_ticks, d10_realised_pnl, d13_run_status, f3_signal_model, g3_purged_train, l22_sensitivity, i10_ladder, j5_path_quantiles, l13_probabilistic_sharpe, l18_trade_summary, l22_cost_sweep, l24_alerts, l25_target_position, m5_daily_swap, v1_predictive_std, v7_price_levels)}

COND = R + f", s AS (SELECT *, CASE WHEN count(ret) OVER b >= 64 THEN stddev_samp(ret) OVER b END AS sg, CASE WHEN count(ret) OVER c >= 64 THEN stddev_samp(ret) OVER c END AS nx FROM rets WINDOW b AS ({P} ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING), c AS ({P} ROWS BETWEEN 255 PRECEDING AND CURRENT ROW))"
SESSION = f"({NY} + INTERVAL 7 HOUR)::DATE::VARCHAR"
ALERTS = (
    DECIDED
    + ATR[len(B) :]
    + f", ab AS (SELECT instrument, ts, close, {ewm_sql('t', 'tr', '2 / 15.0::DOUBLE')} AS atr FROM t), "
    + ALIGNED
    + f", sp AS (SELECT date, (us - de) * 100 - lag((us - de) * 100, 5) OVER (ORDER BY date) AS d5 FROM al), j AS (SELECT a.*, direction FROM ab a JOIN dcs USING (instrument, ts)), x AS (SELECT j.*, d5, abs(close - lag(close) OVER ({P})) > 3 * atr AS mv, j.ts > lag(j.ts) OVER ({P}) + INTERVAL 48 HOUR AS st, sum((direction <> 'flat')::INT) OVER ({P}) AS g FROM j ASOF LEFT JOIN (SELECT * FROM sp WHERE d5 IS NOT NULL) s ON j.ts >= s.date), y AS (SELECT *, row_number() OVER (PARTITION BY instrument, g ORDER BY ts) - (g > 0)::INT AS run FROM x), z AS (SELECT instrument, unnest(list_filter([CASE WHEN mv THEN 'move' END, CASE WHEN direction = 'flat' AND run >= 5 THEN 'flat_days' END, CASE WHEN st THEN 'stale' END, CASE WHEN abs(d5) > 50 THEN 'spread' END], lambda a: a IS NOT NULL)) AS alert FROM y) SELECT instrument, alert, count(*) AS n FROM z GROUP BY 1, 2"
)
T_LIMIT = "(1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * (n - 1)) + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * pow(n - 1, 2)))"
READ = f", r AS (SELECT {K}, 1 - sum((y - mean) * (y - mean)) / sum((y - base) * (y - base)) AS r2, count(*) AS n, avg((y - base) * (y - base) - (y - mean) * (y - mean)) AS m, var_pop((y - base) * (y - base) - (y - mean) * (y - mean)) AS g FROM based WHERE model <> 'naive-rw' GROUP BY {K}), rd AS (SELECT *, m / sqrt(g / n) * sqrt((n - 1) / n) AS dm, r2 > 0 AND m / sqrt(g / n) * sqrt((n - 1) / n) > {T_LIMIT} AS beats_naive FROM r)"
SQL = {
    "a8_upsert": W + "SELECT user_id::VARCHAR AS instrument, ts, seq, price FROM tape QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (seq % 3 <> 0)::INT DESC, seq DESC) = 1",
    "a11_features_extra": B + """SELECT instrument, ts, '{"n_trades":' || n_trades || ',"volume":' || volume || '}' AS extra FROM bars""",
    "a12_days_not_done": W + f"SELECT DISTINCT {SESSION} AS session_date FROM good WHERE {SESSION} NOT IN (SELECT {SESSION} FROM good WHERE side = 'B' AND size > 95)",
    "a13_catch_up": W + ", f AS (SELECT instrument, min(ts) - INTERVAL 1 MICROSECOND AS t0, max(CASE WHEN seq % 100 = 0 AND instrument <> 'view' AND ts < TIMESTAMP '2024-01-06' THEN ts END) AS t1 FROM good GROUP BY 1), m AS (SELECT instrument, coalesce(t1, t0) AS mk FROM f), c AS (SELECT *, CASE WHEN mk + INTERVAL 7200 MINUTE < TIMESTAMP '2024-01-08' THEN 720 ELSE 60 END AS mins FROM m) SELECT instrument, ts, seq FROM good JOIN c USING (instrument) WHERE ts > mk AND ts <= mk + to_minutes(mins)",
    "n8_tick_returns": W + ", r AS (SELECT *, CASE seq % 4 WHEN 0 THEN 2.5 WHEN 2 THEN 5.0 ELSE 3.5 END::DOUBLE AS most, coalesce((price / lag(price) OVER (PARTITION BY instrument ORDER BY ts, seq) - 1) / greatest(size / 100, 1e-4), 0) AS raw FROM good) SELECT instrument, seq, round(greatest(-most, least(most, raw)), 6) AS scaled_return FROM r",
    "a13_next_pull": W + ", f AS (SELECT instrument, min(ts) - INTERVAL 1 MICROSECOND AS t0, max(CASE WHEN seq % 100 = 0 AND instrument <> 'view' THEN ts END) AS t1 FROM good GROUP BY 1) SELECT instrument, ts, seq FROM good JOIN f USING (instrument) WHERE ts > coalesce(t1, t0) AND ts <= coalesce(t1, t0) + INTERVAL 240 MINUTE",
    "a14_delete_range": W + "SELECT instrument, count(*) AS n FROM good WHERE NOT (instrument = 'view' AND ts BETWEEN '2024-01-10' AND '2024-01-20') GROUP BY 1",
    "b6_fresh_forecast": W + "SELECT instrument, seq, CASE WHEN ts >= lead(ts) OVER (PARTITION BY instrument ORDER BY ts, seq) - INTERVAL 15 MINUTE THEN price END AS price FROM good",
    "b7_above_noise": COND + " SELECT instrument, count(*) AS n FROM s WHERE sg > 0 AND abs(ret / sg) >= 0.5 GROUP BY 1",
    "b8_trading_calendar": "WITH d AS (SELECT o_orderdate::DATE AS day, min(o_orderkey) AS k FROM orders GROUP BY 1), t AS (SELECT day FROM d WHERE isodow(day) < 6 AND k % 10 <> 0) SELECT day::VARCHAR AS day, lead(day) OVER (ORDER BY day)::VARCHAR AS next_day FROM t",
    "b10_dense_features": COND + " SELECT instrument, ts, round(coalesce(sg, 0), 6) AS sigma, 0.0::DOUBLE AS rsi, round(coalesce(ret, 0), 6) AS ret FROM s",
    "b11_encode": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -1 END AS code FROM orders",
    "b12_quote_repair": W + ", q AS (SELECT seq, price, CASE WHEN seq % 5 <> 0 THEN price - 0.01 END AS b, CASE WHEN seq % 7 = 0 THEN price - 0.02 ELSE price + 0.01 END AS a FROM tape) SELECT seq, round(CASE WHEN b IS NULL OR b >= a THEN round(price - 0.00015, 5) ELSE b END, 6) AS bid, round(CASE WHEN b IS NULL OR b >= a THEN round(price + 0.00015, 5) ELSE a END, 6) AS ask FROM q",
    "c11_archive_regimes": ARC + ", v AS (SELECT instrument, n, CASE WHEN count(*) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS v FROM ser WINDOW w AS (PARTITION BY instrument ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), f AS (SELECT instrument, n, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vol FROM v), c AS (SELECT instrument, quantile_cont(vol, 0.5) AS cut FROM f GROUP BY 1), g AS (SELECT f.instrument, n AS target, CASE WHEN vol <= cut THEN 'calm' ELSE 'turbulent' END AS regime FROM f JOIN c USING (instrument)) SELECT instrument, regime, round(1 - sum((y - mean) * (y - mean)) / sum((y - base) * (y - base)), 6) AS r2 FROM based JOIN g USING (instrument, target) WHERE model = 'ar' GROUP BY 1, 2",
    "c12_losses_against_naive": ARC + " SELECT instrument, count(*) AS n, round(avg(abs(y - mean) - abs(y - base)), 8) AS d FROM based WHERE model = 'garch' GROUP BY 1",
    "c13_latest_with_recent": W + ", l AS (SELECT instrument, ts AS last_ts, price FROM good QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, seq DESC) = 1) SELECT l.instrument, last_ts, any_value(l.price) AS price, count(*) AS n_recent, count(*) FILTER (WHERE size > 90) / count(*) AS share FROM l JOIN good g ON l.instrument = g.instrument AND g.ts > last_ts - INTERVAL 15 MINUTE GROUP BY 1, 2",
    "c15_daily_scale": W + ", r AS (SELECT *, ln(price) - ln(lag(price) OVER (PARTITION BY instrument ORDER BY ts, seq)) AS ret FROM good), l AS (SELECT instrument, ts AS t1, price, CASE WHEN count(ret) OVER c >= 64 THEN stddev_samp(ret) OVER c END AS nx FROM r WINDOW c AS (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, seq DESC) = 1), d AS (SELECT r.instrument, count(*) AS n FROM r JOIN l ON r.instrument = l.instrument AND r.ts > l.t1 - INTERVAL 24 HOUR GROUP BY 1) SELECT instrument, n, round(nx * sqrt(n) * price, 5) AS scale FROM l JOIN d USING (instrument)",
    "d7_gate_mix": ARC + GATE + " SELECT gate, count(*) AS n FROM states GROUP BY 1",
    "d9_recent_ticks": W + ", s AS (SELECT *, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS sec FROM tape) SELECT user_id::VARCHAR AS instrument, seq, count(*) OVER w AS n15, count(*) FILTER (WHERE size > 90) OVER w AS large15 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 900 PRECEDING AND CURRENT ROW)",
    "d10_realised_pnl": W + f"SELECT instrument, seq, round(sum(CASE side WHEN 'B' THEN price WHEN 'A' THEN -price ELSE 0 END) OVER (PARTITION BY instrument, {NY}::DATE ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS pnl FROM good",
    "d13_run_status": W + ", e AS (SELECT user_id, count(*) FILTER (WHERE size > 97) AS e FROM tape GROUP BY 1) SELECT user_id::VARCHAR AS instrument, CASE WHEN e = 0 THEN 'success' WHEN e < 4 THEN 'partial' ELSE 'failed' END AS status FROM e",
    "f3_signal_model": ARC + READ + " SELECT instrument, coalesce(arg_max(model, r2) FILTER (WHERE beats_naive), 'garch') AS signal_model FROM rd GROUP BY 1",
    "g3_purged_train": S + ", l AS (SELECT instrument, max(n) + 1 AS len FROM ser GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS path, a.g AS g1, b.g AS g2 FROM (SELECT unnest(range(6)) AS g) a JOIN (SELECT unnest(range(6)) AS g) b ON a.g < b.g), e AS (SELECT instrument, path, floor(g1 * len / 6) AS a0, floor((g1 + 1) * len / 6) AS a1, floor(g2 * len / 6) AS b0, floor((g2 + 1) * len / 6) AS b1 FROM l, c) SELECT e.instrument, path::INTEGER AS path, count(*) FILTER (WHERE n >= a0 AND n < a1 OR n >= b0 AND n < b1) AS n_test, count(*) FILTER (WHERE NOT (n >= a0 - 5 AND n < a1 + 2 OR n >= b0 - 5 AND n < b1 + 2)) AS n_train FROM e JOIN ser USING (instrument) GROUP BY 1, 2",
    "i10_ladder": ARC + READ + f" SELECT {K}, round(r2, 5) AS r2, round(dm, 5) AS dm, beats_naive FROM rd",
    "j5_path_quantiles": "WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS step, embedding FROM embeddings), p AS (SELECT vec_id // 20 AS origin, vec_id AS path, step::INTEGER AS step, 100 * exp(embedding[step + 1]::DOUBLE / 10) AS close FROM s), r AS (SELECT *, ln(greatest(close, 1e-9) / greatest(first_value(close) OVER (PARTITION BY origin, path ORDER BY step), 1e-9)) AS ret FROM p) SELECT origin, step, round(avg(ret), 6) AS mean, round(quantile_cont(ret, 0.01), 6) AS q01, round(quantile_cont(ret, 0.5), 6) AS q50, round(quantile_cont(ret, 0.99), 6) AS q99 FROM r WHERE step > 0 GROUP BY 1, 2",
    "l13_probabilistic_sharpe": R + ", r AS (SELECT instrument, ret - 0.01 AS r FROM rets WHERE ret IS NOT NULL), m AS (SELECT instrument, count(*) AS n, avg(r) / stddev_samp(r) AS sr, skewness(r) AS skew, kurtosis(r) AS kurt FROM r GROUP BY 1) SELECT instrument, n, round(sr, 5) AS sharpe, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt + 2) / 4 * sr * sr), 5) AS psr_z FROM m",
    "l18_trade_summary": BACK + f", hl AS (SELECT instrument, ts, lead(high) OVER ({P}) AS hn, lead(low) OVER ({P}) AS ln, lead(open) OVER ({P}) AS o FROM bars)" + " SELECT instrument, count(*) AS n, round(avg(pnl) FILTER (WHERE pnl > 0), 5) AS avg_win, round(avg(pnl) FILTER (WHERE pnl < 0), 5) AS avg_loss, round(sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0), 5) AS profit_factor, round(avg(CASE direction WHEN 'long' THEN hn - o ELSE o - ln END), 5) AS avg_mfe, round(avg(CASE direction WHEN 'long' THEN ln - o ELSE o - hn END), 5) AS avg_mae FROM cv JOIN hl USING (instrument, ts) WHERE direction <> 'flat' AND size > 0 GROUP BY 1",
    "l24_alerts": ALERTS,
    "l22_cost_sweep": BACK.replace(" - 0.5 WHEN", " WHEN").replace(") - 0.5 ELSE", ") ELSE") + ", g AS (SELECT unnest([0.0, 0.5, 1.0, 2.0, 4.0]::DOUBLE[]) AS ticks) SELECT instrument, ticks, round(sum(size * 50 * (net_points - CASE WHEN direction <> 'flat' THEN ticks * 0.5 ELSE 0 END)), 1) AS pnl FROM pl, g GROUP BY 1, 2",
    "l22_sensitivity": BACK.replace(" - 0.5 WHEN", " WHEN").replace(") - 0.5 ELSE", ") ELSE") + ", g AS (SELECT unnest([0.0, 0.5, 1.0, 2.0, 4.0]::DOUBLE[]) AS ticks) , sw AS (SELECT instrument, ticks AS value, round(sum(size * 50 * (net_points - CASE WHEN direction <> 'flat' THEN ticks * 0.5 ELSE 0 END)), 1) AS score FROM pl, g GROUP BY 1, 2) SELECT s.instrument, s.value, s.score, round((s.score / nullif(b.score, 0) - 1) / (s.value - 1), 4) AS sensitivity FROM sw s JOIN sw b ON s.instrument = b.instrument AND b.value = 1 WHERE s.value <> 1",
    "l25_target_position": DECIDED + f", p AS (SELECT instrument, ts, greatest(-8, least(8, round(CASE direction WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END * size * 10)))::INTEGER AS position FROM dcs) SELECT *, position - lag(position, 1, 0) OVER ({P}) AS change FROM p",
    "m5_daily_swap": B + "SELECT instrument, ts, round(0.02::DOUBLE / 365 * close / 0.0001::DOUBLE * CASE WHEN isodow(ts) = 3 THEN 3 ELSE 1 END, 3) AS pips FROM bars",
    "v1_predictive_std": ARC + " SELECT instrument, origin, round((q[7] - q[3]) / 2, 5) AS std, round(q[8] - q[2], 5) AS width90 FROM ar",
    "v7_price_levels": COND + " SELECT instrument, round(close * exp(-1.2815515655446004::DOUBLE * nx), 6) AS p10, round(close * exp(0.0::DOUBLE * nx), 6) AS p50, round(close * exp(1.2815515655446004::DOUBLE * nx), 6) AS p90 FROM s QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) = 1",
}
