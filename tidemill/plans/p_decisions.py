"""Queries over as-of joins, microstructure, characterisation and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characterize as ch
from ..operators import decisions as dec
from ..operators import indicators as ind
from ..operators import micro, prep
from ..operators.asof import asof, asof_day, next_bar
from ..operators.macro import align, spread_changes
from ..sources.tables import daily_bars, macro, read, tape
from .p_ladder import S, series
from .p_prep import SQL as PREP_SQL
from .p_prep import B, P, returns
from .p_tape import W, good
from .shared import BARS, RETURNS, rounded


def c3_asof_macro(spark, sf_dir):
    known = macro(spark, sf_dir).where("us_yield is not null")
    found = asof_day(daily_bars(spark, sf_dir).select("instrument", "ts"), known, "ts", "date", ["us_yield"])
    return rounded(found.select("instrument", "ts", "asof", "us_yield"), 9)


def c4_point_in_time_forecast(spark, sf_dir):
    trades = good(spark, sf_dir).select("instrument", "ts", "seq")
    views = tape(spark, sf_dir).where("side = 'N'").select("instrument", "ts", F.col("price").alias("forecast"))
    other = tape(spark, sf_dir).where("size > 80").select("instrument", F.col("ts").alias("f_ts"), F.col("price").alias("forecast"))
    found = asof(trades, other.unionByName(views.select("instrument", F.col("ts").alias("f_ts"), "forecast")), ["instrument"], "ts", "f_ts", ["forecast"])
    fresh = F.col("asof") >= F.col("ts") - F.expr("INTERVAL 6 HOURS")
    return found.select("instrument", "seq", F.when(fresh, F.col("forecast")).alias("forecast"))


def c5_next_bar(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return next_bar(bars.select("instrument", "ts"), bars, ["open", "close"])


def c10_yield_alignment(spark, sf_dir):
    return rounded(align(macro(spark, sf_dir)), 9)


def n5_vpin_buckets(spark, sf_dir):
    return micro.vpin_buckets(good(spark, sf_dir), 500)


def d8_vpin(spark, sf_dir):
    return rounded(micro.vpin(micro.vpin_buckets(good(spark, sf_dir), 500)), 9)


def book(spark, sf_dir):
    """Resting orders by hour from the tape: sides B and A, prices in steps of 5."""
    orders = tape(spark, sf_dir).where("side in ('A', 'B')")
    near = (F.floor(F.col("price") / 5) * 5).cast("double")
    return orders.select("instrument", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("snap"), "side", F.when(F.col("side") == "B", 0 - near).otherwise(near).alias("price"), "size").withColumn("instrument", F.lit("book"))


def f2_book_levels(spark, sf_dir):
    return micro.book_levels(book(spark, sf_dir))


def n2_book_snapshots(spark, sf_dir):
    return rounded(micro.book_snapshots(micro.book_levels(book(spark, sf_dir))), 9)


def n7_tick_conditioning(spark, sf_dir):
    return rounded(micro.tick_returns(micro.condition_ticks(good(spark, sf_dir)), 0.01).select("instrument", "seq", "filtered", "spike", "level", "scaled_return"), 6)


def k5_hurst(spark, sf_dir):
    return rounded(ch.hurst(series(spark, sf_dir)))


def k6_ljung_box(spark, sf_dir):
    return rounded(ch.ljung_box(series(spark, sf_dir)), 5)


def k7_permutation_entropy(spark, sf_dir):
    return rounded(ch.permutation_entropy(series(spark, sf_dir)), 9)


def k8_mutual_information(spark, sf_dir):
    return rounded(ch.mutual_information(series(spark, sf_dir)), 8)


def k9_volatility_regimes(spark, sf_dir):
    return rounded(ch.volatility_regimes(series(spark, sf_dir)).select("instrument", "n", "vol", "regime", "head"))


def decided(spark, sf_dir):
    """Daily decisions: sign of a mean-reversion forecast, sized by its strength."""
    rows = prep.condition(returns(spark, sf_dir)).where("scaled is not null")
    forecasts = rows.select("instrument", "ts", (F.col("scaled") * -0.2).alias("p50"), F.lit(0.5).alias("spread"))
    signal = dec.forecast_signal(forecasts)
    return signal.select("instrument", "ts", "direction", F.when(F.col("strength") > 0.4, 1.0).when(F.col("strength") > 0.1, 0.5).otherwise(0.0).alias("size"), "strength")


def l1_yield_momentum(spark, sf_dir):
    days = daily_bars(spark, sf_dir).select("instrument", "ts", (F.dayofmonth("ts") % 4).alias("regime"))
    return rounded(dec.yield_momentum(days, spread_changes(macro(spark, sf_dir))))


def l2_forecast_signal(spark, sf_dir):
    return rounded(decided(spark, sf_dir).select("instrument", "ts", "direction", "strength"))


def votes(spark, sf_dir):
    days = daily_bars(spark, sf_dir).select("instrument", "ts", (F.dayofmonth("ts") % 4).alias("regime"))
    first = dec.yield_momentum(days, spread_changes(macro(spark, sf_dir)))
    second = decided(spark, sf_dir).select("instrument", "ts", F.lit("forecast_directional").alias("detector"), "direction", "strength")
    return first.unionByName(second)


def g2_all_signals(spark, sf_dir):
    return votes(spark, sf_dir).groupBy("detector", "direction").agg(F.count(F.lit(1)).alias("n"))


def l4_confirmations(spark, sf_dir):
    tech = ind.patterns(ind.technical(daily_bars(spark, sf_dir)))
    return dec.confirmations(tech.join(decided(spark, sf_dir).select("instrument", "ts", "direction"), ["instrument", "ts"]))


def l5_composite(spark, sf_dir):
    return dec.composite(votes(spark, sf_dir), l4_confirmations(spark, sf_dir))


def l8_meta_labels(spark, sf_dir):
    return dec.meta_labels(decided(spark, sf_dir), daily_bars(spark, sf_dir)).groupBy("instrument", "direction", "label").agg(F.count(F.lit(1)).alias("n"))


def l15_backtest(spark, sf_dir):
    curve = dec.backtest(decided(spark, sf_dir), daily_bars(spark, sf_dir))
    return rounded(curve.select("instrument", "ts", "direction", "size", "net_points", "pnl", "equity"), 2, "net_points", "pnl")


def l16_performance(spark, sf_dir):
    return rounded(dec.performance(dec.backtest(decided(spark, sf_dir), daily_bars(spark, sf_dir))), 5)


def e16_equity_drawdown(spark, sf_dir):
    curve = dec.backtest(decided(spark, sf_dir), daily_bars(spark, sf_dir))
    return rounded(curve.select("instrument", "ts", "peak", (F.col("equity") / F.col("peak") - 1).alias("drawdown")), 2)


def e17_turnover(spark, sf_dir):
    curve = dec.backtest(decided(spark, sf_dir), daily_bars(spark, sf_dir))
    return curve.groupBy("instrument").agg(F.sum("turn").alias("turnover"), F.avg("size").alias("mean_size"), F.count_if(F.col("size") > 0).alias("n_exposed"))


def l20_kelly_units(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    p = F.lit(0.5) + (F.col("o_orderkey") % 50) / 100
    regime = F.when(F.col("o_orderstatus") == "O", "low_vol").when(F.col("o_orderstatus") == "F", "high_vol_choppy").otherwise("high_vol_crash")
    return orders.select("o_orderkey", dec.kelly_units(p, F.col("o_totalprice"), regime).alias("units"))


def l21_drawdown_halt(spark, sf_dir):
    curve = dec.session_drawdown_halt(dec.backtest(decided(spark, sf_dir), daily_bars(spark, sf_dir)))
    return curve.groupBy("instrument").agg(F.count_if("halted").alias("n_halted"))


def m3_feedback(spark, sf_dir):
    labelled = dec.meta_labels(decided(spark, sf_dir), daily_bars(spark, sf_dir))
    trades = labelled.select("instrument", "ts", (F.lit(0.55) + F.col("size") * 0.2).alias("confidence"), F.col("label").cast("double").alias("won"))
    return dec.feedback(trades).select("instrument", "ts", "drift", "kelly", "gate_half", "gate_full")


QUERIES = {f.__name__: f for f in (c3_asof_macro, c4_point_in_time_forecast, c5_next_bar, c10_yield_alignment, n5_vpin_buckets, d8_vpin, f2_book_levels, n2_book_snapshots, n7_tick_conditioning, k5_hurst, k6_ljung_box, k7_permutation_entropy, k8_mutual_information, k9_volatility_regimes, l1_yield_momentum, l2_forecast_signal, g2_all_signals, l4_confirmations, l5_composite, l8_meta_labels, l15_backtest, l16_performance, e16_equity_drawdown, e17_turnover, l20_kelly_units, l21_drawdown_halt, m3_feedback)}

YIELDS = """mac AS (SELECT o_orderdate AS date, avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') / 1e5 AS us, avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') / 1e5 AS de0 FROM orders GROUP BY 1)"""
ALIGNED = YIELDS + ", ali AS (SELECT date, us, last_value(de0 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS de FROM mac WHERE us IS NOT NULL), al AS (SELECT * FROM ali WHERE de IS NOT NULL)"
VPIN = ", c AS (SELECT *, sum(size) OVER (PARTITION BY instrument ORDER BY ts, seq)::BIGINT AS cum FROM good), x AS (SELECT *, unnest(generate_series((cum - size) // 500, (cum - 1) // 500)) AS bucket FROM c), p AS (SELECT *, least(cum, (bucket + 1) * 500) - greatest(cum - size, bucket * 500) AS part FROM x), b AS (SELECT instrument, bucket, sum(CASE side WHEN 'B' THEN part WHEN 'A' THEN 0 ELSE part / 2 END)::DOUBLE AS buy, sum(part) AS v, max(ts) AS close_ts FROM p GROUP BY instrument, bucket), vb AS (SELECT instrument, bucket, buy, v - buy AS sell, close_ts FROM b WHERE v = 500)"
BOOK = W + ", o AS (SELECT 'book' AS instrument, date_trunc('hour', ts) AS snap, side, CASE WHEN side = 'B' THEN 0 - floor(price / 5) * 5 ELSE floor(price / 5) * 5 END AS price, size FROM tape WHERE side <> 'N'), s AS (SELECT instrument, snap, side, price, sum(size)::BIGINT AS size FROM o GROUP BY ALL), lv AS (SELECT *, row_number() OVER (PARTITION BY instrument, snap, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END)::INTEGER AS level FROM s QUALIFY level <= 10)"
DECIDED = (
    "WITH "
    + RETURNS
    + f""",
cond AS (SELECT *, CASE WHEN count(ret) OVER b >= 64 THEN stddev_samp(ret) OVER b END AS sg FROM rets WINDOW b AS ({P} ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING)),
fc AS (SELECT instrument, ts, (ret / sg) * -0.2 AS p50 FROM cond WHERE sg > 0 AND ret IS NOT NULL),
fs AS (SELECT instrument, ts, CASE WHEN abs(p50) < 0.05 THEN 'flat' WHEN p50 > 0 THEN 'long' ELSE 'short' END AS direction, CASE WHEN abs(p50) < 0.05 THEN 0 ELSE least(abs(p50) / (abs(p50) + 0.5), 1) END AS strength FROM fc),
dcs AS (SELECT *, CASE WHEN strength > 0.4 THEN 1.0 WHEN strength > 0.1 THEN 0.5 ELSE 0.0 END::DOUBLE AS size FROM fs),
nb AS (SELECT instrument, ts, lead(ts) OVER ({P}) AS next_ts, lead(open) OVER ({P}) AS open_next, lead(close) OVER ({P}) AS close_next FROM bars),
nxt AS (SELECT instrument, ts, CASE WHEN next_ts <= ts + INTERVAL 30 DAY THEN next_ts END AS next_ts, CASE WHEN next_ts <= ts + INTERVAL 30 DAY THEN open_next END AS open_next, CASE WHEN next_ts <= ts + INTERVAL 30 DAY THEN close_next END AS close_next FROM nb)"""
)
YM = (
    ", "
    + ALIGNED
    + f", ch AS (SELECT date, (us - de) * 100 - lag((us - de) * 100, 5) OVER (ORDER BY date) AS d5, us - lag(us, 5) OVER (ORDER BY date) AS u5 FROM al), chg AS (SELECT date, coalesce(d5, u5) AS c FROM ch WHERE coalesce(d5, u5) IS NOT NULL), dy AS (SELECT instrument, ts, day(ts) % 4 AS regime FROM bars), yj AS (SELECT d.instrument, d.ts, c, CASE regime WHEN 0 THEN 8.0 WHEN 1 THEN 15.0 WHEN 2 THEN 20.0 ELSE 15.0 END AS lim FROM dy d ASOF LEFT JOIN chg ON d.ts >= chg.date), ym AS (SELECT instrument, ts, CASE WHEN c > lim THEN 'short' WHEN c < -lim THEN 'long' ELSE 'flat' END AS direction, CASE WHEN c > lim OR c < -lim THEN least(abs(c) / (lim * 2), 1) ELSE 0 END::DOUBLE AS strength FROM yj)"
)
BACK = DECIDED + f", mv AS (SELECT d.*, CASE direction WHEN 'long' THEN close_next - open_next - 0.5 WHEN 'short' THEN -(close_next - open_next) - 0.5 ELSE 0 END AS net_points FROM dcs d JOIN nxt USING (instrument, ts) WHERE next_ts IS NOT NULL), pl AS (SELECT *, size * 50 * net_points AS pnl FROM mv), eq AS (SELECT *, 100000 + sum(pnl) OVER ({P}) AS equity FROM pl), cv AS (SELECT *, max(equity) OVER ({P}) AS peak, abs(size - lag(size, 1, 0) OVER ({P})) AS turn FROM eq)"
SQL = {
    "c3_asof_macro": B + ", " + YIELDS + " SELECT b.instrument, b.ts, m.date AS asof, round(m.us, 9) AS us_yield FROM bars b ASOF LEFT JOIN (SELECT * FROM mac WHERE us IS NOT NULL) m ON b.ts >= m.date",
    "c4_point_in_time_forecast": W + ", f AS (SELECT instrument, ts AS f_ts, price AS forecast FROM tape WHERE side = 'N' OR size > 80) SELECT g.instrument, g.seq, CASE WHEN f_ts >= g.ts - INTERVAL 6 HOUR THEN forecast END AS forecast FROM good g ASOF LEFT JOIN f ON g.instrument = f.instrument AND g.ts >= f.f_ts",
    "c5_next_bar": DECIDED + " SELECT * FROM nxt",
    "c10_yield_alignment": "WITH " + ALIGNED + " SELECT date, round(us, 9) AS us_yield, round(de, 9) AS de_yield FROM al",
    "n5_vpin_buckets": W + VPIN + " SELECT * FROM vb",
    "d8_vpin": W + VPIN + ", k AS (SELECT * FROM vb QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY bucket DESC) <= 50) SELECT instrument, round(avg(abs(buy - sell) / (buy + sell)), 9) AS vpin, count(*) AS n FROM k GROUP BY instrument",
    "f2_book_levels": BOOK + " SELECT * FROM lv",
    "n2_book_snapshots": BOOK + " , a AS (SELECT instrument, snap, max(price) FILTER (WHERE side = 'B' AND level = 1) AS bid_px, max(price) FILTER (WHERE side = 'A' AND level = 1) AS ask_px, max(size) FILTER (WHERE side = 'B' AND level = 1) AS b1, max(size) FILTER (WHERE side = 'A' AND level = 1) AS a1, sum(size) FILTER (WHERE side = 'B') AS b, sum(size) FILTER (WHERE side = 'A') AS a FROM lv GROUP BY 1, 2) SELECT instrument, snap, bid_px, ask_px, round((b1 - a1) / (b1 + a1), 9) AS imbalance_l1, round((b - a) / (b + a), 9) AS imbalance_depth FROM a",
    "k5_hurst": S + ", p AS (SELECT instrument, n, sum(ret) OVER (PARTITION BY instrument ORDER BY n) AS x FROM ser), l AS (SELECT unnest(generate_series(2, 63)) AS lag), d AS (SELECT a.instrument, lag, stddev_pop(a.x - b.x) AS sd FROM p a JOIN l ON true JOIN p b ON a.instrument = b.instrument AND b.n = a.n - lag GROUP BY 1, 2) SELECT instrument, round(regr_slope(ln(sd), ln(lag)), 6) AS hurst FROM d WHERE sd > 0 GROUP BY instrument",
    "k7_permutation_entropy": S + ", t AS (SELECT instrument, lag(ret, 2) OVER w AS a, lag(ret, 1) OVER w AS b, ret AS c FROM ser WINDOW w AS (PARTITION BY instrument ORDER BY n)), k AS (SELECT instrument, (a <= b) AS x, (b <= c) AS y, (a <= c) AS z, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY ALL), p AS (SELECT instrument, k / sum(k) OVER (PARTITION BY instrument) AS p FROM k) SELECT instrument, round(-sum(p * ln(p)) / ln(6), 9) AS entropy FROM p GROUP BY instrument",
    "k8_mutual_information": S + ", q AS (SELECT instrument, lag(ret) OVER (PARTITION BY instrument ORDER BY n) AS x, ret AS y FROM ser), e AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM q WHERE x IS NOT NULL WINDOW w AS (PARTITION BY instrument)), c AS (SELECT instrument, least(floor((x - x0) / (x1 - x0) * 16), 15) AS i, least(floor((y - y0) / (y1 - y0) * 16), 15) AS j, count(*) AS k FROM e GROUP BY ALL), m AS (SELECT *, sum(k) OVER (PARTITION BY instrument) AS t, sum(k) OVER (PARTITION BY instrument, i) AS ki, sum(k) OVER (PARTITION BY instrument, j) AS kj FROM c) SELECT instrument, round(sum(k / t * ln(k * t / (ki * kj))), 8) AS mi FROM m GROUP BY instrument",
    "k9_volatility_regimes": S + ", v AS (SELECT instrument, n, CASE WHEN count(*) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS v FROM ser WINDOW w AS (PARTITION BY instrument ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), f AS (SELECT instrument, n, v IS NULL AS head, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vol FROM v), c AS (SELECT instrument, quantile_cont(vol, 0.5) AS cut FROM f GROUP BY 1) SELECT instrument, n, round(vol, 6) AS vol, CASE WHEN vol <= cut THEN 'calm' ELSE 'turbulent' END AS regime, head FROM f JOIN c USING (instrument)",
    "l1_yield_momentum": B + YM + " SELECT instrument, ts, 'yield_spread_momentum' AS detector, direction, round(strength, 6) AS strength FROM ym",
    "l2_forecast_signal": DECIDED + " SELECT instrument, ts, direction, round(strength, 6) AS strength FROM dcs",
    "g2_all_signals": DECIDED + YM + " SELECT detector, direction, count(*) AS n FROM (SELECT 'yield_spread_momentum' AS detector, direction FROM ym UNION ALL SELECT 'forecast_directional', direction FROM dcs) GROUP BY ALL",
    "l8_meta_labels": DECIDED + " SELECT instrument, direction, (CASE direction WHEN 'long' THEN close_next > open_next ELSE close_next < open_next END)::INTEGER AS label, count(*) AS n FROM dcs JOIN nxt USING (instrument, ts) WHERE direction <> 'flat' AND next_ts IS NOT NULL GROUP BY ALL",
    "l15_backtest": BACK + " SELECT instrument, ts, direction, size, net_points, pnl, round(equity, 2) AS equity FROM cv",
    "l16_performance": BACK + ", r AS (SELECT *, CASE WHEN equity - pnl > 0 THEN pnl / (equity - pnl) ELSE 0 END AS r FROM cv), f AS (SELECT instrument, count(*) AS periods, round(CASE WHEN count(*) >= 2 AND stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END, 5) AS sharpe, round(CASE WHEN count(*) FILTER (WHERE r < 0) >= 2 THEN avg(r) / stddev_samp(r) FILTER (WHERE r < 0) * sqrt(252) ELSE 0 END, 5) AS sortino, round(least(0, min(CASE WHEN peak > 0 THEN equity / peak - 1 ELSE 0 END)), 5) AS max_drawdown, round(avg((size > 0)::INT), 5) AS exposure, round(sum(turn), 5) AS turnover, round(coalesce(count(*) FILTER (WHERE direction <> 'flat' AND size > 0 AND pnl > 0) / nullif(count(*) FILTER (WHERE direction <> 'flat' AND size > 0), 0), 0), 5) AS win_rate, pow(greatest(100000 + sum(pnl), 0) / 100000, 252 / count(*)) - 1 AS cg, least(0, min(CASE WHEN peak > 0 THEN equity / peak - 1 ELSE 0 END)) AS md FROM r GROUP BY instrument) SELECT * EXCLUDE (cg, md), round(cg, 5) AS cagr, round(CASE WHEN md < 0 THEN cg / abs(md) ELSE 0 END, 5) AS calmar FROM f",
    "k6_ljung_box": S + ", v AS (SELECT instrument, n, ret AS v, 'q_ret' AS k FROM ser UNION ALL SELECT instrument, n, ret * ret, 'q_sq' FROM ser), e AS (SELECT instrument, k, n, v - avg(v) OVER (PARTITION BY instrument, k) AS e, count(*) OVER (PARTITION BY instrument, k) AS t FROM v), g AS (SELECT instrument, k, any_value(t) AS t, sum(e * e) AS g FROM e GROUP BY 1, 2), c AS (SELECT a.instrument, a.k, a.n - b.n AS lag, sum(a.e * b.e) AS s FROM e a JOIN e b ON a.instrument = b.instrument AND a.k = b.k AND a.n > b.n AND a.n - b.n <= 20 GROUP BY 1, 2, 3), q AS (SELECT instrument, k, t * (t + 2) * sum(s / g * s / g / (t - lag)) AS q FROM c JOIN g USING (instrument, k) GROUP BY instrument, k, t) SELECT instrument, round(max(q) FILTER (WHERE k = 'q_ret'), 5) AS q_ret, round(max(q) FILTER (WHERE k = 'q_sq'), 5) AS q_sq FROM q GROUP BY 1",
    "m3_feedback": DECIDED + f", m AS (SELECT instrument, ts, 0.55::DOUBLE + size * 0.2::DOUBLE AS c, (CASE direction WHEN 'long' THEN close_next > open_next ELSE close_next < open_next END)::INT AS won FROM dcs JOIN nxt USING (instrument, ts) WHERE direction <> 'flat' AND next_ts IS NOT NULL), d AS (SELECT instrument, ts, round(avg(c) OVER w - avg(won) OVER w, 4) AS drift FROM m WINDOW w AS ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT instrument, ts, drift, CASE WHEN drift > 0.05 THEN greatest(0.05, round(0.15::DOUBLE - 0.5::DOUBLE * (drift - 0.05::DOUBLE), 3)) ELSE 0.15 END::DOUBLE AS kelly, CASE WHEN drift > 0.05 THEN least(0.65, round(0.55::DOUBLE + 0.5::DOUBLE * (drift - 0.05::DOUBLE), 3)) ELSE 0.55 END::DOUBLE AS gate_half, CASE WHEN drift > 0.05 THEN least(0.8, round(0.7::DOUBLE + 0.5::DOUBLE * (drift - 0.05::DOUBLE), 3)) ELSE 0.7 END::DOUBLE AS gate_full FROM d WHERE drift IS NOT NULL",
    "e16_equity_drawdown": BACK + " SELECT instrument, ts, round(peak, 2) AS peak, round(equity / peak - 1, 2) AS drawdown FROM cv",
    "e17_turnover": BACK + " SELECT instrument, sum(turn) AS turnover, avg(size) AS mean_size, count(*) FILTER (WHERE size > 0) AS n_exposed FROM cv GROUP BY instrument",
    "l20_kelly_units": "WITH p AS (SELECT o_orderkey, o_totalprice, o_orderstatus AS s, 0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE AS p FROM orders), k AS (SELECT *, (p * 1.5::DOUBLE - (1 - p)) / 1.5::DOUBLE AS f FROM p) SELECT o_orderkey, CASE WHEN p < 0.55::DOUBLE OR f <= 0 OR s NOT IN ('O', 'F') THEN 0 ELSE round(o_totalprice * least(f * 0.15::DOUBLE * CASE WHEN s = 'F' THEN 0.5::DOUBLE ELSE 1 END, 0.15::DOUBLE) * 10)::BIGINT END AS units FROM k",
    "l21_drawdown_halt": BACK + " SELECT instrument, count(*) FILTER (WHERE pnl < -0.02 * (equity - pnl)) AS n_halted FROM cv GROUP BY instrument",
}
CHECKS = (
    DECIDED
    + YM
    + ", tk AS (" + PREP_SQL["e12_technical_rows"] + "), pt AS (" + PREP_SQL["e11_candle_patterns"] + ")"
    ", ck AS (SELECT d.instrument, d.ts, unnest([{'check': 'candle', 'c': direction = 'long' AND (engulfing_bull OR pin_bull) OR direction = 'short' AND (engulfing_bear OR pin_bear)}, {'check': 'rsi', 'c': direction = 'long' AND rsi < 30 OR direction = 'short' AND rsi > 70}, {'check': 'averages', 'c': direction = 'long' AND vs_ma50 > 0 AND vs_ma200 > 0 OR direction = 'short' AND vs_ma50 < 0 AND vs_ma200 < 0}]) AS k FROM dcs d JOIN tk ON d.instrument = tk.instrument AND d.ts = tk.ts JOIN pt ON d.instrument = pt.instrument AND d.ts = pt.ts)"
    ", ch2 AS (SELECT instrument, ts, k['check'] AS \"check\", coalesce(k['c'], false) AS confirmed FROM ck)"
)
COMPOSITE = (
    CHECKS
    + ", vt AS (SELECT instrument, ts, direction, strength FROM ym UNION ALL SELECT instrument, ts, direction, strength FROM dcs)"
    ", ta AS (SELECT instrument, ts, sum(CASE direction WHEN 'long' THEN strength ELSE 0 END) AS ls, sum(CASE direction WHEN 'short' THEN strength ELSE 0 END) AS ss, count(*) FILTER (WHERE direction = 'long') AS ln, count(*) FILTER (WHERE direction = 'short') AS sn FROM vt GROUP BY 1, 2)"
    ", mo AS (SELECT instrument, ts, sum(CASE WHEN confirmed THEN 0.05::DOUBLE ELSE -0.02::DOUBLE END) AS adj, count(*) FILTER (WHERE confirmed) AS tier2 FROM ch2 GROUP BY 1, 2)"
    ", cm AS (SELECT a.instrument, a.ts, ln + sn AS signal_count, coalesce(tier2, 0) AS tier2_count, CASE WHEN ls > ss THEN 'long' WHEN ss > ls THEN 'short' ELSE 'flat' END AS side, CASE WHEN ls > ss THEN greatest(0, least(1, ls / ln + coalesce(adj, 0))) WHEN ss > ls THEN greatest(0, least(1, ss / sn + coalesce(adj, 0))) ELSE 0 END AS s FROM ta a LEFT JOIN mo ON a.instrument = mo.instrument AND a.ts = mo.ts)"
    ", cp AS (SELECT instrument, ts, CASE WHEN s < 0.15 THEN 'flat' ELSE side END AS direction, CASE WHEN s < 0.15 THEN 0 ELSE round(s, 4) END::DOUBLE AS strength, signal_count, tier2_count FROM cm)"
)
SQL["l4_confirmations"] = CHECKS + ' SELECT instrument, ts, "check", confirmed FROM ch2'
SQL["l5_composite"] = COMPOSITE + " SELECT * FROM cp"
