"""Queries over session joins, views, feeds and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import binomial_upper
from ..operators import bars as bar
from ..operators import decisions as dec
from ..operators import ladder as lad
from ..operators import loop, micro, prep
from ..operators import sessions as ses
from ..sources import feeds
from ..sources.tables import daily_bars, macro, read, shared_folder, tape
from .p_decisions import BOOK, DECIDED, VPIN, YIELDS, book, decided
from .p_ladder import ARC, GATE, arc, gated, series
from .p_loop import SES, sessions, sides
from .p_prep import B, P, returns
from .p_tape import NY, W, good
from .shared import OHLCV, RETURNS, dated, rounded


def c6_session_interval(spark, sf_dir):
    t = sessions(spark, sf_dir)
    h4 = bar.h4_bars(good(spark, sf_dir)).where(F.dayofmonth("bar_start") % 3 != 0)
    found = ses.interval_opportunity(sides(spark, sf_dir), h4, bar.session_bars(t))
    return dated(rounded(found.drop("entry", "exit"), 4))


def c7_recent_outcomes(spark, sf_dir):
    t = sessions(spark, sf_dir)
    name = F.concat_ws("/", "instrument", F.col("session_date").cast("string")).alias("event_id")
    found = loop.opportunity(sides(spark, sf_dir), t)
    events = sides(spark, sf_dir).select(name, "instrument", "session_date")
    today = t.groupBy("instrument").agg(F.max("session_date").alias("today"))
    rows = ses.recent_outcomes(events, found.select(name, "close_return"), today)
    return dated(rounded(rows, 4))


def c8_slippage_rows(spark, sf_dir):
    t = sessions(spark, sf_dir)
    fills = t.where("seq % 20 = 0").select("instrument", "session_date", (F.col("price") * 0.0001).alias("fill"))
    expected = t.groupBy("instrument", "session_date").agg((F.min_by("price", F.struct("ts", "seq")) * 0.0001).alias("entry"))
    return dated(rounded(ses.slippage_rows(fills, expected), 5))


def runs(spark, sf_dir):
    """Forecast rows in yearly runs; runs of even years carry no forecasts."""
    rows = prep.condition(returns(spark, sf_dir)).where("scaled is not null")
    year = F.year("ts")
    return rows.select("instrument", "ts", F.date_format("ts", "yyyy").alias("run_id"), F.when(year % 2 == 1, F.col("scaled") * -0.2).alias("p50"), F.when(year % 3 == 0, "efficient").when(year % 3 == 1, "linear").alias("structure"))


def c9_latest_run(spark, sf_dir):
    return rounded(ses.latest_run(runs(spark, sf_dir), "p50").select("instrument", "ts", "run_id", "p50"), 5)


def book_parts(spark, sf_dir):
    found = micro.book_snapshots(micro.book_levels(book(spark, sf_dir)))
    one = good(spark, sf_dir).withColumn("instrument", F.lit("book"))
    return found, micro.vpin(micro.vpin_buckets(one, 500))


def c14_latest_book(spark, sf_dir):
    return rounded(ses.latest_book(*book_parts(spark, sf_dir)), 8)


def n10_latest_ticks(spark, sf_dir):
    return rounded(ses.latest_ticks(micro.condition_ticks(good(spark, sf_dir))), 6)


def p5_engine_view(spark, sf_dir):
    ses.create_views(spark, runs(spark, sf_dir), *book_parts(spark, sf_dir), micro.condition_ticks(good(spark, sf_dir)))
    return rounded(spark.sql("SELECT instrument, ts, p50, run_id, structure_code FROM v_engine_features"), 5)


def g1_distinct_reasons(spark, sf_dir):
    rows = gated(spark, sf_dir).select("instrument", "origin", F.concat("reasons", F.reverse("reasons"), "reasons").alias("r"))
    return rows.select("instrument", "origin", F.array_join(lad.distinct_reasons(F.col("r")), "|").alias("reasons"))


def j6_gaussian_grid(spark, sf_dir):
    rows = prep.condition(returns(spark, sf_dir)).where("sigma_next is not null")
    q = lad.gaussian(F.coalesce("ret", F.lit(0.0)), F.col("sigma_next"))
    return rounded(rows.select("instrument", "ts", F.element_at(q, 1).alias("q01"), F.element_at(q, 5).alias("q50"), F.element_at(q, 8).alias("q95")), 7)


def i11_sign_replication(spark, sf_dir):
    """Sign accuracy of the forecasts above the noise floor, one-sided binomial p, and expectancy in deviations."""
    rows = lad.ar_rung(series(spark, sf_dir)).select("instrument", "mean", "y", ((F.element_at("q", 7) - F.element_at("q", 3)) / 2).alias("vol"))
    found = lad.sign_replication(rows.select("instrument", (F.col("mean") / F.col("vol")).alias("p50"), (F.col("y") / F.col("vol")).alias("y")))
    return rounded(found.withColumn("p", binomial_upper(F.col("hits"), F.col("n"))), 5)


def e20_freshness(spark, sf_dir):
    t = {"events": (read(spark, sf_dir, "events"), "ts"), "lineitem": (read(spark, sf_dir, "lineitem"), "l_shipdate"), "orders": (read(spark, sf_dir, "orders"), "o_orderdate")}
    return ses.freshness(t)


def events_calendar(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    surprise = F.when(F.col("o_orderstatus") == "O", "positive_usd").when(F.col("o_orderstatus") == "F", "negative_usd").otherwise("neutral")
    return o.select(F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("impact"), surprise.alias("surprise"))


def l3_event_reversal(spark, sf_dir):
    return rounded(ses.event_reversal(daily_bars(spark, sf_dir), events_calendar(spark, sf_dir)), 6)


def l10_accuracy(spark, sf_dir):
    rows = dec.meta_labels(decided(spark, sf_dir), daily_bars(spark, sf_dir))
    return rounded(ses.accuracy(rows.select("instrument", "label", (F.lit(0.5) + F.col("strength") / 2 >= 0.55).cast("int").alias("predicted"))), 6)


def l21_spread_filter(spark, sf_dir):
    t = good(spark, sf_dir).withColumn("bid", F.col("price") * 0.0001).withColumn("ask", F.col("bid") + F.col("size") * 0.000004)
    return t.groupBy("instrument").agg(F.count_if(ses.spread_ok(F.col("bid"), F.col("ask"), most=2.002)).alias("n_ok"), F.count(F.lit(1)).alias("n"))


def m5_position_ratio(spark, sf_dir):
    sums = tape(spark, sf_dir, "user_id").where("price > 0 and size > 0").groupBy("instrument").agg(F.sum(F.when(F.col("side") == "B", F.col("size")).otherwise(0)).alias("l"), F.sum(F.when(F.col("side") == "A", F.col("size")).otherwise(0)).alias("s"))
    return rounded(sums.select("instrument", ses.position_ratio(F.col("l"), F.col("s")).alias("long_pct")), 6)


def a4_dated_files(spark, sf_dir):
    """The tape written as gzipped CSV, a folder a day, and a range of days read back."""
    folder = shared_folder(spark, "csv")
    t = good(spark, sf_dir).select("instrument", "seq", "price", "size", F.date_format("ts", "yyyyMMdd").alias("day"))
    t.write.option("header", True).option("compression", "gzip").partitionBy("day").csv(folder)
    rows = feeds.dated_files(spark, folder, "instrument string, seq long, price double, size long", "2024-01-05", "2024-01-12")
    return dated(rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume")))


def a5_record_scan(spark, sf_dir):
    """Book records from JSON messages with action, side, order and level; messages that don't parse are left out."""
    e = read(spark, sf_dir, "events")
    action = F.element_at(F.array(*[F.lit(x) for x in "ACMF"]), (F.col("event_id") % 4 + 1).cast("int"))
    message = F.to_json(F.struct(action.alias("action"), F.when(F.col("event_type") == "click", "B").otherwise("A").alias("side"), (F.col("event_id") / 4).cast("long").alias("order_id"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size")))
    rows = micro.book_records(e.select("ts", F.when(F.col("event_id") % 50 == 7, "broken").otherwise(message).alias("value")))
    return rows.groupBy("action", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("order_id").alias("first_order"))


def a6_candles(spark, sf_dir):
    bars_ = daily_bars(spark, sf_dir)
    mid = F.struct(*[F.col(c).cast("string").alias(c[0]) for c in ("open", "high", "low", "close")])
    one = F.struct((F.dayofmonth("ts") % 7 != 0).alias("complete"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "volume", mid.alias("mid"))
    texts = bars_.groupBy("instrument", F.year("ts")).agg(F.to_json(F.struct(F.col("instrument"), F.collect_list(one).alias("candles"))).alias("value"))
    return rounded(feeds.candles(texts), 6)


def a7_yields(spark, sf_dir):
    folder = shared_folder(spark, "yields")
    m = macro(spark, sf_dir).select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce(F.col("us_yield").cast("string"), F.lit(".")).alias("value"))
    m.write.option("header", True).csv(folder)
    return dated(rounded(feeds.yields(spark, folder), 7))


def a9_append_runs(spark, sf_dir):
    """Two runs and a repeated one: each counts once."""
    folder, rows = shared_folder(spark, "runs"), arc(spark, sf_dir).select("instrument", "model", "origin", "y", "mean")
    for run in ("r1", "r2", "r1"):
        feeds.append_run(rows.where("model != 'garch'") if run == "r2" else rows, folder, "archive", run)
    return feeds.read_run(spark, folder, "archive").groupBy("run_id", "model").agg(F.count(F.lit(1)).alias("n"))


def a10_persist_run(spark, sf_dir):
    folder, bars_ = shared_folder(spark, "persist"), daily_bars(spark, sf_dir)
    tables = {"bars": bars_, "conditioned": prep.condition(returns(spark, sf_dir)).where("scaled is not null")}
    feeds.persist_run(tables, folder, "run-1", {"vol_window": 256, "source": "lineitem"})
    counts = [feeds.read_run(spark, folder, name, "run-1").groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name in tables]
    config = feeds.read_run(spark, folder, "runs", "run-1").select("run_id", "config")
    return counts[0].unionByName(counts[1]).join(config, F.lit(True))


def a16_sampled_paths(spark, sf_dir):
    paths = feeds.sampled_paths(read(spark, sf_dir, "embeddings"))
    return rounded(paths.groupBy("origin", "step").agg(F.count(F.lit(1)).alias("n_paths"), F.avg("close").alias("mean_close")), 5)


QUERIES = {f.__name__: f for f in (c6_session_interval, c7_recent_outcomes, c8_slippage_rows, c9_latest_run, c14_latest_book, n10_latest_ticks, p5_engine_view, g1_distinct_reasons, j6_gaussian_grid, i11_sign_replication, e20_freshness, l3_event_reversal, l10_accuracy, l21_spread_filter, m5_position_ratio, a4_dated_files, a5_record_scan, a6_candles, a7_yields, a9_append_runs, a10_persist_run, a16_sampled_paths)}

SIDED = ", sg AS (SELECT DISTINCT instrument, sd, CASE WHEN day(sd) % 2 = 0 THEN 1 ELSE -1 END AS sg FROM ss)"
RUNS = "WITH " + RETURNS + f", cond AS (SELECT *, CASE WHEN count(ret) OVER b >= 64 THEN stddev_samp(ret) OVER b END AS sg FROM rets WINDOW b AS ({P} ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING)), rn AS (SELECT instrument, ts, year(ts)::VARCHAR AS run_id, CASE WHEN year(ts) % 2 = 1 THEN ret / sg * -0.2 END AS p50, year(ts) % 3 AS st FROM cond WHERE sg > 0 AND ret IS NOT NULL)"
PIPS = "0.0001::DOUBLE"
SQL = {
    "c6_session_interval": SES + f", b4 AS (SELECT instrument, date_trunc('hour', {NY}) - to_hours((((hour({NY}) - 17 + 24) % 24) % 4)::INTEGER) AS bs, {OHLCV} FROM good GROUP BY ALL), h AS (SELECT instrument, (bs - INTERVAL 1 MICROSECOND + INTERVAL 7 HOUR)::DATE AS sd, first(open ORDER BY bs) AS en, last(close ORDER BY bs) AS ex, max(high) AS hi, min(low) AS lo FROM b4 WHERE day(bs) % 3 <> 0 GROUP BY ALL), x AS (SELECT d.instrument, d.sd, d.sg, CASE WHEN h.en IS NOT NULL THEN 'H4' ELSE 'D' END AS source, coalesce(h.en, d.en) AS en, coalesce(h.ex, d.ex) AS ex, coalesce(h.hi, d.hi) AS hi, coalesce(h.lo, d.lo) AS lo FROM d LEFT JOIN h USING (instrument, sd)), y AS (SELECT *, CASE WHEN sg > 0 THEN hi - en ELSE en - lo END / {PIPS} AS mfe, CASE WHEN sg > 0 THEN lo - en ELSE en - hi END / {PIPS} AS mae, sg * (ex - en) / {PIPS} AS cr FROM x) SELECT instrument, sd::VARCHAR AS session_date, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END AS side, source, round(mfe, 4) AS mfe, round(mae, 4) AS mae, round(cr, 4) AS close_return, round(CASE WHEN mfe - mae > 0 THEN mfe / (mfe - mae) ELSE 0.5 END, 4) AS path_ratio FROM y",
    "c7_recent_outcomes": SES + f", l AS (SELECT instrument, max(sd) AS today FROM d GROUP BY 1) SELECT instrument || '/' || sd::VARCHAR AS event_id, d.instrument, sd::VARCHAR AS session_date, round(sg * (ex - en) / {PIPS}, 4) AS close_return FROM d JOIN l USING (instrument) WHERE sd BETWEEN today - 20 AND today",
    "c8_slippage_rows": SES + f" SELECT s.instrument, sd::VARCHAR AS session_date, count(*) AS n, round(avg(abs(s.price * {PIPS} - en * {PIPS}) / {PIPS}), 5) AS slip FROM ss s JOIN d USING (instrument, sd) WHERE seq % 20 = 0 GROUP BY 1, 2",
    "c9_latest_run": RUNS + ", l AS (SELECT instrument, max(run_id) AS run_id FROM rn WHERE p50 IS NOT NULL GROUP BY 1) SELECT instrument, ts, run_id, round(p50, 5) AS p50 FROM rn JOIN l USING (instrument, run_id)",
    "c14_latest_book": BOOK + VPIN.replace("FROM good", "FROM (SELECT * REPLACE ('book' AS instrument) FROM good)") + ", bs AS (SELECT instrument, snap, sum(size) FILTER (WHERE side = 'B' AND level = 1) AS b1, sum(size) FILTER (WHERE side = 'A' AND level = 1) AS a1, sum(size) FILTER (WHERE side = 'B') AS b, sum(size) FILTER (WHERE side = 'A') AS a FROM lv GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY snap DESC) = 1), v AS (SELECT instrument, avg(abs(buy - sell) / (buy + sell)) AS vpin FROM (SELECT * FROM vb QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY bucket DESC) <= 50) GROUP BY 1) SELECT instrument, snap AS book_ts, round((b1 - a1) / (b1 + a1), 8) AS imbalance_l1, round((b - a) / (b + a), 8) AS imbalance_depth, round(vpin, 8) AS vpin FROM bs LEFT JOIN v USING (instrument)",
    "p5_engine_view": RUNS + " SELECT instrument, ts, round(p50, 5) AS p50, run_id, CASE st WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS structure_code FROM rn WHERE p50 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) = 1",
    "g1_distinct_reasons": ARC + GATE + " SELECT instrument, origin, array_to_string(rs, '|') AS reasons FROM states",
    "j6_gaussian_grid": "WITH " + RETURNS + f", c AS (SELECT *, CASE WHEN count(ret) OVER b >= 64 THEN stddev_samp(ret) OVER b END AS s FROM rets WINDOW b AS ({P} ROWS BETWEEN 255 PRECEDING AND CURRENT ROW)) SELECT instrument, ts, round(coalesce(ret, 0) + s * {lad.Z[0]!r}, 7) AS q01, round(coalesce(ret, 0) + s * {lad.Z[4]!r}, 7) AS q50, round(coalesce(ret, 0) + s * {lad.Z[7]!r}, 7) AS q95 FROM c WHERE s IS NOT NULL",
    "i11_sign_replication": ARC + ", p AS (SELECT instrument, mean / ((q[7] - q[3]) / 2) AS p50, y / ((q[7] - q[3]) / 2) AS y FROM ar), g AS (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE sign(p50) * y > 0) AS hits, avg(sign(p50) * y) AS gross FROM p WHERE abs(p50) >= 0.05 GROUP BY 1) SELECT instrument, n, hits, round(hits / n, 5) AS accuracy, round(gross, 5) AS gross, round(list_sum(list_transform(range(hits, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 5) AS p FROM g",
    "e20_freshness": "WITH t AS (SELECT 'events' AS name, max(ts)::TIMESTAMP AS last_ts, count(*) AS n_rows FROM events UNION ALL SELECT 'lineitem', max(l_shipdate)::TIMESTAMP, count(*) FROM lineitem UNION ALL SELECT 'orders', max(o_orderdate)::TIMESTAMP, count(*) FROM orders) SELECT name, last_ts, n_rows, last_ts >= max(last_ts) OVER () - INTERVAL 30 DAY AS fresh FROM t",
    "l3_event_reversal": B + ", e AS (SELECT o_orderdate::DATE AS date, sum(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END) AS net, count(*) FILTER (WHERE o_orderstatus IN ('O', 'F')) AS told, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), x AS (SELECT b.instrument, b.ts, told, coalesce(n, 0) AS n_events, CASE WHEN net > 0 AND close > open THEN 'long' WHEN net < 0 AND close < open THEN 'short' ELSE 'flat' END AS direction FROM bars b LEFT JOIN e ON b.ts::DATE = e.date) SELECT instrument, ts, direction, n_events, round(CASE WHEN direction = 'flat' THEN 0 ELSE least(1, 0.85 + 0.02 * (told - 1)) END, 6) AS strength FROM x",
    "l10_accuracy": DECIDED + ", m AS (SELECT instrument, (0.5 + strength / 2 >= 0.55)::INT AS p, (CASE direction WHEN 'long' THEN close_next > open_next ELSE close_next < open_next END)::INT AS l FROM dcs JOIN nxt USING (instrument, ts) WHERE direction <> 'flat' AND next_ts IS NOT NULL), c AS (SELECT instrument, count(*) FILTER (WHERE p = 1 AND l = 1) AS tp, count(*) FILTER (WHERE p = 1 AND l = 0) AS fp, count(*) FILTER (WHERE p = 0 AND l = 1) AS fn, count(*) FILTER (WHERE p = 0 AND l = 0) AS tn FROM m GROUP BY 1) SELECT *, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c",
    "l21_spread_filter": W + " SELECT instrument, count(*) FILTER (WHERE size <= 50) AS n_ok, count(*) AS n FROM good GROUP BY 1",
    "m5_position_ratio": W + ", s AS (SELECT user_id::VARCHAR AS instrument, sum(size) FILTER (WHERE side = 'B') AS l, sum(size) FILTER (WHERE side = 'A') AS s FROM good GROUP BY 1) SELECT instrument, round(CASE WHEN coalesce(l, 0) + coalesce(s, 0) > 0 THEN 100 * coalesce(l, 0) / (coalesce(l, 0) + coalesce(s, 0)) ELSE 50 END, 6) AS long_pct FROM s",
    "a4_dated_files": W + " SELECT ts::DATE::VARCHAR AS day, count(*) AS n, sum(size)::BIGINT AS volume FROM good WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1",
    "a5_record_scan": "SELECT ['A', 'C', 'M', 'F'][event_id % 4 + 1] AS action, CASE event_type WHEN 'click' THEN 'B' ELSE 'A' END AS side, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS size, min(event_id // 4) AS first_order FROM events WHERE event_id % 50 <> 7 GROUP BY 1, 2",
    "a6_candles": B + "SELECT instrument, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars WHERE day(ts) % 7 <> 0",
    "a7_yields": "WITH " + YIELDS + " SELECT date::DATE::VARCHAR AS date, round(us, 7) AS value FROM mac WHERE us IS NOT NULL",
    "a9_append_runs": ARC + " SELECT run_id, model, count(*) AS n FROM arc, (VALUES ('r1'), ('r2')) r(run_id) WHERE run_id = 'r1' OR model <> 'garch' GROUP BY 1, 2",
    "a10_persist_run": RUNS + """ SELECT instrument, name, n, 'run-1' AS run_id, '{"source": "lineitem", "vol_window": 256}' AS config FROM (SELECT instrument, 'bars' AS name, count(*) AS n FROM bars GROUP BY 1 UNION ALL SELECT instrument, 'conditioned', count(*) FROM rn GROUP BY 1)""",
    "a16_sampled_paths": "WITH s AS (SELECT vec_id // 20 AS origin, unnest(embedding) AS x, unnest(range(len(embedding)))::INTEGER AS step FROM embeddings) SELECT origin, step, count(*) AS n_paths, round(avg(100 * exp(x::DOUBLE / 10)), 5) AS mean_close FROM s GROUP BY 1, 2",
}
