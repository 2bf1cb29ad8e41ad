"""Queries over streams, tail probabilities, sampling scans and the meta-model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import binomial_p, chi2_sf, t_p_value
from ..operators import ladder as lad
from ..operators import bars, book, micro, scans
from ..sources.tables import event_stream, read, shared_folder, tape_stream
from ..sources.tables import tape as events_tape
from ..streaming import states
from ..streaming.bars import h4_bar_stream, run_to_table, session_bar_stream, volume_bar_batches, volume_bar_stream, with_refreshed
from ..streaming.book import book_stream, map_states
from ..streaming.sink import KeyedTable, write_keyed
from .p_decisions import VPIN, decided
from .p_ladder import arc
from .p_tape import SQL as TAPE_SQL
from .p_tape import VOLUME_BARS, W, good
from .shared import dated, rounded


def s1_volume_bar_stream(spark, sf_dir):
    return run_to_table(volume_bar_stream(tape_stream(spark, sf_dir), 500), shared_folder(spark, "stream"), spark)


def s1_volume_bar_batches(spark, sf_dir):
    return volume_bar_batches(tape_stream(spark, sf_dir), 500, shared_folder(spark, "stream"), spark)


def s8_session_bar_stream(spark, sf_dir):
    return dated(session_bar_stream(tape_stream(spark, sf_dir), shared_folder(spark, "stream"), spark))


def p1_p_values(spark, sf_dir):
    """Tail probabilities of the calibration, accuracy and comparison statistics."""
    a = arc(spark, sf_dir)
    dm = lad.diebold_mariano(a)
    hits = lad.directions(a).withColumn("k", F.round(F.col("accuracy") * F.col("n")).cast("long"))
    found = lad.pit_chi2(a).join(dm.select(*lad.KEY, "dm", F.col("n").alias("n_dm")), lad.KEY, "left").join(hits.select(*lad.KEY, "k", F.col("n").alias("n_hit")), lad.KEY)
    return rounded(found.select(*lad.KEY, chi2_sf(F.col("chi2"), F.lit(9.0)).alias("pit_p"), t_p_value(F.col("dm"), F.col("n_dm") - 1).alias("dm_p"), binomial_p(F.col("k"), F.col("n_hit")).alias("sign_p")), 6)


def n3_time_samples(spark, sf_dir):
    return scans.sample_every(good(spark, sf_dir), 3600.0).select("instrument", "ts", "seq", "price")


def n11_rule_trades(spark, sf_dir):
    return rounded(scans.rule_trades(good(spark, sf_dir)), 6)


def l9_meta_model(spark, sf_dir):
    from ..operators.meta import meta_scores
    from ..sources.tables import daily_bars

    return rounded(meta_scores(decided(spark, sf_dir), daily_bars(spark, sf_dir)), 4)


def s2_condition_stream(spark, sf_dir):
    rows = run_to_table(states.condition_stream(tape_stream(spark, sf_dir)), shared_folder(spark, "stream"), spark)
    return rounded(rows.select("instrument", "seq", "ret", "sigma", "scaled"), 6)


def s3_bucket_stream(spark, sf_dir):
    return run_to_table(states.bucket_stream(tape_stream(spark, sf_dir), 500), shared_folder(spark, "stream"), spark)


def s4_tick_stream(spark, sf_dir):
    rows = run_to_table(states.tick_stream(tape_stream(spark, sf_dir)), shared_folder(spark, "stream"), spark)
    return rounded(rows.select("instrument", "seq", "filtered", "spike", "level"), 6)


def s5_in_order(spark, sf_dir):
    """The tape through the reordering buffer, counted by instrument; what is within the lateness of the end is held."""
    rows = run_to_table(states.in_order(tape_stream(spark, sf_dir)), shared_folder(spark, "stream"), spark)
    return rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


def s7_refreshed_scales(spark, sf_dir):
    """Ticks of the stream with their instrument's scale, which each micro-batch reads anew."""
    folder = shared_folder(spark, "stream")
    good(spark, sf_dir).groupBy("instrument").agg(F.stddev_samp("price").alias("scale")).write.parquet(f"{folder}/meta")
    rows = with_refreshed(tape_stream(spark, sf_dir), f"{folder}/meta", ["instrument"], folder, spark)
    return rounded(rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price") / F.col("scale")).alias("total")), 4)


def s8_h4_bar_stream(spark, sf_dir):
    return h4_bar_stream(tape_stream(spark, sf_dir), shared_folder(spark, "stream"), spark)


def n1_book_replay(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value > 0")
    action = F.element_at(F.array(*[F.lit(x) for x in "AAMF"]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select(F.lit("book").alias("instrument"), "ts", F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("event_type") == "click", "B").otherwise("A").alias("side"), (F.col("event_id") % 97).alias("order_id"), F.round("value").alias("price"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("size"))
    return rounded(micro.replay_book(rows.withColumn("instrument", F.date_format("ts", "yyyy-MM-dd")), 3600.0), 6)


def book_messages(events):
    """Book messages from events, an instrument a day: adds, changes, fills, removals and a clearing now and then."""
    e = events.where("value > 0")
    action = F.when(F.col("event_id") % 501 == 0, "R").otherwise(F.element_at(F.array(*[F.lit(x) for x in "AAMFAMCF"]), (F.col("event_id") % 8 + 1).cast("int")))
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("instrument"), "ts", F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("event_type") == "click", "B").otherwise("A").alias("side"), (F.col("event_id") % 97).alias("order_id"), F.round("value").alias("price"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("size"))


def last_of_hours(messages):
    """The last message of every hour."""
    return messages.groupBy("instrument", F.date_trunc("hour", "ts").alias("hour")).agg(F.max(F.struct("ts", "seq")).alias("x")).select("instrument", "x.ts", "x.seq")


BOOK = ["instrument", "seq", "bid_px", "ask_px", "bid_sz", "ask_sz", "imbalance_l1", "imbalance_depth"]


def n1_book_at(spark, sf_dir):
    """The book after the last message of every hour."""
    messages = book_messages(read(spark, sf_dir, "events"))
    return rounded(book.book_at(messages, last_of_hours(messages)).select(BOOK), 6)


def s3_book_stream(spark, sf_dir):
    """The same from the stream, sampled at every message."""
    events, folder = read(spark, sf_dir, "events"), shared_folder(spark, "stream")
    messages, stream = book_messages(events), book_messages(event_stream(spark, sf_dir, rows_per_file=8_000_000))  # books are days: a trigger takes several at once
    with map_states(spark):
        found = run_to_table(book_stream(stream, every=0.0), folder, spark)
    return rounded(found.join(last_of_hours(messages), ["instrument", "ts", "seq"], "left_semi").select(BOOK), 6)


def s6_keyed_table(spark, sf_dir):
    """The tape's stream into a table of each user's last event; its rows come a second time as late ones."""
    folder = shared_folder(spark, "stream")
    rows = events_tape(spark, sf_dir, "user_id").select("instrument", "ts", "seq", "price")
    rows.repartition(3, "seq").write.parquet(f"{folder}/in")
    rows.where("seq % 3 = 0").write.mode("append").parquet(f"{folder}/in")
    table = KeyedTable(spark, f"{folder}/table", rows.schema, ["instrument"], ["ts", "seq"])
    write_keyed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), table, f"{folder}/state", compact_every=2)
    return table.read()


def halves(rows):
    """rows up to and after the middle of their instrument's time."""
    middle = rows.groupBy("instrument").agg(F.timestamp_add("SECOND", (F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 2).cast("long"), F.min("ts")).alias("_middle"))
    both = rows.join(middle, "instrument")
    return both.where("ts <= _middle").drop("_middle"), both.where("ts > _middle").drop("_middle")


def n9_bars_resumed(spark, sf_dir):
    """Volume bars of two halves of the tape, the second from the first one's stored state."""
    first, second = halves(good(spark, sf_dir))
    state = bars.bar_state(bars.extend_bars(first, 500))
    folder = shared_folder(spark, "state")
    state.write.parquet(folder)
    state = spark.read.schema(state.schema).parquet(folder)
    return bars.volume_bars(first, 500).unionByName(bars.volume_bars(second, 500, state))


def n9_ticks_resumed(spark, sf_dir):
    """Conditioned ticks of two halves of the tape, the second from the first one's stored states."""
    first, second = halves(good(spark, sf_dir))
    folder = shared_folder(spark, "state")
    scanned = micro.scan_ticks(first)
    scanned.write.parquet(folder)  # ticks and states of one scan
    scanned = spark.read.schema(scanned.schema).parquet(folder)
    states = scanned.where("state is not null").select("instrument", "state")
    found = scanned.where("state is null").drop("state").unionByName(micro.condition_ticks(second, states))
    return rounded(found.select("instrument", "seq", "filtered", "spike", "level"), 6)


QUERIES = {f.__name__: f for f in (s1_volume_bar_stream, s1_volume_bar_batches, s8_session_bar_stream, p1_p_values, n3_time_samples, n11_rule_trades, l9_meta_model, s2_condition_stream, s3_bucket_stream, s4_tick_stream, s5_in_order, s7_refreshed_scales, s8_h4_bar_stream, n1_book_replay, n1_book_at, s3_book_stream, s6_keyed_table, n9_bars_resumed, n9_ticks_resumed)}
BOOK_SQL = """
WITH m AS (
  SELECT ts::DATE::VARCHAR AS instrument, ts, event_id AS seq,
         CASE WHEN event_id % 501 = 0 THEN 'R' ELSE ['A', 'A', 'M', 'F', 'A', 'M', 'C', 'F'][event_id % 8 + 1] END AS action,
         CASE event_type WHEN 'click' THEN 'B' ELSE 'A' END AS side, event_id % 97 AS order_id, round(value) AS price,
         regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT + 1 AS size
  FROM events WHERE value > 0),
e AS (SELECT *, count(*) FILTER (WHERE action = 'R') OVER (PARTITION BY instrument ORDER BY ts, seq) AS life FROM m),
o AS (SELECT *, count(*) FILTER (WHERE action <> 'F') OVER (PARTITION BY instrument, life, order_id ORDER BY ts, seq) AS st FROM e WHERE action <> 'R'),
l AS (
  SELECT *, first(action) OVER w AS a0, first(side) OVER w AS side0, first(price) OVER w AS price0,
         first(size) OVER w - coalesce(sum(size) FILTER (WHERE action = 'F') OVER w, 0)::BIGINT AS rest
  FROM o WINDOW w AS (PARTITION BY instrument, life, order_id, st ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, lead(ts) OVER p AS ts2, lead(seq) OVER p AS seq2 FROM l WINDOW p AS (PARTITION BY instrument, life, order_id ORDER BY ts, seq)),
q AS (SELECT instrument, ts, seq, life FROM e QUALIFY row_number() OVER (PARTITION BY instrument, date_trunc('hour', ts) ORDER BY ts DESC, seq DESC) = 1),
lv AS (
  SELECT q.instrument, q.seq, x.side0 AS side, x.price0 AS price, sum(rest)::BIGINT AS size
  FROM q JOIN x ON x.instrument = q.instrument AND x.life = q.life AND (x.ts, x.seq) <= (q.ts, q.seq) AND (x.ts2 IS NULL OR (x.ts2, x.seq2) > (q.ts, q.seq))
  WHERE a0 IN ('A', 'M') AND rest > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument, seq, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS k FROM lv),
s AS (
  SELECT instrument, seq, max(price) FILTER (WHERE side = 'B' AND k = 1) AS bid_px, max(price) FILTER (WHERE side = 'A' AND k = 1) AS ask_px,
         max(size) FILTER (WHERE side = 'B' AND k = 1) AS bid_sz, max(size) FILTER (WHERE side = 'A' AND k = 1) AS ask_sz,
         sum(size) FILTER (WHERE side = 'B') AS b, sum(size) FILTER (WHERE side = 'A') AS a
  FROM r WHERE k <= 10 GROUP BY ALL)
SELECT q.instrument, q.seq, bid_px, ask_px, bid_sz, ask_sz, round((bid_sz - ask_sz) / (bid_sz + ask_sz), 6) AS imbalance_l1, round((b - a) / (b + a), 6) AS imbalance_depth
FROM q LEFT JOIN s ON s.instrument = q.instrument AND s.seq = q.seq"""
SQL = {
    "n1_book_at": BOOK_SQL,
    "s3_book_stream": BOOK_SQL,
    "s6_keyed_table": TAPE_SQL["d12_latest_per_key"],
    "n9_bars_resumed": VOLUME_BARS + "SELECT * FROM vbars",
    "s1_volume_bar_batches": VOLUME_BARS + "SELECT * FROM vbars",
    "s1_volume_bar_stream": VOLUME_BARS + "SELECT instrument, bar_seq, open, high, low, close, volume, n_trades FROM vbars",
    "s8_session_bar_stream": TAPE_SQL["d2_session_bars"],
    "s8_h4_bar_stream": TAPE_SQL["d3_h4_bars"],
    "s3_bucket_stream": W + VPIN + " SELECT * FROM vb",
    "s2_condition_stream": W + ", r AS (SELECT *, ln(price) - ln(lag(price) OVER (PARTITION BY instrument ORDER BY ts, seq)) AS ret FROM good), c AS (SELECT *, CASE WHEN count(ret) OVER b >= 64 THEN stddev_samp(ret) OVER b END AS sg FROM r WINDOW b AS (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING)) SELECT instrument, seq, round(ret, 6) AS ret, round(sg, 6) AS sigma, round(CASE WHEN sg > 0 THEN ret / sg END, 6) AS scaled FROM c",
    "s7_refreshed_scales": W + ", m AS (SELECT instrument, stddev_samp(price) AS s FROM good GROUP BY 1) SELECT instrument, count(*) AS n, round(sum(price / s), 4) AS total FROM good JOIN m USING (instrument) GROUP BY 1",
}
