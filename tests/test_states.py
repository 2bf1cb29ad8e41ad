"""Streams over several micro-batches against the batch forms; book replay and state round trips by hand."""

import math
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemill.operators import micro, prep
from tidemill.operators.micro import Book, TickState
from tidemill.streaming import states
from tidemill.streaming.bars import h4_bar_stream, run_to_table
from tidemill.operators.bars import h4_bars

ROW = "instrument string, ts timestamp_ntz, seq long, price double, size long, side string"


@pytest.fixture(scope="module")
def trades(spark):
    t = spark.range(900).select(F.concat(F.lit("i"), (F.col("id") % 2).cast("string")).alias("instrument"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 61).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"), (100 + F.sin("id") + F.when(F.col("id") % 211 == 0, 40).otherwise(0)).alias("price"), (1 + F.col("id") * 7 % 23).alias("size"), F.element_at(F.array(F.lit("B"), F.lit("A"), F.lit("N")), (F.col("id") % 3 + 1).cast("int")).alias("side"))
    return t


@pytest.fixture
def parts(spark, trades):
    """The trades in five files in order of time, one for each micro-batch; the second one comes twice."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k in (0, 1, 1, 2, 3, 4):
        trades.where(F.floor(F.col("seq") / 180) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


def same(a, b, keys, digits=9):
    cells = lambda df: sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.select(*keys).collect())
    x, y = cells(a), cells(b)
    assert x == y and x


def test_bucket_stream(spark, trades, parts):
    got = run_to_table(states.bucket_stream(parts[0], 100), parts[1], spark)
    same(got, micro.vpin_buckets(trades, 100), ["instrument", "bucket", "buy", "sell", "close_ts"])


def test_condition_stream(spark, trades, parts):
    got = run_to_table(states.condition_stream(parts[0], 50, 10), parts[1], spark).where("sigma is not null")
    rets = prep.log_returns(trades.select("instrument", "ts", "seq", "price"))
    assert got.count() == 900 - 2 * 11
    same(got, prep.condition(rets, 50, 10).where("scaled is not null"), ["instrument", "seq", "ret", "scaled"], 7)


def test_tick_stream(spark, trades, parts):
    got = run_to_table(states.tick_stream(parts[0]), parts[1], spark)
    same(got, micro.condition_ticks(trades), ["instrument", "seq", "filtered", "spike", "level", "velocity"])


def test_h4_stream_counts_late_parts(spark, trades):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k in (3, 0, 2, 1):
        trades.where(F.col("seq") % 4 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    same(h4_bar_stream(stream, folder, spark), h4_bars(trades), ["instrument", "bar_start", "open", "high", "low", "close", "volume", "n_trades"])


def test_in_order(spark, trades):
    """Rows that come up to ten minutes late are put in their place before buckets are filled."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    late = trades.withColumn("_f", F.floor((F.col("seq") + F.when(F.col("seq") % 5 == 0, 9).otherwise(0)) / 180))
    for k in range(6):
        late.where(F.col("_f") == k).drop("_f").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = [(r.instrument, r.seq) for r in run_to_table(states.in_order(stream), folder, spark).collect()]
    assert len(got) == len(set(got)) and len(got) >= 900 - 30
    last = max(s for _, s in got)
    assert {s for _, s in got} >= set(range(last - 25))


def test_state_round_trip():
    a = TickState()
    for i in range(60):
        a.tick(1.144 + 1e-4 * math.sin(i / 3), float(i))
    b = TickState.restore(a.export())
    assert a.tick(1.1442, 60.5) == b.tick(1.1442, 60.5) and a.export() == b.export()


def test_book():
    book = Book()
    for record in [("A", "B", 1, 99.5, 4), ("A", "B", 2, 99.75, 9), ("A", "A", 3, 100.0, 1), ("M", "N", 2, 99.75, 9), ("F", "B", 2, 99.75, 4), ("M", "N", 8, 1.0, 1)]:
        book.apply(*record)
    assert book.snapshot()[:4] == (99.75, 100.0, 5, 1) and book.snapshot()[4] == pytest.approx(4 / 6)
    book.apply("C", "A", 3, 0.0, 0)
    assert book.snapshot() == (99.75, None, 5, None, None, None, 2)
    book.apply("R", "N", 0, 0.0, 0)
    assert book.snapshot() == (None, None, None, None, None, None, 0)
    for i in range(15):
        book.apply("A", "B", i, 90.0 - i, 10)
    book.apply("A", "A", 99, 91.0, 10)
    assert book.snapshot()[5] == pytest.approx(90 / 110)


def test_replay(spark):
    rows = [("x", 0, "A", "B", 1, 10.0, 5), ("x", 1, "A", "A", 2, 11.0, 5), ("x", 2, "F", "A", 2, 11.0, 2), ("x", 3, "R", "N", 0, 0.0, 0), ("y", 0, "A", "A", 1, 7.0, 1)]
    df = spark.createDataFrame([(i, s, a, d, o, p, z) for i, s, a, d, o, p, z in rows], "instrument string, seq long, action string, side string, order_id long, price double, size long").withColumn("ts", F.timestamp_seconds("seq").cast("timestamp_ntz"))
    got = {(r.instrument, r.seq): (r.bid_sz, r.ask_sz, r.n_orders) for r in micro.replay_book(df, 1.0).collect()}
    assert got == {("x", 0): (5, None, 1), ("x", 1): (5, 5, 2), ("x", 2): (5, 3, 2), ("x", 3): (None, None, 0), ("y", 0): (None, 1, 1)}


def test_two_days_apart_equal_one_scan_of_ticks(spark, trades):
    ticks = trades.select("instrument", "ts", "seq", "price")
    early, late = ticks.where("seq < 500"), ticks.where("seq >= 500 and instrument = 'i1' or seq between 500 and 700")
    states = spark.createDataFrame(micro.tick_states(early).collect(), "instrument string, state string")
    keys = ["instrument", "seq", "filtered", "spike", "level", "velocity"]
    same(micro.condition_ticks(early).union(micro.condition_ticks(late, states)), micro.condition_ticks(early.union(late)), keys, 12)
    after = {r.instrument: r.state for r in micro.tick_states(late, states).collect()}
    assert after == {r.instrument: r.state for r in micro.tick_states(early.union(late)).collect()}
    none = ticks.limit(0)
    assert {r.instrument: r.state for r in micro.tick_states(none, states).collect()} == {r.instrument: r.state for r in states.collect()}
    assert micro.condition_ticks(none, states).count() == 0


def test_two_days_apart_equal_one_scan_of_the_book(spark):
    import random

    from tests.test_book import MESSAGE, messages

    rows = messages(random.Random(31), 600)
    early, late, whole = (spark.createDataFrame(r, MESSAGE) for r in (rows[:250], rows[250:], rows))
    states = spark.createDataFrame(micro.book_states(early, 20.0, 3).collect(), "instrument string, state string")
    got = micro.replay_book(early, 20.0, 3).union(micro.replay_book(late, 20.0, 3, states))
    cells = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert cells(got) == cells(micro.replay_book(whole, 20.0, 3))
    assert cells(micro.book_states(late, 20.0, 3, states)) == cells(micro.book_states(whole, 20.0, 3))
