"""The book from lives of orders against a replay, message by message."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import book, micro

T0 = dt.datetime(2024, 1, 2, 14, 0)
MESSAGE = "instrument string, ts timestamp_ntz, seq long, action string, side string, order_id long, price double, size long"


def messages(rng, n, actions="AAAAMMFFCCRT"):
    rows, t = [], T0
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 0.2, 1, 30, 200]))
        action = rng.choice(actions)
        rows.append((rng.choice("XY"), t, i, "A" if action == "R" and rng.random() < 0.9 else action, rng.choice("ABABN"), rng.randrange(12), float(rng.randrange(95, 105)), rng.randrange(0, 9)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_any_time_equals_the_replay(spark, seed):
    rows = messages(random.Random(seed), 900)
    records = spark.createDataFrame(rows, MESSAGE).repartition(4)
    replayed = micro.replay_book(records, every=20.0, depth=3).drop("n_orders")
    times = replayed.select("instrument", "ts", "seq")
    got = book.book_at(records, times, depth=3)
    cells = lambda df: sorted(map(tuple, df.select(replayed.columns).collect()), key=repr)
    want = cells(replayed)
    assert cells(got) == want and len(want) > 100


def test_times_between_and_around_messages(spark):
    rows = [("X", T0, 1, "A", "B", 1, 100.0, 5), ("X", T0, 2, "A", "A", 2, 100.25, 4), ("X", T0 + dt.timedelta(minutes=9), 3, "F", "A", 2, 100.25, 3), ("X", T0 + dt.timedelta(minutes=20), 4, "R", "N", 0, 0.0, 0)]
    at = [(-1, 0), (0, 1), (0, 2), (5, 0), (9, 2), (9, 3), (19, 9), (20, 4), (30, 0)]
    times = spark.createDataFrame([("X", T0 + dt.timedelta(minutes=m), s) for m, s in at], "instrument string, ts timestamp_ntz, seq long")
    got = {(r.ts, r.seq): (r.bid_sz, r.ask_sz) for r in book.book_at(spark.createDataFrame(rows, MESSAGE), times).collect()}
    want = [(None, None), (5, None), (5, 4), (5, 4), (5, 4), (5, 1), (5, 1), (None, None), (None, None)]
    assert [got[T0 + dt.timedelta(minutes=m), s] for m, s in at] == want


def test_by_hand(spark):
    steps = [("A", "B", 1, 100.0, 5), ("A", "B", 2, 99.75, 3), ("A", "A", 3, 100.25, 4), ("M", "B", 1, 99.75, 2), ("F", "A", 3, 100.25, 3), ("F", "A", 3, 100.25, 1), ("A", "A", 4, 100.5, 2), ("C", "B", 2, 0.0, 0)]
    rows = [("X", T0 + dt.timedelta(seconds=i), i, *s) for i, s in enumerate(steps)]
    records = spark.createDataFrame(rows, MESSAGE)
    got = book.book_at(records, records.select("instrument", "ts", "seq")).orderBy("seq").collect()
    assert [(r.bid_px, r.bid_sz, r.ask_px, r.ask_sz) for r in got] == [
        (100.0, 5, None, None), (100.0, 5, None, None), (100.0, 5, 100.25, 4), (99.75, 5, 100.25, 4), (99.75, 5, 100.25, 1), (99.75, 5, None, None), (99.75, 5, 100.5, 2), (99.75, 2, 100.5, 2),
    ]
    deep = [("X", T0, i, "A", "B", 100 + i, 100 - i * 0.25, 10) for i in range(15)] + [("X", T0, 20, "A", "A", 200, 100.25, 10)]
    last = spark.createDataFrame([("X", T0, 20)], "instrument string, ts timestamp_ntz, seq long")
    assert book.book_at(spark.createDataFrame(deep, MESSAGE), last).first().imbalance_depth == pytest.approx(90 / 110)


def test_no_messages(spark):
    times = spark.createDataFrame([("X", T0, 1)], "instrument string, ts timestamp_ntz, seq long")
    none = spark.createDataFrame([], MESSAGE)
    assert book.book_at(none, times).first().bid_px is None and book.book_at(none, times.limit(0)).count() == 0
    assert book.level_changes(none).where(F.lit(True)).count() == 0


def test_summed_level_changes(spark, sf_dir, tmp_path):
    """The book of the lines by summed changes equals the one by messages, repeated lines included."""
    from tidemill.sources import tables

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1500)
    lines.unionByName(lines.limit(200)).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    times = tables.daily_bars(spark, str(tmp_path)).select("instrument", "ts", F.lit(2).cast("long").alias("seq"))
    want = book.book_at(tables.line_orders(spark, str(tmp_path)), times)
    got = book.book_of(tables.line_changes(spark, str(tmp_path)), times)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("bid_px is not null").count() > 100
    with tables.bars_once(spark, str(tmp_path)):
        stored = tables.daily_bars(spark, str(tmp_path))
    assert not any("lineitem" in f for f in stored.inputFiles())
    assert any("lineitem" in f for f in tables.daily_bars(spark, str(tmp_path)).inputFiles())
