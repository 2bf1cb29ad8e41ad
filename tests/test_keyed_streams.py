"""The book stream against the replay over restarts, and keyed tables over repeated epochs and late rows."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.test_book import MESSAGE, messages
from tidemill.operators import micro
from tidemill.streaming.bars import run_to_table
from tidemill.streaming.book import book_stream, map_states
from tidemill.streaming.sink import KeyedTable, write_keyed


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_book_stream_equals_the_replay_over_a_restart(spark, folder):
    rows = messages(random.Random(21), 700)
    parts = [rows[:150], rows[150:400], rows[150:400], rows[400:]]  # one comes twice
    got = None
    for k in (2, 4):  # a second start goes on from the checkpoint
        for part in parts[k - 2 : k]:
            spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        with map_states(spark):
            got = run_to_table(book_stream(stream_of(spark, folder, MESSAGE), every=20.0, depth=3), folder, spark)
    want = micro.replay_book(spark.createDataFrame(rows, MESSAGE), every=20.0, depth=3)
    cells = lambda df: sorted(map(tuple, df.select(want.columns).collect()), key=repr)
    assert cells(got) == cells(want) and got.count() > 100


KEYED = "k string, ts timestamp, v long"


def put(spark, folder, rows):
    spark.createDataFrame(rows, "k string, t long, v long").select("k", F.timestamp_seconds("t").alias("ts"), "v").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def content(table):
    return sorted((r.k, int(r.ts.timestamp()), r.v) for r in table.read().collect())


def test_repeated_epochs_and_late_rows_leave_one_row_a_key(spark, folder):
    table = KeyedTable(spark, f"{folder}/table", KEYED, ["k"], ["ts"])
    assert content(table) == []
    for rows in ([("a", 100, 1), ("b", 100, 2)], [("a", 90, 9), ("b", 110, 3), ("c", 5, 4)], [("a", 120, 5), ("a", 119, 6)]):
        put(spark, folder, rows)
        write_keyed(stream_of(spark, folder, KEYED), table, f"{folder}/state")
    want = [("a", 120, 5), ("b", 110, 3), ("c", 5, 4)]
    assert content(table) == want and len(table.epochs()) == 3
    again = spark.read.schema(KEYED).parquet(f"{folder}/in").where("k = 'b'")
    table.merge(again, 1)  # the epoch is written once more, now with fewer rows, as if it had failed half-way
    assert content(table) == [("a", 120, 5), ("b", 110, 3)]
    table.merge(spark.read.schema(KEYED).parquet(f"{folder}/in").where("ts != timestamp_seconds(120)"), 1)
    assert content(table) == want
    table.compact()
    assert content(table) == want and table.epochs() == []
    table.merge(again, 1)  # an epoch that the base holds is not read again
    put(spark, folder, [("d", 7, 7), ("c", 4, 0)])
    write_keyed(stream_of(spark, folder, KEYED), table, f"{folder}/state", compact_every=1)
    assert content(table) == [*want, ("d", 7, 7)]


def test_duplicates_within_the_watermark_are_taken_once(spark, folder):
    counted = KeyedTable(spark, f"{folder}/table", KEYED, ["k", "ts", "v"], ["ts"])
    seen = []
    keep = counted.merge
    counted.merge = lambda rows, epoch: (seen.append(rows.count()), keep(rows, epoch))
    for _ in range(2):
        put(spark, folder, [("a", 100, 1), ("a", 101, 2)])
    put(spark, folder, [("a", 102, 3)])
    write_keyed(stream_of(spark, folder, KEYED), counted, f"{folder}/state", unique=["k", "ts", "v"])
    assert sum(seen) == 3 and content(counted) == [("a", 100, 1), ("a", 101, 2), ("a", 102, 3)]


def test_volume_bars_by_batches_equal_one_scan_over_a_restart(spark, folder):
    from tests.test_chunks import COLUMNS, ROW, plain, random_tape
    from tidemill.streaming.bars import volume_bar_batches

    rows = sorted(random_tape(random.Random(41), 600), key=lambda r: (r[1], r[0], r[2]))
    parts = [rows[:200], rows[200:450], rows[200:450], rows[450:]]  # one comes twice
    for k in (2, 4):
        for part in parts[k - 2 : k]:
            spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = volume_bar_batches(stream_of(spark, folder, ROW), 90, folder, spark)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == plain(sorted(rows), 90)
