"""The data source of dated Zstandard files, and the table functions against the DataFrame forms."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemill.functions.tables import register
from tidemill.operators import ladder, micro
from tidemill.sources.days import read_days, write_days

SCHEMA = "day date, instrument string, price double, note string"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows_of(spark, n=400):
    return spark.range(n).select(F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 9).cast("int")).alias("day"), F.concat(F.lit("i"), F.col("id") % 3).alias("instrument"), (F.col("id") / 8).alias("price"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('a "b", '), F.col("id"))).alias("note"))


def test_days_come_back_and_others_stay_shut(spark, folder):
    write_days(rows_of(spark), folder)
    write_days(rows_of(spark, 50), folder)
    names = os.listdir(folder)
    assert len({n.split(".")[0] for n in names}) == 9 and all(n.endswith(".csv.zst") for n in names)
    for day in ("20240301", "20240309", "20231231"):  # of a day outside; opening it would fail
        with open(f"{folder}/tape-{day}.broken.csv.zst", "wb") as f:
            f.write(b"not zstandard")
    with open(f"{folder}/tape-20240304.txt", "w") as f:
        f.write("another kind of file")
    got = read_days(spark, folder, SCHEMA, "2024-03-02", "2024-03-08")
    want = rows_of(spark).union(rows_of(spark, 50)).where("day between '2024-03-02' and '2024-03-08'")
    cells = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert cells(got) == cells(want)
    inside = [n for n in names if "20240302" <= n[5:13] <= "20240308"]
    assert got.rdd.getNumPartitions() == len(inside)
    with pytest.raises(Exception):
        read_days(spark, folder, SCHEMA, "2024-03-01", "2024-03-02").count()


def test_no_day_in_the_range(spark, folder):
    write_days(rows_of(spark, 5), folder)
    assert read_days(spark, folder, SCHEMA, "2020-01-01", "2020-12-31").collect() == []


def test_a_file_of_many_batches(spark, folder):
    write_days(spark.range(200_000).select(F.lit(dt.date(2024, 5, 6)).alias("day"), F.lit("x").alias("instrument"), F.col("id").cast("double").alias("price"), F.lit("n" * 40).alias("note")), folder)
    found = read_days(spark, folder, SCHEMA, "2024-05-06", "2024-05-06").agg(F.count("note"), F.sum("price")).first()
    assert tuple(found) == (200_000, sum(range(200_000)))


def test_table_functions_equal_the_dataframe_forms(spark):
    register(spark)
    lengths = [0, 50, 258, 259, 300, 411]
    series = spark.createDataFrame([(f"i{n}", k, 0.0) for n in lengths for k in range(n)], "instrument string, n int, ret double")
    spark.createDataFrame([(f"i{n}", n) for n in lengths], "instrument string, len int").createOrReplaceTempView("lengths")
    cells = lambda df: sorted(map(tuple, df.collect()))
    got = spark.sql("SELECT instrument, s.* FROM lengths, LATERAL walk_splits(len, 3, 250, 4, 5) s")
    want = ladder.splits(series, horizon=3, min_train=250, step=4, embargo=5)
    assert cells(got) == cells(want.select(got.columns)) and got.count() > 20
    lagged = spark.sql("SELECT instrument, s.* FROM lengths, LATERAL split_lags(len, 3, 250, 4, 5, 3) s")
    assert cells(lagged) == sorted((*r, k) for r in cells(got) for k in (1, 2, 3))
    trades = spark.range(500).select(F.concat(F.lit("x"), F.col("id") % 3).alias("instrument"), F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"), (1 + F.col("id") * 13 % 90).alias("size"), F.element_at(F.array(F.lit("B"), F.lit("A"), F.lit("N")), (F.col("id") % 3 + 1).cast("int")).alias("side"))
    trades.repartition(4).createOrReplaceTempView("trades")
    found = spark.sql("SELECT * FROM volume_buckets(TABLE(trades) PARTITION BY instrument ORDER BY (ts, seq), 50)")
    assert cells(found) == cells(micro.vpin_buckets(trades, 50).select(found.columns)) and found.count() > 100
