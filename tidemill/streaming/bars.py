"""Bars on streams: the forming bar is state, keyed sinks take late corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sink import KeyedTable
from .states import fresh_rows, slices
from ..operators.bars import BAR_STATE, bar_state, extend_bars, h4_start, session_date, strictly_increasing

BAR = "instrument string, bar_seq long, open double, high double, low double, close double, volume long, n_trades long"
STATE = "bar_seq long, open double, high double, low double, close double, volume long, n_trades long, last_ts long, last_seq long"


def _extend(bar_size: int):
    def run(key, batches, state):
        bar, o, h, l, c, volume, n, last_ts, last_seq = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0, 0, -(1 << 62), -1)
        for rows in slices(fresh_rows(batches, (last_ts, last_seq))):
            micros, out = rows["ts"].astype("datetime64[us]").astype("int64"), []
            for ts, seq, price, size in zip(micros.tolist(), rows["seq"].tolist(), rows["price"].tolist(), rows["size"].tolist()):
                last_ts, last_seq = ts, seq
                o, h, l, c = (price,) * 4 if n == 0 else (o, max(h, price), min(l, price), price)
                volume, n = volume + size, n + 1
                if volume >= bar_size:
                    out.append((key[0], bar, o, h, l, c, volume, n))
                    bar, volume, n = bar + 1, 0, 0
            yield pd.DataFrame(out, columns=[x.split()[0] for x in BAR.split(", ")])
        state.update((bar, o, h, l, c, volume, n, last_ts, last_seq))

    return run


def volume_bar_stream(trades: DataFrame, bar_size: int) -> DataFrame:
    """Closed volume bars; the forming bar and the high-water mark of each instrument are kept as state, so a
    restart from the checkpoint goes on with the same bar. Rows at or before the mark are skipped."""
    rows = trades.select("instrument", "ts", "seq", "price", "size")
    return rows.groupBy("instrument").applyInPandasWithState(_extend(bar_size), BAR, STATE, "append", "NoTimeout")


MARK = "instrument string, ts timestamp_ntz, seq long"


def volume_bar_batches(trades: DataFrame, bar_size: int, folder: str, spark: SparkSession) -> DataFrame:
    """The closed volume bars of a stream whose instruments may be hot: every micro-batch is a batch of
    ``extend_bars`` from the stored state of the one before, so its trades spread by chunk, not by instrument. A
    repeated epoch starts from the same state and replaces itself. Rows at or before an instrument's last one are
    skipped."""
    stored = lambda kind, schema, epoch: spark.read.schema(schema).parquet(f"{folder}/{kind}/epoch={epoch}") if epoch >= 0 else spark.createDataFrame([], schema)
    bar = "instrument string, bar_seq long, close_ts timestamp_ntz, open double, high double, low double, close double, volume long, n_trades long"
    table = KeyedTable(spark, f"{folder}/bars", bar, ["instrument", "bar_seq"], ["bar_seq"])

    def write(batch: DataFrame, epoch: int) -> None:
        state, marks = stored("state", BAR_STATE, epoch - 1), stored("marks", MARK, epoch - 1)
        last = marks.select("instrument", F.struct("ts", "seq").alias("_last"))
        rows = batch.select("instrument", "ts", "seq", "price", "size").dropDuplicates(["instrument", "ts", "seq"])
        new = rows.join(last, "instrument", "left").where(F.col("_last").isNull() | (F.struct("ts", "seq") > F.col("_last"))).drop("_last")
        extended = extend_bars(new, bar_size, state)
        extended.write.mode("overwrite").parquet(f"{folder}/extended/epoch={epoch}")
        extended = spark.read.schema(extended.schema).parquet(f"{folder}/extended/epoch={epoch}")
        bar_state(extended, state).write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")
        ends = new.select("instrument", "ts", "seq").unionByName(marks).groupBy("instrument").agg(F.max(F.struct("ts", "seq")).alias("x"))
        ends.select("instrument", "x.*").write.mode("overwrite").parquet(f"{folder}/marks/epoch={epoch}")
        table.merge(strictly_increasing(extended.where("closed").drop("closed"), state), epoch)

    trades.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read()


def run_to_table(stream: DataFrame, folder: str, spark: SparkSession) -> DataFrame:
    """Runs an append stream over all that is there and returns what it wrote."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _keyed_bars(trades: DataFrame, key: Column, name: str, folder: str, spark: SparkSession) -> DataFrame:
    """Bars by key of a stream. Each micro-batch writes its own part of every bar under its epoch, and an epoch
    that is repeated overwrites itself; the parts are put together when they are read, so the stream keeps no
    state, and late trades count whenever they come."""
    at = F.struct("ts", "seq")
    rows = trades.withColumn(name, key)

    def write(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy("instrument", name).agg(F.min(at).alias("first"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at).alias("last"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_trades"))
        part.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{folder}/out")
    return parts.groupBy("instrument", name).agg(F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume"), F.sum("n_trades").alias("n_trades"))


def session_bar_stream(trades: DataFrame, folder: str, spark: SparkSession) -> DataFrame:
    """Daily bars by session, labelled by the day of their end."""
    return _keyed_bars(trades, session_date(F.col("ts")), "session_date", folder, spark)


def h4_bar_stream(trades: DataFrame, folder: str, spark: SparkSession) -> DataFrame:
    """Four-hour bars on New York boundaries, labelled by their local start."""
    return _keyed_bars(trades, h4_start(F.col("ts")), "bar_start", folder, spark)


def with_refreshed(stream: DataFrame, meta: str, keys: list[str], folder: str, spark: SparkSession) -> DataFrame:
    """The stream's rows joined with a table (path meta) that every micro-batch reads anew, so that changes of
    regime, scale or learned parameters reach later rows; written by epoch, a repeated epoch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.join(spark.read.parquet(meta), keys, "left").write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("epoch")
