"""Feeds and run persistence: dated CSV files, candle JSON, yield CSV, path tables, runs under one id."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDLES = "instrument string, candles array<struct<complete: boolean, time: timestamp_ntz, volume: long, mid: struct<o: string, h: string, l: string, c: string>>>"


def dated_files(spark: SparkSession, folder: str, schema: str, first: str, last: str) -> DataFrame:
    """Rows of the CSV files (any codec that Spark knows by extension) below folder whose path has a day as
    eight digits between first and last (yyyy-MM-dd), with the day; other files are not opened."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("header", True).csv(folder)
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{8})[^\d][^/]*(?:/[^/]*)?$", 1), "yyyyMMdd")
    return rows.select("*", day.alias("day")).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def candles(lines: DataFrame) -> DataFrame:
    """Complete candles of JSON texts (column value), one row each: instrument, ts, open, high, low, close, volume.
    Prices may be
    numbers or texts. Texts that aren't such JSON give nothing."""
    parsed = lines.select(F.from_json("value", CANDLES).alias("j")).select("j.instrument", F.explode("j.candles").alias("c")).where("c.complete")
    return parsed.select("instrument", F.col("c.time").alias("ts"), *[F.expr(f"try_cast(c.mid.{n[0]} AS double)").alias(n) for n in ("open", "high", "low", "close")], F.col("c.volume").alias("volume"))


def yields(spark: SparkSession, folder: str) -> DataFrame:
    """(date, value) of a CSV feed; values that aren't numbers are dropped."""
    rows = spark.read.schema("date string, value string").option("header", True).csv(folder)
    return rows.select(F.expr("try_cast(date AS date)").alias("date"), F.expr("try_cast(value AS double)").alias("value")).dropna()


def sampled_paths(vectors: DataFrame, per_origin: int = 20) -> DataFrame:
    """(origin, path, step, close): every vector is a sampled path of closes around 100."""
    steps = vectors.select(F.col("vec_id").alias("path"), F.posexplode("embedding").alias("step", "x"))
    return steps.select((F.col("path") / per_origin).cast("long").alias("origin"), "path", "step", (100 * F.exp(F.col("x").cast("double") / 10)).alias("close"))


def append_run(rows: DataFrame, folder: str, table: str, run_id: str) -> None:
    """Adds rows to a table under a run; a repeated run id replaces its own partition and no other."""
    (rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/{table}"))


def persist_run(tables: dict[str, DataFrame], folder: str, run_id: str, config: dict, source: str | None = None) -> None:
    """All tables of a run under one id; then, as the last write, its row in ``runs``: config as JSON and a
    SHA-256 over the sorted digests of the source's files."""
    for name, rows in sorted(tables.items()):
        append_run(rows, folder, name, run_id)
    spark = next(iter(tables.values())).sparkSession
    run = spark.range(1).select(F.lit(json.dumps(config, sort_keys=True)).alias("config"))
    if source is not None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select(F.sha2("content", 256).alias("d"))
        run = run.join(files.agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("d"))), 256).alias("source_sha256")), F.lit(True))
    append_run(run, folder, "runs", run_id)


def read_run(spark: SparkSession, folder: str, table: str, run_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{table}")
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)
