"""Keyed tables on Parquet: upserts, incremental pulls, deletes, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], *, order: str | None = None, keep_first: bool = False) -> DataFrame:
    """One row per key: the new one wins (keep_first: the existing one); within a side the last by order."""
    side = existing.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rank = F.struct((-F.col("_age") if keep_first else F.col("_age")), *([F.col(order)] if order else []))
    columns = [c for c in side.columns if c != "_age"]
    best = side.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in columns]), rank).alias("_row"))
    return best.select("_row.*")


def not_done(files: DataFrame, bars: DataFrame, key: str) -> DataFrame:
    """Input days without a complete bar yet."""
    return files.join(bars.select(key).distinct(), key, "left_anti")


def next_pull(rows: DataFrame, done: DataFrame, ts: str, end: Column, chunk_minutes: int = 30, *, now: Column | None = None, catch_up_minutes: int | None = None, behind_minutes: int = 120) -> DataFrame:
    """Rows after the last finished pull of their instrument and within one chunk of it. done: (instrument,
    ts_end, status); an instrument without a finished pull starts at its first row. With catch_up_minutes, an
    instrument that is more than behind_minutes behind now pulls a chunk of so many."""
    marks = done.where("status = 'ok'").groupBy("instrument").agg(F.max("ts_end").alias("_mark"))
    first = rows.groupBy("instrument").agg((F.min(ts) - F.expr("INTERVAL 1 MICROSECOND")).alias("_first"))
    at = first.join(marks, "instrument", "left").select("instrument", F.coalesce("_mark", "_first").alias("_mark"))
    minutes = F.lit(chunk_minutes)
    if catch_up_minutes is not None:
        late = F.col("_mark") + F.make_dt_interval(mins=F.lit(behind_minutes)) < (end if now is None else now)
        minutes = F.when(late, catch_up_minutes).otherwise(chunk_minutes)
    stop = F.least(end, F.col("_mark") + F.make_dt_interval(mins=minutes))
    return rows.join(at, "instrument").where((F.col(ts) > F.col("_mark")) & (F.col(ts) <= stop)).drop("_mark")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """rows without those that meet the condition; where it is null they stay."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def features_with_extra(features: DataFrame, core: list[str]) -> DataFrame:
    """The core columns, and all others as one JSON text."""
    rest = sorted(c for c in features.columns if c not in core)
    return features.select(*core, F.to_json(F.struct(*rest)).alias("extra"))


def dense(features: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """The named columns in order, 0.0 for those that are missing or null."""
    return features.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features.columns else F.lit(0.0).alias(c) for c in columns])
