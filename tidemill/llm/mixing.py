"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source expects ``target / source_size`` copies. Documents of a source stand in
one fixed order; the prefix sum of their expected copies plus one random offset crosses integer
boundaries, and a document is emitted once for each boundary in its own interval. The order goes by
size first, so that the words taken stay within about one document of the target.

The order is laid out in three levels (size class, hash group, row), so that the prefix sum of a hot
source is spread over many tasks: only counts of groups meet in a window over a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, without

COLUMNS = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]


def _class(size):
    """A size's class: 8 classes to each doubling, in the order of sizes."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(8 * bits + F.expr("shiftright(_mix_n, length(bin(_mix_n)) - 4)") - 8).cast("int")


def source_targets(sizes: DataFrame, weights, cap: float, share: float) -> DataFrame:
    """One row per source with its size, its target and its random offset's key.

    sizes: (_mix_null, _mix_src, source_size). Weights repeat in the sources' order. Targets fill like
    water: target = min(cap * size, weight * level). The level is the largest of the levels found when
    the sources with the smallest cap per weight are held at their cap.
    """
    order = Window.orderBy("_mix_null", "_mix_src")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.orderBy(F.col("_cap") / F.col("_w"), "_mix_null", "_mix_src")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    return (
        ranked.withColumn("_cap", F.col("source_size") * float(cap))
        .withColumn("_level", level)
        .withColumn("_top", F.max("_level").over(whole))
        .select("_mix_null", "_mix_src", "source_size", F.least("_cap", F.col("_w") * F.col("_top")).alias("target"))
    )


def plan_mix(docs: DataFrame, *, weights=(5, 2, 1), cap: float = 3.0, share: float = 1.0, seed: str = "mix", group_rows: int = 1 << 17) -> DataFrame:
    """docs with ``mix_size, mix_source_size, mix_target, mix_copies, mix_taken``.

    docs needs text, source and doc_id; other columns pass through (one named like a result column is
    replaced; names that start with _mix_ are taken). A null text has size 0, a null source is a source
    of its own, after all others; rows with the same doc_id, and null ids, are rows like any other.
    A source without words gets target 0 and no copies. An empty table gives an empty table.
    """
    groups = max(32, -(-docs.count() // group_rows))
    rows = (
        without(docs, COLUMNS)
        .withColumn("_mix_n", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("_mix_null", F.col("source").isNull())
        .withColumn("_mix_src", F.coalesce("source", F.lit("")))
        .withColumn("_mix_class", _class(F.col("_mix_n")))
        .withColumn("_mix_group", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % groups)
        .withColumn("_mix_tie", F.xxhash64("text"))
    )
    key = ["_mix_null", "_mix_src", "_mix_class", "_mix_group"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum("_mix_n").alias("_words"))
    classes = counts.groupBy(*key[:3]).agg(F.sum("_n").alias("_n"))
    below = classes.withColumn("_below", F.coalesce(F.sum("_n").over(Window.partitionBy(*key[:2]).orderBy("_mix_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    targets = source_targets(counts.groupBy(*key[:2]).agg(F.sum("_words").alias("source_size")), weights, cap, share)
    inside = Window.partitionBy(*key[:3]).orderBy("_mix_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(below, key[:3])
        .join(targets, key[:2])
        .select(*key, (F.col("_first") + F.col("_below")).alias("_mix_first"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    )
    rank = F.col("_mix_first") + F.row_number().over(Window.partitionBy(*key).orderBy("_mix_n", F.col("doc_id").asc_nulls_first(), "_mix_tie"))
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.when(F.col("_mix_null"), F.lit("-")).otherwise(F.lit("+")), F.col("_mix_src")).cast("binary"))
    offset = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("_mix_rank") * F.col("_mix_rate") + F.col("_mix_u")) - F.floor((F.col("_mix_rank") - 1) * F.col("_mix_rate") + F.col("_mix_u"))
    out = (
        rows.join(starts, key)
        .withColumn("_mix_rank", rank)
        .withColumn("_mix_rate", rate)
        .withColumn("_mix_u", offset)
        .withColumn("mix_copies", F.least(crossed, F.ceil("_mix_rate")).cast("long"))
        .withColumn("mix_taken", F.col("mix_copies") * F.col("_mix_n"))
        .withColumnRenamed("_mix_n", "mix_size")
    )
    return out.select(*[F.col(f"`{c}`") for c in without(docs, COLUMNS).columns], *COLUMNS)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as many times as ``plan_mix`` emits it, with the columns of docs."""
    planned = plan_mix(docs, **how).where(F.col("mix_copies") > 0)
    repeated = planned.withColumn("_mix_copy", F.explode(F.expr("sequence(1L, mix_copies)")))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
