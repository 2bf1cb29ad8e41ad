"""Cross-site boilerplate lines (DataFrame functions only).

A line that stands on many different sites is boilerplate. Lines are counted by hash first: a line with
fewer rows than ``min_sites`` can't be on so many sites. The others get a HyperLogLog sketch of their
sites, merged by aggregation; where the estimate is near the threshold, sites are counted exactly. The
lines found are taken out of every document that has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A sketch of 2**LOG_K bins has a relative error of about 1.04 / sqrt(2**LOG_K), 1.6 %; within NEAR of the
#: threshold (more than six errors) sites are counted exactly.
LOG_K = 12
NEAR = 0.1
NO_ID = -(1 << 63)


def line_hash(line):
    return F.xxhash64(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def _lines(text="text"):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _worded(line):
    return F.length(F.btrim(line, F.lit(" \t\r\x0b\x0c"))) > 0


def line_hashes(text="text"):
    """Distinct hashes of a text's lines, without blank ones."""
    return F.array_distinct(F.transform(F.filter(_lines(text), _worded), line_hash))


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """(row_key, site, line): each row's distinct line hashes; a null site is a site of its own."""
    place = F.when(F.col(site).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(site)))
    return docs.select(_row_key().alias("row_key"), place.alias("site"), F.explode(line_hashes()).alias("line"))


def _row_key():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))


def boilerplate(lines: DataFrame, scratch: Scratch, min_sites: int = 10) -> DataFrame:
    """(line, sites, exact): of lines (site, line), those that stand on min_sites sites or more."""
    often = scratch.save(lines.groupBy("line").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_sites).select("line"), "often")
    sketched = lines.join(often, "line").groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites"))
    sketched = scratch.save(sketched, "sketched")
    sure = sketched.where(F.col("sites") > min_sites * (1 + NEAR)).select("line", "sites", F.lit(False).alias("exact"))
    near = sketched.where(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("line")
    places = lines.join(near, "line").groupBy("line", "site").agg(F.count(F.lit(1)).alias("rows"))
    counted = places.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return scratch.save(sure.unionByName(counted.withColumn("exact", F.lit(True))), "boilerplate")


def dedup_lines(docs: DataFrame, scratch: Scratch, site: str = "source", min_sites: int = 10) -> DataFrame:
    """docs with line_text, line_count and line_removed: the text without boilerplate lines, the lines that
    have a word, and how many of them were removed.

    docs needs doc_id, text and the site column; result columns replace columns of the same name. Lines
    are compared without white space at their ends; blank lines are never removed. A null text stays
    null, with no lines; a null site is a site; an empty table gives an empty table. Rows of one doc_id
    lose what is boilerplate in each of them.
    """
    lines = scratch.save(lines_of(docs, site), "lines")
    found = boilerplate(lines, scratch, min_sites).select("line")
    hit = lines.join(found, "line").groupBy("row_key").agg(F.collect_set("line").alias("_line_hits"))  # a row's own lines
    hit = scratch.save(hit.withColumnRenamed("row_key", "_line_key"), "hits")
    kept = [c for c in docs.columns if c.lower() not in ("line_text", "line_count", "line_removed")]
    joined = docs.select(*[F.col(f"`{c}`") for c in kept], _row_key().alias("_line_key")).join(hit.hint("merge"), "_line_key", "left")
    none = F.array().cast("array<bigint>")
    removed = F.coalesce("_line_hits", none)
    left = F.filter(_lines(), lambda x: ~(_worded(x) & F.array_contains(removed, line_hash(x))))
    return joined.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(F.size(removed) == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("line_text"),
        F.size(F.filter(_lines(), _worded)).cast("long").alias("line_count"),
        (F.size(_lines()) - F.size(left)).cast("long").alias("line_removed"),
    )
