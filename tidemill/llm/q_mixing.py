"""op1: all documents mixed to the sources' target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from .mixing import plan_mix


def op1_mixing(spark, sf_dir):
    planned = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return planned.select("doc_id", *[F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken", "copies")])


#: Rows (doc_id, source, size, copies...) of a mix over {docs}; keep in step with plan_mix's defaults.
MIX_SQL = r"""
sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n,
         source IS NULL AS nul, coalesce(source, '') AS src
  FROM {docs}),
grouped AS (
  SELECT *, CASE WHEN n < 16 THEN n ELSE 8 * length(bin(n)) + (n >> (length(bin(n)) - 4)) - 8 END AS cls,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           % greatest(32, ((SELECT count(*) FROM sized) + 131071) // 131072) AS grp
  FROM sized),
sources AS (SELECT nul, src, sum(n)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1] AS w
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER ()
             - coalesce(sum(w) OVER (ORDER BY cap / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
  FROM weighed),
targets AS (
  SELECT nul, src, source_size, least(cap, w * max(lv) OVER ()) AS target,
         ('0x' || substr(md5('mix:' || CASE WHEN nul THEN '-' ELSE '+' END || src), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM levels),
ranked AS (
  SELECT g.*, source_size, target, u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY g.nul, g.src ORDER BY cls, grp, n, doc_id NULLS FIRST) AS rk
  FROM grouped g JOIN targets t ON g.nul = t.nul AND g.src = t.src),
mixed AS (
  SELECT *, least(floor(rk * rate + u) - floor((rk - 1) * rate + u), ceil(rate))::BIGINT AS copies
  FROM ranked)
"""

QUERIES = {"op1_mixing": op1_mixing}
SQL = {
    "op1_mixing": "WITH "
    + MIX_SQL.format(docs="documents")
    + "SELECT doc_id, n AS size, source_size, target, copies * n AS taken, copies FROM mixed"
}
