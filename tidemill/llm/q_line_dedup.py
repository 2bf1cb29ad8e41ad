"""op3: boilerplate lines of many sites removed from all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch
from .line_dedup import dedup_lines


def op3_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs, Scratch(spark, "lines")).select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_removed").alias("n_removed"), F.md5(F.col("line_text").cast("binary")).alias("text_md5"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
SQL = {
    "op3_line_dedup": r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
cut AS (
  SELECT r, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM rows),
lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM cut),
boiler AS (
  SELECT t FROM lines WHERE t <> '' GROUP BY t
  HAVING count(DISTINCT CASE WHEN source IS NULL THEN '-' ELSE '+' || source END) >= 10),
marked AS (SELECT l.*, t <> '' AND t IN (SELECT t FROM boiler) AS gone FROM lines l),
joined AS (
  SELECT r, count(*) FILTER (WHERE t <> '') AS n, count(*) FILTER (WHERE gone) AS g,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY r)
SELECT doc_id, n::BIGINT AS n_lines, g::BIGINT AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE md5(kept) END AS text_md5
FROM rows JOIN joined USING (r)
"""
}
