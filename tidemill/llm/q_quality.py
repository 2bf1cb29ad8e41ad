"""op9: quality rules with host verdicts over all documents."""

from __future__ import annotations

from .common import Scratch
from .quality import METRICS, quality


def op9_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality(docs, Scratch(spark, "quality")).select("doc_id", *METRICS, "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {
    "op9_quality_rules": r"""
WITH worded AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
rows AS (SELECT row_number() OVER () AS r, * FROM worded),
grams AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM rows WHERE len(w) >= 3),
keyed AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
twice AS (SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, count(DISTINCT p)::BIGINT AS c
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows),
dups AS (
  SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS d
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
  SELECT rows.doc_id, rows.source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM rows LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM based GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
strength AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM prior),
verdicts AS (SELECT source, (f + m * k) / (n + k) <= 0.5 AS host_kept FROM hosts, strength)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept
FROM based b JOIN verdicts v ON b.source IS NOT DISTINCT FROM v.source
"""
}
