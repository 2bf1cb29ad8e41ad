"""op12: collocations of all documents by language."""

from __future__ import annotations

from .common import Scratch
from .phrases import collocations


def op12_collocations(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    return collocations(docs, Scratch(spark, "phrases")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op12_collocations": op12_collocations}
SQL = {
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3)) AS s(size)),
f AS (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k.k, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM candidates c JOIN (VALUES (1), (2)) AS k(k) ON k.k < c.size
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k.k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE size = 3)
  GROUP BY ALL),
ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank
  FROM lowest x LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * x.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
}
