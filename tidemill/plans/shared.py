"""What queries share: DuckDB SQL for the canonical inputs, and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAPE = r"""
tape AS (
  SELECT event_type AS instrument, ts, event_id AS seq, value AS price,
         regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT + 1 AS size,
         CASE event_type WHEN 'click' THEN 'B' WHEN 'view' THEN 'A' ELSE 'N' END AS side,
         event_type || '_' || (user_id % 4)::VARCHAR AS symbol, user_id
  FROM events),
good AS (SELECT * FROM tape WHERE price > 0 AND size > 0)"""

OHLCV = """first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS close, sum(size)::BIGINT AS volume, count(*)::BIGINT AS n_trades"""

BARS = """
priced AS (
  SELECT l_returnflag AS instrument, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM lineitem),
bars AS (
  SELECT instrument, ts, first(price ORDER BY k) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY k) AS close, sum(size)::BIGINT AS volume, count(*)::BIGINT AS n_trades
  FROM priced GROUP BY instrument, ts)"""

RETURNS = (
    BARS
    + """,
rets AS (
  SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY instrument ORDER BY ts)) AS ret FROM bars)"""
)


def rounded(df: DataFrame, digits: int = 6, *keep: str) -> DataFrame:
    """df with its double columns rounded, for comparison with another engine's sums."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def dated(df: DataFrame) -> DataFrame:
    """df with its dates as text."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])
