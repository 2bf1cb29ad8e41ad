"""Queries over the feature vector, the meta-model's importance and its purged cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characterize as ch
from ..operators import decisions as dec
from ..operators import features as feat
from ..operators import fits, meta, micro, trailing
from ..operators import indicators as ind
from ..operators import sessions as ses
from ..operators.book import book_of
from ..operators.macro import spread_changes
from ..sources.tables import bars_once, daily_bars, line_changes, line_tape, macro, shared_folder
from .p_decisions import COMPOSITE, decided, l4_confirmations, votes
from .p_ladder import ARC, TRAILING, series, stored_arc
from .p_prep import SQL as PREP_SQL
from .p_sessions import SQL as SESSION_SQL
from .p_sessions import events_calendar
from .p_trailing import SCALE, STRUCTURES, next_scale
from .shared import rounded


def known_parts(spark, sf_dir):
    """The bars, and the parts of the vector that come from bars, yields, calendar events, the stored forecasts, the
    structure known then, the book and the buckets of the bars' instruments, and the vote of all signals."""
    bars = daily_bars(spark, sf_dir)
    changes = rounded(spread_changes(macro(spark, sf_dir)), 9)
    reversal = ses.event_reversal(bars, events_calendar(spark, sf_dir))
    arc = stored_arc(spark, sf_dir)
    mine = arc.where("model = 'ar'").select("instrument", "origin", F.element_at("q", 5).alias("p50"), (F.element_at("q", 7) - F.element_at("q", 3)).alias("spread"))
    scaled = mine.join(next_scale(spark, sf_dir), ["instrument", "origin"]).withColumns({c: F.col(c) / F.col("sigma") for c in ("p50", "spread")})
    judged = trailing.verdict_at(scaled, trailing.trailing_structure(series(spark, sf_dir), arc), F.col("origin"))
    ends = bars.select("instrument", "ts", F.lit(2).cast("long").alias("seq"))  # after a day's messages
    vote = dec.composite(votes(spark, sf_dir), l4_confirmations(spark, sf_dir))
    return bars, [
        feat.technical_part(ind.technical(bars)), feat.macro_part(bars, changes), feat.reversal_part(reversal), feat.forecast_part(judged), feat.signal_part(vote),
        feat.book_part(book_of(line_changes(spark, sf_dir), ends)), feat.bucket_part(bars, micro.vpin_buckets(line_tape(spark, sf_dir), 1000)),
    ]


def l6_feature_vector(spark, sf_dir):
    """The vector of every day; its regime is calm (0) or turbulent (2) by the volatility up to it."""
    with bars_once(spark, sf_dir):
        bars, parts = known_parts(spark, sf_dir)
        states = ch.trailing_regimes(series(spark, sf_dir)).select("instrument", "ts", F.when(F.col("regime") == "calm", 0).otherwise(2).alias("state"))
        return rounded(feat.feature_vector(bars, *parts, feat.regime_part(states)), 6)


def l19_historical_features(spark, sf_dir):
    """The vector of every day from the sixtieth on, with the regimes of the Markov chain."""
    with bars_once(spark, sf_dir):
        bars, parts = known_parts(spark, sf_dir)
        rows = series(spark, sf_dir)
        states = fits.markov_regimes(rows, every=120).select("instrument", "n", "state").join(rows.select("instrument", "n", "ts"), ["instrument", "n"])
        return rounded(feat.feature_vector(bars, *parts, feat.regime_part(states), least_bars=60), 6)


def labelled(spark, sf_dir):
    """The labelled rows, written once and read back: a fit reads them many times, and the lines behind them are
    aggregated only once."""
    folder = shared_folder(spark, "labelled")
    with bars_once(spark, sf_dir):
        rows = meta.training_rows(decided(spark, sf_dir), daily_bars(spark, sf_dir))
        rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def l11_feature_importance(spark, sf_dir):
    return rounded(meta.importance(meta.fit_meta(labelled(spark, sf_dir)), spark), 6)


def f4_top_features(spark, sf_dir):
    return rounded(meta.importance(meta.fit_meta(labelled(spark, sf_dir)), spark, top=5), 6)


def l12_cross_validation(spark, sf_dir):
    rows = meta.with_next_return(labelled(spark, sf_dir), daily_bars(spark, sf_dir))
    return rounded(meta.cpcv_report(meta.cpcv_returns(rows, trees=20)), 6)


QUERIES = {f.__name__: f for f in (l6_feature_vector, l19_historical_features, l11_feature_importance, f4_top_features, l12_cross_validation)}
BOOKS = "ob AS (SELECT DISTINCT l_returnflag AS instrument, o_orderdate AS since, l_shipdate AS until, l_linestatus = 'O' AS bid, floor(l_extendedprice / l_quantity / 5000) * 5000 AS price, l_quantity AS size, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < l_shipdate), bl AS (SELECT b.instrument, b.ts, bid, price, sum(size) AS size FROM bars b JOIN ob ON b.instrument = ob.instrument AND since <= b.ts AND b.ts < until GROUP BY ALL), bs AS (SELECT instrument, ts, arg_max(size, price) FILTER (WHERE bid) AS b, arg_min(size, price) FILTER (WHERE NOT bid) AS a FROM bl GROUP BY 1, 2), bk AS (SELECT instrument, ts, (b - a) / (b + a) AS imbalance FROM bs)"
BUCKETS = "vc AS (SELECT l_returnflag AS instrument, l_shipdate AS ts, l_linestatus, l_quantity::BIGINT AS size, sum(l_quantity::BIGINT) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus, l_quantity ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM lineitem), vx AS (SELECT *, unnest(generate_series((cum - size) // 1000, (cum - 1) // 1000)) AS bucket FROM vc), vp AS (SELECT *, least(cum, (bucket + 1) * 1000) - greatest(cum - size, bucket * 1000) AS part FROM vx), vb AS (SELECT instrument, bucket, abs(sum(CASE l_linestatus WHEN 'O' THEN part ELSE -part END)) / sum(part) AS share, max(ts) AS close_ts FROM vp GROUP BY 1, 2 HAVING sum(part) = 1000), vw AS (SELECT *, avg(share) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS vpin FROM vb), vk AS (SELECT instrument, close_ts, arg_max(vpin, bucket) AS vpin FROM vw GROUP BY 1, 2)"
SQL = {
    "l6_feature_vector": ARC + STRUCTURES + SCALE + TRAILING + ", " + BOOKS + ", " + BUCKETS + ", t AS (" + PREP_SQL["e12_technical_rows"] + "), o AS (SELECT instrument, ts, sign(close - open)::DOUBLE AS turn FROM bars), yc AS (SELECT date, spread_bps, coalesce(spread_d5, us_d5, 0) AS c5, coalesce(spread_d20, us_d20, 0) AS c20 FROM (" + PREP_SQL["e13_yield_changes"] + ")), rev AS (" + SESSION_SQL["l3_event_reversal"] + "), cg AS (" + COMPOSITE + " SELECT * FROM cp)"
    """
, fo AS (SELECT a.instrument, s.ts, q[5] / sigma AS p50, (q[7] - q[3]) / sigma AS spread, sigma, CASE structure WHEN 'efficient' THEN 0 WHEN 'linear' THEN 1 WHEN 'vol_only' THEN 2 WHEN 'nonlinear' THEN 3 END AS code FROM ar a JOIN ser s ON a.instrument = s.instrument AND a.origin = s.n JOIN sc ON sc.instrument = s.instrument AND sc.ts = s.ts LEFT JOIN st ON st.instrument = a.instrument AND st.cut = a.origin - a.origin % 125)
, rs AS (SELECT vr.instrument, s.ts, CASE regime WHEN 'calm' THEN 0 ELSE 2 END AS state FROM vr JOIN ser s ON vr.instrument = s.instrument AND vr.n = s.n)
, ru AS (SELECT *, sum(coalesce((state <> was)::INT, 1)) OVER (PARTITION BY instrument ORDER BY ts) AS run FROM (SELECT *, lag(state) OVER (PARTITION BY instrument ORDER BY ts) AS was FROM rs))
, rd AS (SELECT instrument, ts, state, row_number() OVER (PARTITION BY instrument, run ORDER BY ts) AS days FROM ru)
SELECT t.instrument, t.ts, coalesce(rd.state, 1)::DOUBLE AS regime_state, coalesce(rd.days, 1)::DOUBLE AS days_in_regime,
       round(coalesce(y.spread_bps, 0), 6) AS yield_spread_bps, round(coalesce(c5, 0), 6) AS yield_spread_change_5d, round(coalesce(c20, 0), 6) AS yield_spread_change_20d,
       round(coalesce(f.p50, 0), 6) AS forecast_p50_scaled, round(coalesce(f.spread, 0), 6) AS forecast_uncertainty, round(coalesce(f.sigma, 0), 6) AS forecast_context_vol, coalesce(f.code, -1)::DOUBLE AS structure_code,
       round(coalesce(bk.imbalance, 0), 6) AS book_imbalance, round(coalesce(v.vpin, 0), 6) AS vpin,
       coalesce(t.atr, 0) AS atr_14, coalesce(t.rsi, 50) AS rsi_14, coalesce(t.vs_ma50, 0) AS price_vs_ma50, coalesce(t.vs_ma200, 0) AS price_vs_ma200, o.turn AS body_direction, coalesce(t.body_pct, 0.5) AS body_pct_of_range,
       (CASE e.direction WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END)::DOUBLE AS event_reversal, coalesce(e.strength, 0)::DOUBLE AS event_strength,
       (isodow(t.ts) - 1)::DOUBLE AS day_of_week, (isodow(t.ts) = 5)::INTEGER::DOUBLE AS is_friday,
       (CASE g.direction WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END)::DOUBLE AS signal_direction, coalesce(g.signal_count, 0)::DOUBLE AS signal_count, coalesce(g.strength, 0)::DOUBLE AS signal_strength, coalesce(g.tier2_count, 0)::DOUBLE AS confirmation_count
FROM t JOIN o ON t.instrument = o.instrument AND t.ts = o.ts ASOF LEFT JOIN yc y ON t.ts >= y.date ASOF LEFT JOIN vk v ON t.instrument = v.instrument AND t.ts >= v.close_ts
LEFT JOIN rev e ON t.instrument = e.instrument AND t.ts = e.ts LEFT JOIN cg g ON t.instrument = g.instrument AND t.ts = g.ts LEFT JOIN fo f ON t.instrument = f.instrument AND t.ts = f.ts LEFT JOIN bk ON t.instrument = bk.instrument AND t.ts = bk.ts LEFT JOIN rd ON t.instrument = rd.instrument AND t.ts = rd.ts""",
}
