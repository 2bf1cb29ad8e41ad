"""Queries over what is known at each origin: edges, structures, and the export of an origin's features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ladder as lad
from ..operators import prep, trailing
from ..sources.tables import shared_folder
from .p_ladder import ARC, GATE, LV, SIGN_P, gated, series, stored_arc
from .p_more import T_LIMIT
from .p_prep import returns
from .shared import rounded

STEPS = 4


def step_arc(spark, sf_dir, steps=STEPS):
    """The archive of the naive and the autoregressive rung by step, written once."""
    folder, rows = shared_folder(spark, "archive"), trailing.archive_by_step(series(spark, sf_dir), steps)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def structures(spark, sf_dir):
    return trailing.trailing_structure(series(spark, sf_dir), stored_arc(spark, sf_dir))


def next_scale(spark, sf_dir):
    """(instrument, origin, ts, sigma): the scale that holds for the return after each origin."""
    scale = prep.condition(returns(spark, sf_dir)).select("instrument", "ts", F.col("sigma_next").alias("sigma"))
    return series(spark, sf_dir).select("instrument", "ts", F.col("n").alias("origin")).join(scale, ["instrument", "ts"])


def j2_ar_steps(spark, sf_dir):
    rows = trailing.ar_by_step(series(spark, sf_dir), horizon=STEPS)
    return rounded(rows.select("instrument", "origin", "step", "y", "mean", F.element_at("q", 9).alias("q99")), 6)


def k11_trailing_edge(spark, sf_dir):
    return trailing.trailing_edge(step_arc(spark, sf_dir), STEPS)


def v4_gate_by_step(spark, sf_dir):
    """Per step the forecasts that the gate finds beyond the edge known at their origin, and how many there are."""
    arc = step_arc(spark, sf_dir)
    edge, out = trailing.trailing_edge(arc, STEPS), None
    for step in range(1, STEPS + 1):
        rows = lad.gate(arc, step=step, edge=edge)
        part = rows.groupBy("instrument", "step").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("reasons", "beyond_edge")).alias("beyond"))
        out = part if out is None else out.unionByName(part)
    return out


def k10_trailing_structure(spark, sf_dir):
    return structures(spark, sf_dir)


def v6_feature_export(spark, sf_dir):
    """Per origin: the scale of its next return, the structure known then, the gate and its reasons, what came, and
    the median and spread of every model, side by side."""
    arc = stored_arc(spark, sf_dir)
    each = arc.select("instrument", "origin", "model", F.element_at("q", 5).alias("p50"), (F.element_at("q", 7) - F.element_at("q", 3)).alias("spread"))
    wide = each.groupBy("instrument", "origin").pivot("model", ["ar", "garch"]).agg(F.first("p50").alias("p50"), F.first("spread").alias("spread"))
    judged = gated(spark, sf_dir).select("instrument", "origin", "y", F.array_join("reasons", "|").alias("reasons"), "gate")
    rows = wide.join(judged, ["instrument", "origin"]).join(next_scale(spark, sf_dir), ["instrument", "origin"])
    return rounded(trailing.verdict_at(rows, structures(spark, sf_dir), F.col("origin")).drop("ts"), 5)


QUERIES = {f.__name__: f for f in (j2_ar_steps, k11_trailing_edge, v4_gate_by_step, k10_trailing_structure, v6_feature_export)}

AHEAD = f", ah AS (SELECT p.instrument, p.n AS origin, h::INTEGER AS step, p.n + h AS target, e.ret AS y, (sy - phi * sx) / k * list_sum(list_transform(range(h), lambda j: pow(phi, j))) + pow(phi, h) * p.ret AS mean, sqrt(greatest((cyy - phi * cxy) / greatest(k - 2, 1), 1e-24)) * sqrt(list_sum(list_transform(range(h), lambda j: pow(phi, 2 * j)))) AS s FROM ap p, (SELECT unnest(range(1, {STEPS + 1})) AS h) hs JOIN ser e ON e.instrument = p.instrument AND e.n = p.n + h)"
EDGE = AHEAD + f", ask AS (SELECT instrument, origin, unnest(range(1, {STEPS + 1}))::INTEGER AS step FROM ah WHERE step = 1), told AS (SELECT instrument, step, target AS tt, (y - mean) * (y - mean) AS m, y * y AS b, NULL::INTEGER AS origin FROM ah UNION ALL SELECT instrument, step, origin, NULL, NULL, origin FROM ask), so AS (SELECT *, count(m) OVER w AS k, sum(m) OVER w AS sm, sum(b) OVER w AS sb FROM told WINDOW w AS (PARTITION BY instrument, step ORDER BY tt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), ed AS (SELECT instrument, origin, CASE WHEN bool_or(k >= 30) THEN coalesce(max(step) FILTER (WHERE k >= 30 AND sm < sb), 0) END AS edge FROM so WHERE origin IS NOT NULL GROUP BY 1, 2)"


def structure_sql(target: str, n: str, least: int) -> str:
    """CTEs after ARC up to st (instrument, cut, structure); target and n give the list of a row's cuts."""
    return f""", wl AS (SELECT instrument, max(n) AS lastn FROM ser GROUP BY 1),
wa AS (SELECT b.*, unnest({target}) AS cut FROM based b JOIN wl USING (instrument)),
wm AS (SELECT instrument, cut, model, count(*) AS n, 1 - sum((y - mean) * (y - mean)) / sum((y - base) * (y - base)) AS r2, avg((y - base) * (y - base) - (y - mean) * (y - mean)) AS m, var_pop((y - base) * (y - base) - (y - mean) * (y - mean)) AS g, count(*) FILTER (WHERE y <> 0) AS ns, count(*) FILTER (WHERE y <> 0 AND sign(y) = sign(mean)) AS ks FROM wa GROUP BY ALL),
wb AS (SELECT *, coalesce(r2 > 0 AND m > 0 AND m / sqrt(g / n) * sqrt((n - 1) / n) > {T_LIMIT}, false) AS beats, ks * 2 > ns AND {SIGN_P} < 0.05 AS signed FROM wm),
wf AS (SELECT instrument, cut, model, y, unnest(q) AS p, unnest({LV}) AS level FROM wa),
wp AS (SELECT instrument, cut, model, level, avg(greatest(level * (y - p), (level - 1) * (y - p))) AS loss FROM wf GROUP BY ALL),
wt AS (SELECT *, (lead(level) OVER w - level) * (lead(loss) OVER w + loss) / 2 AS piece FROM wp WINDOW w AS (PARTITION BY instrument, cut, model ORDER BY level)),
wc AS (SELECT instrument, cut, sum(piece) FILTER (WHERE model = 'garch') < sum(piece) FILTER (WHERE model = 'naive-rw') AS denser FROM wt GROUP BY ALL),
wr AS (SELECT s.instrument, n, ret, unnest({n}) AS cut FROM ser s JOIN wl USING (instrument)),
we AS (SELECT instrument, cut, n, ret - avg(ret) OVER w AS e, ret * ret - avg(ret * ret) OVER w AS f FROM wr WINDOW w AS (PARTITION BY instrument, cut)),
wh AS (SELECT instrument, cut, count(*) AS t, list(e ORDER BY n) AS e, list(f ORDER BY n) AS f FROM we GROUP BY ALL),
wq AS (SELECT instrument, cut, t * (t + 2) * list_sum(list_transform(range(1, 21), lambda k: pow(list_inner_product(e[:t - k], e[k + 1:]) / list_inner_product(e, e), 2) / (t - k))) AS qr, t * (t + 2) * list_sum(list_transform(range(1, 21), lambda k: pow(list_inner_product(f[:t - k], f[k + 1:]) / list_inner_product(f, f), 2) / (t - k))) AS qs FROM wh WHERE t > 20),
st AS (SELECT instrument, cut, CASE WHEN a.beats AND a.signed THEN 'linear' WHEN qr <= 31.410432844230918 AND qs > 37.56623478662507 AND denser THEN 'vol_only' WHEN a.beats THEN 'linear' ELSE 'efficient' END AS structure FROM wb a JOIN wc USING (instrument, cut) LEFT JOIN wq USING (instrument, cut) WHERE model = 'ar' AND n >= {least})"""


#: Cuts of every 125th row under windows of 500 rows.
STRUCTURES = structure_sql("range((target + 124) // 125 * 125, least(target + 500, lastn + 1), 125)", "range((n + 124) // 125 * 125, least(n + 500, lastn + 1), 125)", 100)
SCALE = ", sc AS (SELECT instrument, ts, CASE WHEN count(ret) OVER c >= 64 THEN stddev_samp(ret) OVER c END AS sigma FROM rets WINDOW c AS (PARTITION BY instrument ORDER BY ts ROWS BETWEEN 255 PRECEDING AND CURRENT ROW))"
SQL = {
    "j2_ar_steps": ARC + AHEAD + f" SELECT instrument, origin, step, round(y, 6) AS y, round(mean, 6) AS mean, round(mean + s * {lad.Z[8]!r}, 6) AS q99 FROM ah",
    "k11_trailing_edge": ARC + EDGE + " SELECT instrument, origin, edge FROM ed",
    "v4_gate_by_step": ARC + EDGE + " SELECT instrument, step, count(*) AS n, count(*) FILTER (WHERE edge IS NOT NULL AND step > greatest(edge, 1)) AS beyond FROM ah JOIN ed USING (instrument, origin) GROUP BY 1, 2",
    "k10_structure": ARC + structure_sql("[0]", "[0]", 0) + " SELECT instrument, structure FROM st",
    "k10_trailing_structure": ARC + STRUCTURES + " SELECT instrument, cut, structure FROM st",
    "v6_feature_export": ARC + GATE + STRUCTURES + SCALE + ", wd AS (SELECT instrument, origin, max(q[5]) FILTER (WHERE model = 'ar') AS ap, max(q[7] - q[3]) FILTER (WHERE model = 'ar') AS asp, max(q[5]) FILTER (WHERE model = 'garch') AS gp, max(q[7] - q[3]) FILTER (WHERE model = 'garch') AS gsp FROM arc GROUP BY 1, 2) SELECT instrument, origin, round(ap, 5) AS ar_p50, round(asp, 5) AS ar_spread, round(gp, 5) AS garch_p50, round(gsp, 5) AS garch_spread, round(y, 5) AS y, array_to_string(rs, '|') AS reasons, gate, round(sigma, 5) AS sigma, structure FROM wd JOIN states USING (instrument, origin) JOIN (SELECT instrument, n AS origin, ts FROM ser) USING (instrument, origin) JOIN sc USING (instrument, ts) LEFT JOIN st ON wd.instrument = st.instrument AND st.cut = wd.origin - wd.origin % 125",
}
