"""Walk-forward splits, forecast rungs and scores over the forecast archive.

The archive has one row for each instrument, model, origin and step: (instrument, model, origin, step,
target, y, mean, q) with q the nine quantiles in the order of LEVELS. Rungs are window expressions over the
returns, so every origin of every instrument is forecast in one plan; each value uses rows up to its
origin only.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import binomial_p
from .indicators import with_ewms

LEVELS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
Z = tuple(NormalDist().inv_cdf(x) for x in LEVELS)

def by_n():
    return Window.partitionBy("instrument").orderBy("n")


def numbered(returns: DataFrame) -> DataFrame:
    """(instrument, ts, n, ret): returns numbered from 0."""
    rows = returns.where(F.col("ret").isNotNull())
    return rows.select("instrument", "ts", (F.row_number().over(Window.partitionBy("instrument").orderBy("ts")) - 1).alias("n"), "ret")


def splits(series: DataFrame, *, horizon: int = 1, min_train: int = 252, step: int = 1, embargo: int = 0, window: int | None = None, refit_every: int = 21) -> DataFrame:
    """Half-open train and test ranges for every origin, and the origin whose fit it uses."""
    length = series.groupBy("instrument").agg(F.count(F.lit(1)).cast("int").alias("len"))
    first = min_train - 1 + embargo
    origins = length.where(F.col("len") > first + horizon).withColumn("origin", F.explode(F.sequence(F.lit(first), F.col("len") - 1 - horizon, F.lit(step))))
    stop = F.col("origin") + 1 - embargo
    start = F.lit(0) if window is None else F.greatest(F.lit(0), stop - window)
    fold = ((F.col("origin") - first) / step).cast("int")
    return origins.select("instrument", "origin", start.alias("train_start"), stop.alias("train_stop"), (F.col("origin") + 1).alias("test_start"), (F.col("origin") + 1 + horizon).alias("test_stop"), (first + step * (fold - fold % refit_every)).cast("int").alias("refit_origin")).where(F.col("train_stop") - F.col("train_start") >= min_train)


def gaussian(mean: Column, sigma: Column) -> Column:
    """The quantile grid of a normal law."""
    return F.array(*[mean + sigma * F.lit(z) for z in Z])


def monotone(q: Column) -> Column:
    """Quantiles that don't cross."""
    return F.array_sort(q)


def _archive(rows: DataFrame, model: str, mean: Column, q: Column, min_train: int) -> DataFrame:
    found = rows.select("instrument", F.lit(model).alias("model"), F.col("n").alias("origin"), F.lit(1).alias("step"), (F.col("n") + 1).alias("target"), F.lead("ret").over(by_n()).alias("y"), mean.alias("mean"), q.alias("q"))
    return found.where((F.col("origin") >= min_train - 1) & F.col("y").isNotNull()).withColumn("q", monotone(F.col("q")))


def trailing_quantiles(series: DataFrame, tail: int = 250) -> DataFrame:
    """series with _q: the levels' quantiles of the last ``tail`` returns, by linear interpolation."""
    rows = series.withColumn("_x", F.sort_array(F.collect_list("ret").over(by_n().rowsBetween(-tail + 1, 0))))

    def at(level: float) -> Column:
        place = (F.size("_x") - 1) * F.lit(level)
        low = F.floor(place).cast("int")
        a, b = F.get("_x", low), F.get("_x", F.least(low + 1, F.size("_x") - 1))
        return a + (place - low) * (b - a)

    return rows.withColumn("_q", F.array(*[at(x) for x in LEVELS])).drop("_x")


def naive_rung(series: DataFrame, min_train: int = 252, tail: int = 250) -> DataFrame:
    """Mean 0; the last returns' quantiles around their median."""
    rows = trailing_quantiles(series, tail)
    return _archive(rows, "naive-rw", F.lit(0.0), F.transform("_q", lambda x: x - F.element_at("_q", 5)), min_train)


def ewma_rung(series: DataFrame, min_train: int = 252, lam: float = 0.94) -> DataFrame:
    """The volatility rung: the mean of all returns so far; variance from the unconditional one, moved by each
    squared deviation from that mean, which exponential means of the returns and their squares give."""
    so_far = by_n().rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumn("_mu", F.avg("ret").over(so_far)).withColumn("_v", F.var_samp("ret").over(so_far)).withColumn("_sq", F.col("ret") * F.col("ret"))
    rows = with_ewms(rows, {"_e1": "ret", "_e2": "_sq"}, 1 - lam, order="n", first=False)
    left = F.pow(F.lit(lam), (F.col("n") + 1).cast("double"))
    var = left * F.col("_v") + F.col("_e2") - 2 * F.col("_mu") * F.col("_e1") + (1 - left) * F.col("_mu") * F.col("_mu")
    return _archive(rows.withColumn("_s", F.sqrt(F.greatest(var, F.lit(1e-24)))), "garch", F.col("_mu"), gaussian(F.col("_mu"), F.col("_s")), min_train)


def ar_fits(series: DataFrame) -> DataFrame:
    """series with _c, _phi and _s: a first-order autoregression fitted at every row on all returns so far, from
    running sums of lag products, and the deviation of what it leaves."""
    so_far = by_n().rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumn("_x", F.lag("ret").over(by_n()))
    run = lambda c: F.sum(c).over(so_far)
    pair = F.col("_x").isNotNull()
    rows = rows.withColumns({"_n": run(pair.cast("int")), "_sx": run("_x"), "_sy": run(F.when(pair, F.col("ret"))), "_sxx": run(F.col("_x") * F.col("_x")), "_sxy": run(F.col("_x") * F.col("ret")), "_syy": run(F.when(pair, F.col("ret") * F.col("ret")))})
    sxx, sxy, syy = (F.col(f"_s{a}{b}") - F.col(f"_s{a}") * F.col(f"_s{b}") / F.col("_n") for a, b in ("xx", "xy", "yy"))
    rows = rows.withColumn("_phi", F.when(sxx > 0, sxy / sxx).otherwise(0.0)).withColumn("_c", (F.col("_sy") - F.col("_phi") * F.col("_sx")) / F.col("_n"))
    return rows.withColumn("_s", F.sqrt(F.greatest((syy - F.col("_phi") * sxy) / F.greatest(F.col("_n") - 2, F.lit(1)), F.lit(1e-24))))


def ar_rung(series: DataFrame, min_train: int = 252) -> DataFrame:
    """First-order autoregression (ar_fits), with Gaussian quantiles."""
    mean = F.col("_c") + F.col("_phi") * F.col("ret")
    return _archive(ar_fits(series), "ar", mean, gaussian(mean, F.col("_s")), min_train)


def archive(series: DataFrame, min_train: int = 252) -> DataFrame:
    return naive_rung(series, min_train).unionByName(ewma_rung(series, min_train)).unionByName(ar_rung(series, min_train))


KEY = ["instrument", "model", "step"]


def mase(arc: DataFrame, series: DataFrame, min_train: int = 252) -> DataFrame:
    """Mean absolute error over the naive scale: the mean step of the first train window."""
    step = F.abs(F.col("ret") - F.lag("ret").over(by_n()))
    scale = series.withColumn("_d", step).where(F.col("n") < min_train).groupBy("instrument").agg(F.greatest(F.avg("_d"), F.lit(1e-12)).alias("scale"))
    errors = arc.groupBy(*KEY).agg(F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mae"))
    return errors.join(scale, "instrument").select(*KEY, (F.col("mae") / F.col("scale")).alias("mase"))


def against_naive(arc: DataFrame) -> DataFrame:
    """arc with the naive mean of the same instrument, step and origin as base."""
    naive = arc.where("model = 'naive-rw'").select("instrument", "step", "origin", F.col("mean").alias("base"))
    return arc.join(naive, ["instrument", "step", "origin"])


def r2_oos(arc: DataFrame) -> DataFrame:
    sse = lambda c: F.sum((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
    return against_naive(arc).groupBy(*KEY).agg(F.when(sse("base") > 1e-24, 1 - sse("mean") / sse("base")).otherwise(0.0).alias("r2"))


def directions(arc: DataFrame) -> DataFrame:
    """Share of right signs where y isn't 0, and how many there are."""
    hit = F.when(F.col("y") != 0, (F.signum("y") == F.signum("mean")).cast("double"))
    return arc.groupBy(*KEY).agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count(hit).alias("n"))


def pinball(arc: DataFrame) -> DataFrame:
    """Mean pinball loss by level."""
    flat = arc.select(*KEY, "y", F.posexplode("q").alias("k", "p")).withColumn("level", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("k") + 1))
    d = F.col("y") - F.col("p")
    return flat.groupBy(*KEY, "level").agg(F.avg(F.greatest(F.col("level") * d, (F.col("level") - 1) * d)).alias("loss"))


def crps(losses: DataFrame) -> DataFrame:
    """Twice the trapezoid of the pinball losses over the levels."""
    w = Window.partitionBy(*KEY).orderBy("level")
    piece = (F.lead("level").over(w) - F.col("level")) * (F.lead("loss").over(w) + F.col("loss")) / 2
    return losses.withColumn("_p", piece).groupBy(*KEY).agg((2 * F.sum("_p")).alias("crps"))


def pit(arc: DataFrame) -> DataFrame:
    """arc with pit: y's place in the quantile grid, by linear interpolation."""
    lv = F.array(*[F.lit(x) for x in LEVELS])
    q, y = F.col("q"), F.col("y")
    first, last = F.element_at(q, 1), F.element_at(q, -1)
    low = F.when(first != 0, F.least(F.lit(LEVELS[0]) * (y / first), F.lit(LEVELS[0]))).otherwise(F.lit(LEVELS[0]))
    k = F.size(F.filter(q, lambda x: x <= y))  # quantiles at or under y
    a, b = F.element_at(q, k), F.element_at(q, k + 1)
    la, lb = F.element_at(lv, k), F.element_at(lv, k + 1)
    inner = la + (lb - la) * (y - a) / (b - a)
    value = F.when(y <= first, low).when(y >= last, F.lit(LEVELS[-1])).otherwise(inner)
    return arc.withColumn("pit", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def pit_chi2(arc: DataFrame, bins: int = 10) -> DataFrame:
    """Chi-square of the pit's ten bins; null with fewer than five for each bin."""
    cell = F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1))
    counts = pit(arc).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(cell == b).alias(f"_b{b}") for b in range(bins)])
    expected = F.col("n") / bins
    stat = sum((F.col(f"_b{b}") - expected) * (F.col(f"_b{b}") - expected) / expected for b in range(bins))
    return counts.select(*KEY, "n", F.when(F.col("n") >= bins * 5, stat).alias("chi2"))


def coverage(arc: DataFrame) -> DataFrame:
    """Share of y between the 5 % and 95 % quantiles."""
    return arc.groupBy(*KEY).agg(F.avg(F.col("y").between(F.element_at("q", 2), F.element_at("q", 8)).cast("double")).alias("coverage"))


def diebold_mariano(arc: DataFrame, horizon: int = 1) -> DataFrame:
    """Statistic of squared losses, naive against each model, with the small-sample correction; the long-run
    variance takes horizon - 1 lags with Bartlett weights; 0 with fewer than 8 rows."""
    w = Window.partitionBy(*KEY).orderBy("origin")
    loss = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    d = against_naive(arc).where("model != 'naive-rw'").select(*KEY, "origin", (loss("base") - loss("mean")).alias("d"))
    d = d.withColumn("e", F.col("d") - F.avg("d").over(Window.partitionBy(*KEY)))
    for k in range(1, horizon):
        d = d.withColumn(f"_l{k}", F.col("e") * F.lag("e", k).over(w))
    long_run = F.avg(F.col("e") * F.col("e")) + sum((2 * (1 - k / horizon) * F.avg(f"_l{k}") for k in range(1, horizon)), F.lit(0.0))
    found = d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"), long_run.alias("lrv"))
    fix = F.sqrt((F.col("n") + 1 - 2 * horizon + horizon * (horizon - 1) / F.col("n")) / F.col("n"))
    stat = F.when((F.col("n") >= 8) & (F.col("lrv") > 1e-24), F.col("mean_d") / F.sqrt(F.col("lrv") / F.col("n")) * fix).otherwise(0.0)
    return found.select(*KEY, "n", stat.alias("dm"))


def sign_replication(rows: DataFrame, floor: float = 0.05) -> DataFrame:
    """Per instrument the forecasts of at least floor deviations: how many, how many of the right sign, their
    share, and the mean gain in deviations. rows: (instrument, p50, y), both in deviations."""
    gain = F.signum("p50") * F.col("y")
    found = rows.where(F.abs("p50") >= floor).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if(gain > 0).alias("hits"), F.avg(gain).alias("gross"))
    return found.select("instrument", "n", "hits", (F.col("hits") / F.col("n")).alias("accuracy"), "gross")


def scorecard(arc: DataFrame, series: DataFrame) -> DataFrame:
    """All scores of a model on a row, with the deviation of the means over that of y (degenerate under .05)."""
    spread = arc.groupBy(*KEY).agg((F.stddev_pop("mean") / F.greatest(F.stddev_pop("y"), F.lit(1e-12))).alias("std_ratio"))
    out = spread
    for part in (mase(arc, series), r2_oos(arc), directions(arc), crps(pinball(arc)), pit_chi2(arc).drop("n"), coverage(arc)):
        out = out.join(part, KEY)
    return out.withColumn("degenerate", F.col("std_ratio") < 0.05)


def known_before(step: int, rows: int | None = None, *keys: str):
    """Frame over the forecasts whose targets lie before the origin of the current one: the last ``rows`` or all.
    Targets follow one another, so the last ones known are step + 1 rows back."""
    w = Window.partitionBy(*KEY, *keys).orderBy("target")
    return w.rangeBetween(Window.unboundedPreceding, -step - 1) if rows is None else w.rowsBetween(-rows - step, -step - 1)


def spread_ratio(w) -> Column:
    """Deviation of the means over that of y in a frame."""
    return F.stddev_pop("mean").over(w) / F.greatest(F.stddev_pop("y").over(w), F.lit(1e-12))


def realised_window(arc: DataFrame, rows: int = 120, step: int = 1) -> DataFrame:
    """For every origin, the count and deviation ratio of the last ``rows`` forecasts whose targets are known
    before it; null with fewer than 30."""
    w = known_before(step, rows)
    known = arc.where(F.col("step") == step).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", spread_ratio(w))
    return known.select(*KEY, "origin", F.col("_n").alias("n_realised"), F.when(F.col("_n") >= 30, F.col("_r")).alias("std_ratio"))


#: Chi-square of nine degrees of freedom that is passed in 5 % of cases. Fixed value.
PIT_LIMIT = 16.918977604620448


def with_chi2(rows: DataFrame, w, bins: int = 10) -> DataFrame:
    """rows with n_realised and chi2, the chi-square of the pit's bins in a frame (null below five a bin)."""
    cell = F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1))
    known = rows.withColumn("n_realised", F.count(F.lit(1)).over(w)).withColumns({f"_b{b}": F.count_if(cell == b).over(w) for b in range(bins)})
    each = F.col("n_realised") / bins
    stat = sum((F.col(f"_b{b}") - each) * (F.col(f"_b{b}") - each) / each for b in range(bins))
    return known.withColumn("chi2", F.when(F.col("n_realised") >= bins * 5, stat)).drop(*[f"_b{b}" for b in range(bins)])


def trailing_calibration(arc: DataFrame, rows: int = 120, step: int = 1, bins: int = 10) -> DataFrame:
    """For every origin, the chi-square of the pit's bins over the last ``rows`` forecasts known before it, and
    whether they are calibrated at 5 %; fewer than 50 don't count against it."""
    found = with_chi2(pit(arc.where(F.col("step") == step)), known_before(step, rows), bins).select(*KEY, "origin", "n_realised", "chi2")
    return found.withColumn("calibrated", F.coalesce(F.col("chi2") <= PIT_LIMIT, F.lit(True)))


def trailing_z(rows: int = 120) -> Column:
    """z of vol against the ``rows`` before it (more than 10)."""
    w = Window.partitionBy(*KEY).orderBy("origin").rowsBetween(-rows, -1)
    sd = F.stddev_pop("vol").over(w)
    return F.when((F.count("vol").over(w) > 10) & (sd > 0), (F.col("vol") - F.avg("vol").over(w)) / sd)


def vol_z(arc: DataFrame, rows: int = 120) -> DataFrame:
    """z of each forecast's predictive deviation against the ``rows`` before it (more than 10)."""
    std = (F.element_at("q", 7) - F.element_at("q", 3)) / 2
    return arc.select(*KEY, "origin", std.alias("vol")).withColumn("z", trailing_z(rows))


def signals(arc: DataFrame, model: str = "ar") -> DataFrame:
    """Direction tanh(mean / vol) of the signal model and conviction from how far the other means agree."""
    mine = arc.where(F.col("model") == model).select("instrument", "step", "origin", "y", "mean", ((F.element_at("q", 7) - F.element_at("q", 3)) / 2).alias("vol"))
    spread = arc.where("model != 'naive-rw'").groupBy("instrument", "step", "origin").agg(F.stddev_pop("mean").alias("sd"), F.count(F.lit(1)).alias("k"))
    joined = mine.join(spread, ["instrument", "step", "origin"])
    agree = F.when(F.col("k") < 2, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / F.greatest("vol", F.lit(1e-12)))))
    return joined.select("instrument", "step", "origin", "y", F.tanh(F.col("mean") / F.greatest("vol", F.lit(1e-12))).alias("direction"), agree.alias("conviction"), "vol")


HARD = ("degenerate", "miscalibrated", "bad_regime", "structural_break", "beyond_edge", "data_quality")


def distinct_reasons(reasons: Column) -> Column:
    """Each reason once, in the order of its first place."""
    return F.array_distinct(reasons)


def gate_state(reasons: Column) -> Column:
    """VETO with a hard reason, GO_REDUCED with a soft one, GO without any; the reasons stay distinct."""
    hard = F.array(*[F.lit(x) for x in HARD])
    return F.when(F.arrays_overlap(reasons, hard), "VETO").when(F.size(reasons) > 0, "GO_REDUCED").otherwise("GO")


def gate(arc: DataFrame, model: str = "ar", *, step: int = 1, flags: DataFrame | None = None, regimes: DataFrame | None = None, breaks: DataFrame | None = None, edge: DataFrame | None = None, lookback: int = 40) -> DataFrame:
    """signals with reasons and gate. All evidence comes from forecasts whose targets lie before the origin.

    Hard reasons: degenerate (means vary under .05 of the outcomes), miscalibrated (trailing pit), bad_regime (no
    skill so far in the origin's regime, from 30 forecasts on), structural_break (within ``lookback`` rows),
    beyond_edge (the step is over the edge horizon), data_quality (an anomaly at the origin). Soft ones:
    low_conviction (under .35), weak_direction (signs so far don't differ from chance at 10 %), high_vol (z over 1.5
    of the last 120). flags: (instrument, n) of anomalies; regimes: (instrument, n, regime); breaks: (instrument,
    break_at); edge: (instrument, edge), or edges known at each origin (instrument, origin, edge), where a null one
    is no reason. A part that isn't given adds no reason.
    """
    at = ["instrument", "origin"]
    told = known_before(step)
    sign = F.when(F.col("y") != 0, (F.signum("y") == F.signum("mean")).cast("int"))
    # All trailing evidence of the model in one pass over its forecasts.
    told_of = pit(mine_with(against_naive(arc), model, step)).withColumn("vol", (F.element_at("q", 7) - F.element_at("q", 3)) / 2)
    told_of = with_chi2(told_of, known_before(step, 120)).withColumns({
        "std_ratio": F.when(F.col("n_realised") >= 30, spread_ratio(known_before(step, 120))), "z": trailing_z(),
        "calibrated": F.coalesce(F.col("chi2") <= PIT_LIMIT, F.lit(True)), "n_sign": F.count(sign).over(told), "k_sign": F.sum(sign).over(told),
    })
    seen = ["n_realised", "std_ratio", "calibrated", "z", "n_sign", "k_sign"]
    reasons = [F.when(F.col("std_ratio") < 0.05, "degenerate"), F.when(~F.col("calibrated"), "miscalibrated")]
    if regimes is not None:
        told_of = told_of.join(regimes.select("instrument", F.col("n").alias("origin"), "regime"), at, "left")
        w = known_before(step, None, "regime")
        sse = lambda c: F.sum((F.col("y") - F.col(c)) * (F.col("y") - F.col(c))).over(w)
        weak = F.col("regime").isNotNull() & (F.count(F.lit(1)).over(w) >= 30) & (sse("mean") >= sse("base"))
        told_of, seen = told_of.withColumn("_weak", weak), [*seen, "regime", "_weak"]
        reasons.append(F.when(F.col("_weak"), "bad_regime"))
    rows = signals(arc, model).where(F.col("step") == step).join(told_of.select(*at, *seen), at)
    if breaks is not None:
        near = breaks.select("instrument", F.explode(F.sequence(F.col("break_at"), F.col("break_at") + lookback - 1)).alias("origin")).distinct().withColumn("_break", F.lit(True))
        rows = rows.join(near, at, "left")
        reasons.append(F.when(F.col("_break"), "structural_break"))
    if edge is not None:
        rows = rows.join(edge.select(*[c for c in at if c in edge.columns], "edge"), [c for c in at if c in edge.columns], "left")
        reasons.append(F.when(F.col("edge").isNotNull() & (F.lit(step) > F.greatest("edge", F.lit(1))), "beyond_edge"))
    if flags is not None:
        rows = rows.join(flags.select("instrument", F.col("n").alias("origin")).distinct().withColumn("_flag", F.lit(True)), at, "left")
        reasons.append(F.when(F.col("_flag"), "data_quality"))
    reasons += [
        F.when(F.col("conviction") < 0.35, "low_conviction"),
        F.when((F.col("n_sign") >= 30) & (binomial_p(F.col("k_sign"), F.col("n_sign")) > 0.1), "weak_direction"),
        F.when((F.col("n_realised") >= 120) & (F.col("z") > 1.5), "high_vol"),
    ]
    found = rows.withColumn("reasons", distinct_reasons(F.array_compact(F.array(*reasons))))
    return found.withColumn("gate", gate_state(F.col("reasons"))).drop("_weak", "_break", "_flag", "edge", "n_sign", "k_sign")


def mine_with(rows: DataFrame, model: str, step: int) -> DataFrame:
    return rows.where((F.col("model") == model) & (F.col("step") == step))


def validate_gate(gated: DataFrame) -> DataFrame:
    """Sharpe of the ungated and gated positions, gate mix, veto precision and recall."""
    raw = F.col("direction") * F.col("conviction")
    g = F.when(F.col("gate") == "VETO", 0.0).when(F.col("gate") == "GO_REDUCED", 0.5 * raw).otherwise(raw)
    rows = gated.withColumn("u", raw * F.col("y")).withColumn("g", g * F.col("y"))
    veto, lost = F.col("gate") == "VETO", (raw != 0) & (F.col("y") != 0) & (F.signum(raw) != F.signum("y"))
    sharpe = lambda c: F.when(F.stddev_pop(c) > 0, F.avg(c) / F.stddev_pop(c) * F.sqrt(F.lit(252.0))).otherwise(0.0)
    ratio = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b)).otherwise(0.0)
    return rows.groupBy("instrument").agg(
        F.avg(veto.cast("double")).alias("veto_rate"), F.avg((F.col("gate") == "GO_REDUCED").cast("double")).alias("reduced_rate"),
        F.avg((F.col("gate") == "GO").cast("double")).alias("go_rate"), sharpe("u").alias("sharpe_ungated"), sharpe("g").alias("sharpe_gated"),
        ratio(raw * F.col("y") < 0, veto).alias("veto_precision"), ratio(veto, lost).alias("veto_recall"),
    )
