"""Fitted rungs and tests against direct fits and simulated series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions.distributions import binomial_at_least, t_quantile
from tidemill.operators import fits, ladder, report


def simulate(kind: str, n: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    e = rng.standard_normal(n)
    if kind == "ar":
        x = np.zeros(n)
        for t in range(2, n):
            x[t] = 0.5 * x[t - 1] - 0.3 * x[t - 2] + e[t]
        return 0.01 * x
    if kind == "garch":
        h, x = 1.0, np.zeros(n)
        for t in range(n):
            x[t] = math.sqrt(h) * e[t]
            h = 0.05 + 0.15 * x[t] ** 2 + 0.8 * h
        return 0.01 * x
    if kind == "switch":
        return 0.01 * e * np.where(np.arange(n) // 300 % 2, 4.0, 1.0)
    return 0.01 * e


def frame(spark, **series):
    rows = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "instrument string, n int, ret double").withColumn("ts", F.timestamp_seconds("n").cast("timestamp_ntz"))


def direct_ar(x: np.ndarray, most: int = 5):
    best = None
    for p in range(1, most + 1):
        a = np.column_stack([np.ones(len(x) - p), *[x[p - k : len(x) - k] for k in range(1, p + 1)]])
        b = np.linalg.lstsq(a, x[p:], rcond=None)[0]
        s2 = float(np.mean((x[p:] - a @ b) ** 2))
        aic = (len(x) - p) * (math.log(2 * math.pi) + math.log(s2) + 1) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = aic, b, s2
    return best[1], best[2]


def test_ar_by_aic(spark):
    x = simulate("ar", 400)
    got = {(r.origin, r.step): r for r in fits.ar_by_aic(frame(spark, a=x, b=simulate("white", 330, 2)), horizon=3).where("instrument = 'a'").collect()}
    for origin in (251, 260, 272, 300, 396):
        refit = 251 + (origin - 251) // 21 * 21
        b, s2 = direct_ar(x[: refit + 1])
        path, psi = list(x[: origin + 1]), [1.0]
        for h in range(1, 4):
            path.append(b[0] + sum(b[k] * path[-k] for k in range(1, len(b))))
            r = got[origin, h]
            assert r.y == x[origin + h] and r.target == origin + h
            assert r.mean == pytest.approx(path[-1], abs=1e-10)
            sd = math.sqrt(s2 * sum(p * p for p in psi))
            assert r.q[8] - r.mean == pytest.approx(sd * ladder.Z[8], rel=1e-6)
            psi.append(sum(b[k] * psi[-k] for k in range(1, min(len(b) - 1, len(psi)) + 1)))
    assert len(got) == sum(400 - 252 + 1 - h for h in (1, 2, 3))


def test_garch(spark):
    x = simulate("garch", 1500)
    rows = fits.garch_fits(frame(spark, g=x, w=simulate("white", 600))).orderBy("instrument", "n").toPandas()
    last = rows[rows.instrument == "g"].iloc[-1]
    assert last.alpha + last.beta >= 0.9 and last.alpha in fits.ALPHAS and last.nu >= 8
    white = rows[rows.instrument == "w"].iloc[-1]
    assert white["var"] == pytest.approx(1e-4, rel=0.3)
    arc = fits.garch_t(frame(spark, g=x), horizon=2)
    inside = arc.where("step = 1").select(F.avg((F.col("y").between(F.col("q")[1], F.col("q")[7])).cast("double"))).first()[0]
    assert 0.85 < inside < 0.95


def test_t_quantiles():
    assert t_quantile(0.975, 5) == pytest.approx(2.570581835636314, abs=1e-9)
    assert t_quantile(0.01, 10) == pytest.approx(-2.763769458112696, abs=1e-9)
    assert t_quantile(0.5, 3) == 0 and binomial_at_least(0, 5) == 1.0
    assert binomial_at_least(489, 983) == pytest.approx(0.576, abs=2e-3)


def test_unit_roots(spark):
    walk = np.cumsum(simulate("white", 600, 5))
    got = {r.instrument: r.p for r in fits.adf(frame(spark, walk=walk, white=simulate("white", 600))).collect()}
    assert got["walk"] > 0.1 and got["white"] < 0.01
    share = {r.instrument: (r.n_windows, r.share) for r in fits.rolling_stationarity(frame(spark, walk=walk, white=simulate("white", 600))).collect()}
    assert share["white"] == (14, 1.0) and share["walk"][0] == 14 and share["walk"][1] < 0.5
    flat = np.mean([fits.adf_p(np.cumsum(np.random.default_rng(s).standard_normal(250))) < 0.05 for s in range(300)])
    assert flat < 0.1


def recursive_breaks(x, least=60, penalty=3.0):
    found = []

    def part(lo, hi):
        if hi - lo < 2 * least:
            return
        c = np.cumsum(x[lo:hi] ** 2)
        dev = np.abs(c / (c[-1] + 1e-12) - np.linspace(0, 1, hi - lo))
        k = int(np.argmax(dev))
        if dev[k] * math.sqrt(hi - lo) > penalty and least <= k <= hi - lo - least:
            found.append(lo + k)
            part(lo, lo + k)
            part(lo + k, hi)

    part(0, len(x))
    return sorted(found)


def test_breaks(spark):
    a, b = simulate("switch", 1500), simulate("white", 700)
    got = fits.structural_breaks(frame(spark, a=a, b=b)).collect()
    want = recursive_breaks(a)
    assert sorted(r.break_at for r in got if r.instrument == "a") == want and len(want) >= 3
    assert sorted(r.break_at for r in got if r.instrument == "b") == recursive_breaks(b)


def test_markov_regimes(spark):
    x = simulate("switch", 1500)
    got = fits.markov_regimes(frame(spark, a=x), states=2).toPandas().sort_values("n")
    assert got.n.tolist() == list(range(507, 1500)) and got.groupby("refit").size().max() == 30
    truth = got.n // 300 % 2
    assert (got.state == truth).mean() > 0.9
    assert got.confidence.between(0, 1).all()
    cut = fits.markov_regimes(frame(spark, a=x[:900]), states=2).toPandas().sort_values("n")
    merged = cut.merge(got, on=["n", "refit"])
    assert len(merged) == len(cut) and (merged.state_x == merged.state_y).all()


def test_structure_verdicts(spark):
    names = {"ar": simulate("ar", 900, 3), "white": simulate("white", 900, 4), "garch": simulate("garch", 2500, 6)}
    s = frame(spark, **names)
    arc = fits.walk_forward(s, horizon=1)
    got = {r.instrument: r.structure for r in report.classify(report.readings(arc), report.ljung_box_p(s)).collect()}
    assert got == {"ar": "linear", "white": "efficient", "garch": "vol_only"}


def test_walk_forward_is_causal(spark):
    x = simulate("ar", 420)
    cut = fits.walk_forward(frame(spark, a=x[:380]), horizon=2).toPandas()
    full = fits.walk_forward(frame(spark, a=x), horizon=2).toPandas()
    both = cut.merge(full, on=["model", "origin", "step"])
    assert len(both) == len(cut)
    assert np.allclose(both["mean_x"], both["mean_y"])
    assert np.allclose(np.stack(both.q_x), np.stack(both.q_y))
