"""Fitted rungs and tests: autoregression by AIC, GARCH with Student tails, Markov regimes, unit roots, breaks.

Fits are independent by instrument and refit origin or window, so Spark deals them out by key and numpy fits
one bounded sample in a task. Autoregressions need only running sums of lag products, which are windows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import t_quantile
from ..sources.tables import shared_folder
from .ladder import LEVELS, Z, by_n, trailing_quantiles

ARCHIVE = ["instrument", "model", "origin", "step", "target", "y", "mean", "q"]


def refit_origins(series: DataFrame, min_train: int, refit_every: int, embargo: int = 0) -> DataFrame:
    """Each origin from the first on with the refit origin whose fit it uses."""
    first = min_train - 1 + embargo
    back = (F.col("n") - first) % refit_every
    return series.where(F.col("n") >= first).select("instrument", F.col("n").alias("origin"), (F.col("n") - back).alias("refit"))


def _ar_fit(head: np.ndarray, tail: np.ndarray, total: float, products: np.ndarray, n: int, max_lag: int) -> list[float]:
    """[sigma2, const, phi...] of the order with the least AIC. products[k]: sum of x_t x_{t-k} over t >= k;
    head and tail: the first and last max_lag values (fewer products at the ends are taken off)."""
    best, found = math.inf, [1e-24, 0.0]
    for p in range(1, max_lag + 1):
        m = n - p
        if m <= 10:
            break
        gram, sums = np.empty((p + 1, p + 1)), np.empty(p + 1)
        for i in range(p + 1):  # x_{t-i} over t = p .. n-1
            sums[i] = total - head[: p - i].sum() - (tail[len(tail) - i :].sum() if i else 0.0)
            for j in range(i, p + 1):
                k = j - i
                early = sum(head[u] * head[u - k] for u in range(k, p - i))
                late = sum(tail[len(tail) - 1 - u] * tail[len(tail) - 1 - u - k] for u in range(i))
                gram[i, j] = gram[j, i] = products[k] - early - late
        left = np.block([[np.array([[float(m)]]), sums[None, 1:]], [sums[1:, None], gram[1:, 1:]]])
        right = np.concatenate([[sums[0]], gram[0, 1:]])
        beta = np.linalg.lstsq(left, right, rcond=None)[0]
        s2 = max(float(gram[0, 0] - beta @ right) / m, 1e-300)
        aic = m * (math.log(2 * math.pi) + math.log(s2) + 1) + 2 * (1 + p + 1)
        if aic < best:
            best, found = aic, [s2, *beta.tolist()]
    return found


def _ar_params(*columns) -> Column:
    """[sigma2, const, phi...] of rows (head, tail, total, products, n)."""

    @F.pandas_udf("array<double>")
    def run(head: pd.Series, tail: pd.Series, total: pd.Series, products: pd.Series, n: pd.Series) -> pd.Series:
        lag = len(products.iloc[0]) - 1 if len(products) else 0
        return pd.Series([_ar_fit(np.asarray(h, float), np.asarray(t, float), s, np.asarray(g, float), int(k), lag) for h, t, s, g, k in zip(head, tail, total, products, n)], dtype=object)

    return run(*columns)


def _ar_paths(horizon: int):
    @F.pandas_udf("struct<mean: array<double>, var: array<double>>")
    def run(params: pd.Series, last: pd.Series) -> pd.DataFrame:
        means, variances = [], []
        for x, h in zip(params, last):
            s2, const, phi = x[0], x[1], np.asarray(x[2:], float)
            path, psi = list(h), [1.0]
            for _ in range(horizon):
                past = path[: -len(phi) - 1 : -1] if len(phi) else []
                path.append(const + float(np.dot(phi[: len(past)], past)))
                psi.append(sum(phi[i] * psi[len(psi) - 1 - i] for i in range(min(len(phi), len(psi)))))
            means.append(path[len(h) :])
            variances.append((s2 * np.cumsum(np.square(psi[:horizon]))).tolist())
        return pd.DataFrame({"mean": means, "var": variances})

    return run


def _steps(rows: DataFrame, model: str, horizon: int, mean: Column, sigma: Column, grid: Column) -> DataFrame:
    """Archive rows of arrays by step; grid: the standard quantiles of a row."""
    steps = rows.select("instrument", F.col("n").alias("origin"), "ys", grid.alias("g"), F.posexplode(F.arrays_zip(mean.alias("mean"), sigma.alias("sigma"))).alias("k", "f"))
    q = F.transform("g", lambda z: F.col("f.mean") + F.col("f.sigma") * z)
    return steps.select("instrument", F.lit(model).alias("model"), "origin", (F.col("k") + 1).alias("step"), (F.col("origin") + F.col("k") + 1).alias("target"), F.get("ys", F.col("k")).alias("y"), F.col("f.mean").alias("mean"), F.array_sort(q).alias("q")).where("y is not null")


def _future(horizon: int) -> Column:
    """The next returns of a row."""
    return F.array(*[F.lead("ret", k).over(by_n()) for k in range(1, horizon + 1)])


def ar_by_aic(series: DataFrame, *, horizon: int = 1, min_train: int = 252, refit_every: int = 21, max_lag: int = 5) -> DataFrame:
    """Autoregression of order 1 to max_lag by AIC, fitted at every refit origin on all returns so far; means
    by recursion, variance sigma2 times the summed squares of the moving-average weights, Gaussian quantiles."""
    so_far = by_n().rowsBetween(Window.unboundedPreceding, 0)
    width = 2 * max_lag
    lagged = series.withColumns({f"_p{k}": F.col("ret") * (F.lag("ret", k).over(by_n()) if k else F.col("ret")) for k in range(max_lag + 1)})
    rows = lagged.select(
        "instrument", "n", "ret", _future(horizon).alias("ys"), F.sum("ret").over(so_far).alias("_s"),
        F.array(*[F.coalesce(F.sum(f"_p{k}").over(so_far), F.lit(0.0)) for k in range(max_lag + 1)]).alias("_g"),
        F.collect_list("ret").over(by_n().rowsBetween(-width + 1, 0)).alias("_tail"),
    )
    head = series.where(F.col("n") < width).groupBy("instrument").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ret"))), lambda x: x["ret"]).alias("_head"))  # of width values
    origins = refit_origins(series, min_train, refit_every)
    refits = rows.join(origins.where("origin = refit").select("instrument", F.col("origin").alias("n")), ["instrument", "n"]).join(head, "instrument")
    fitted = refits.select("instrument", F.col("n").alias("refit"), _ar_params("_head", "_tail", "_s", "_g", F.col("n") + 1).alias("params"))
    joined = rows.join(origins.withColumnRenamed("origin", "n"), ["instrument", "n"]).join(fitted, ["instrument", "refit"])
    paths = joined.withColumn("f", _ar_paths(horizon)("params", F.slice("_tail", -max_lag, max_lag)))
    sigma = F.transform("f.var", lambda v: F.sqrt(F.greatest(v, F.lit(1e-24))))
    return _steps(paths, "ar", horizon, F.col("f.mean"), sigma, F.array(*[F.lit(z) for z in Z]))


@lru_cache(maxsize=4096)
def t_levels(nu: float) -> tuple[float, ...]:
    """Student's t quantiles of the levels on a scale of deviation one; nu is 2.1 at least."""
    nu = max(nu, 2.1)
    return tuple(math.sqrt((nu - 2) / nu) * t_quantile(p, nu) for p in LEVELS)


def t_grid(nu: str | Column) -> Column:
    """Standard quantiles for each nu."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([list(t_levels(round(float(x), 6))) for x in values], dtype=object)

    return run(nu)


#: The grid of GARCH cells: reaction, persistence and degrees of freedom. Fixed values.
ALPHAS, PERSISTENCE, NUS = (0.02, 0.05, 0.08, 0.12, 0.2), (0.8, 0.9, 0.95, 0.98, 0.99), (4.0, 6.0, 8.0, 12.0, 30.0)
GARCH = "instrument string, n long, mu double, alpha double, beta double, nu double, var double, uncond double"


class GarchGrid:
    """Running likelihoods of all cells of one instrument; variances aim at the variance so far."""

    def __init__(self, burn: int = 20):
        self.a, total = (x.ravel() for x in np.meshgrid(ALPHAS, PERSISTENCE, indexing="ij"))
        self.b, self.nu, self.burn = total - self.a, np.array(NUS), burn
        self.const = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2)) for v in NUS])
        self.n, self.mu, self.m2 = 0, 0.0, 0.0
        self.h, self.ll = None, np.zeros((len(self.a), len(NUS)))

    def add(self, x: float) -> None:
        e = x - self.mu
        if self.h is not None and self.n >= self.burn:
            z2 = e * e / self.h[:, None]
            self.ll += self.const - 0.5 * np.log(self.h)[:, None] - (self.nu + 1) / 2 * np.log1p(z2 / (self.nu - 2))
        self.n += 1
        d = x - self.mu
        self.mu += d / self.n
        self.m2 += d * (x - self.mu)
        if self.n >= 2:
            s2 = max(self.m2 / (self.n - 1), 1e-24)
            h = np.full(len(self.a), s2) if self.h is None else self.h
            self.h = np.maximum((1 - self.a - self.b) * s2 + self.a * e * e + self.b * h, 1e-24)

    def best(self) -> tuple[int, int]:
        return np.unravel_index(int(np.argmax(self.ll)), self.ll.shape)


def _garch(min_train: int, refit_every: int):
    def run(frames):
        name, grid, cell = None, None, None
        for f in frames:
            out = []
            for instrument, n, x in zip(f["instrument"], f["n"].tolist(), f["ret"].tolist()):
                if instrument != name:
                    name, grid, cell = instrument, GarchGrid(), None
                grid.add(x)
                if n >= min_train - 1:
                    if (n - min_train + 1) % refit_every == 0:
                        cell, mu = grid.best(), grid.mu
                    i, k = cell
                    out.append((instrument, n, mu, grid.a[i], grid.b[i], grid.nu[k], grid.h[i], grid.m2 / (grid.n - 1)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GARCH.split(", ")])

    return run


def garch_fits(series: DataFrame, min_train: int = 252, refit_every: int = 21) -> DataFrame:
    """Per origin the GARCH(1,1) cell with the greatest Student likelihood at its refit origin, and the variance
    it expects next. One sorted pass carries every cell's variance and likelihood, whatever the number of refits."""
    rows = series.select("instrument", "n", "ret").repartition(F.struct("instrument")).sortWithinPartitions("instrument", "n")
    return rows.mapInPandas(_garch(min_train, refit_every), GARCH)


def garch_t(series: DataFrame, *, horizon: int = 1, min_train: int = 252, refit_every: int = 21) -> DataFrame:
    """The volatility rung: GARCH(1,1) with Student quantiles; the variance reverts to the one so far by step."""
    fits = garch_fits(series, min_train, refit_every)
    rows = series.select("instrument", "n", _future(horizon).alias("ys")).join(fits, ["instrument", "n"])
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    sigma = F.transform(steps, lambda k: F.sqrt(F.col("uncond") + F.pow(F.col("alpha") + F.col("beta"), k.cast("double")) * (F.col("var") - F.col("uncond"))))
    return _steps(rows, "garch", horizon, F.transform(steps, lambda k: F.col("mu")), sigma, t_grid("nu"))


def naive_by_step(series: DataFrame, *, horizon: int = 1, min_train: int = 252, tail: int = 250, **_) -> DataFrame:
    """Mean 0 and the last returns' quantiles around their median, the same for every step."""
    rows = trailing_quantiles(series.select("instrument", "n", "ret", _future(horizon).alias("ys")), tail).where(F.col("n") >= min_train - 1)
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    return _steps(rows, "naive-rw", horizon, F.transform(steps, lambda k: F.lit(0.0)), F.transform(steps, lambda k: F.lit(1.0)), F.transform("_q", lambda x: x - F.element_at("_q", 5)))


#: Rungs by name: (series, horizon=, min_train=, refit_every=) -> archive rows. Own rungs may be added.
RUNGS = {"naive-rw": naive_by_step, "ar": ar_by_aic, "garch": garch_t}


def walk_forward(series: DataFrame, rungs: dict | None = None, **how) -> DataFrame:
    """The archive of all rungs over all origins. A rung that has nothing to say for an instrument, or returns
    None, is left out; columns beyond the archive's are dropped."""
    out = None
    for name, rung in (rungs or RUNGS).items():
        rows = rung(series, **how)
        if rows is not None:
            rows = rows.withColumn("model", F.lit(name)).select(*ARCHIVE)
            out = rows if out is None else out.unionByName(rows)
    return out


# MacKinnon's surface of the unit-root statistic with a constant, and the level-stationarity table.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL, TAU_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_CRITICAL, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def adf_p(x: np.ndarray) -> float:
    """p of the augmented Dickey-Fuller test with a constant; lags by AIC over a common sample."""
    d, n = np.diff(x), len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or len(d) <= 3 or not np.any(d):
        return 1.0

    def design(lags: int, skip: int):
        columns = [x[skip:-1], *[d[skip - k : len(d) - k] for k in range(1, lags + 1)], np.ones(len(d) - skip)]
        return np.column_stack(columns), d[skip:]

    full, y = design(most, most)
    best, lags = math.inf, 0
    for k in range(most + 1):
        part = np.column_stack([full[:, : k + 1], full[:, -1]])
        rest = y - part @ np.linalg.lstsq(part, y, rcond=None)[0]
        aic = len(y) * (math.log(2 * math.pi) + math.log(max(rest @ rest / len(y), 1e-300)) + 1) + 2 * (k + 2)
        if aic < best:
            best, lags = aic, k
    part, y = design(lags, lags)
    inverse = np.linalg.pinv(part.T @ part)
    beta = inverse @ part.T @ y
    rest = y - part @ beta
    tau = beta[0] / math.sqrt(max(rest @ rest / (len(y) - part.shape[1]) * inverse[0, 0], 1e-300))
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    return NormalDist().cdf(sum(c * tau**k for k, c in enumerate(TAU_SMALL if tau <= TAU_STAR else TAU_LARGE)))


def _adf(frame: pd.DataFrame) -> pd.DataFrame:
    x = frame.sort_values("n")["ret"].to_numpy(float)
    return pd.DataFrame({"instrument": [frame["instrument"].iloc[0]], "start": [int(frame["start"].iloc[0])], "n": [len(x)], "p": [adf_p(x)]})


def adf(series: DataFrame, window: int | None = None, step: int = 25) -> DataFrame:
    """(instrument, start, n, p) of each instrument's returns, or of each of its windows [start, start + window)
    that end before its last row."""
    if window is None:
        rows = series.select("instrument", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("n"), "ret")
    else:
        size = series.groupBy("instrument").agg((F.max("n") + 1).alias("_len"))
        lo, hi = F.greatest(F.lit(0), F.ceil((F.col("n") - window + 1) / step)), F.least(F.floor(F.col("n") / step), F.ceil((F.col("_len") - window) / step) - 1)
        near = series.join(size, "instrument").withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
        rows = near.select("instrument", F.explode(F.transform(F.sequence("_lo", "_hi"), lambda k: (k * step).cast("long"))).alias("start"), F.col("n").cast("long").alias("n"), "ret")
    return rows.groupBy("instrument", "start").applyInPandas(_adf, "instrument string, start long, n long, p double")


def rolling_stationarity(series: DataFrame, window: int = 250, step: int = 25, alpha: float = 0.05) -> DataFrame:
    """Share of an instrument's windows that test as stationary."""
    return adf(series, window, step).groupBy("instrument").agg(F.count(F.lit(1)).alias("n_windows"), F.avg((F.col("p") < alpha).cast("double")).alias("share"))


def kpss_p(stat: Column) -> Column:
    """p by interpolation in the table, which it does not leave."""
    pieces = list(zip(KPSS_CRITICAL, KPSS_CRITICAL[1:], KPSS_P, KPSS_P[1:]))
    value = F.when(stat <= KPSS_CRITICAL[0], KPSS_P[0])
    for a, b, p, q in pieces:
        value = value.when(stat <= b, p + (q - p) * (stat - a) / (b - a))
    return value.otherwise(KPSS_P[-1])


def structural_breaks(series: DataFrame, *, min_size: int = 60, penalty: float = 3.0, max_depth: int | None = None) -> DataFrame:
    """(instrument, break_at, stat): splits where the cumulated squares leave the straight line by more than the
    penalty, again within both parts until none does. All segments of all instruments are split in one pass."""
    spark = series.sparkSession
    folder = shared_folder(spark, "breaks")
    rows, depth = series.select("instrument", "n", (F.col("ret") * F.col("ret")).alias("v"), F.lit(0).cast("long").alias("seg")), 0
    found = None
    while max_depth is None or depth < max_depth:
        w = Window.partitionBy("instrument", "seg")
        share = F.sum("v").over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) / (F.sum("v").over(w) + 1e-12)
        size = F.count(F.lit(1)).over(w)
        placed = rows.withColumn("_len", size).withColumn("k", F.col("n") - F.col("seg"))
        dev = F.abs(share - F.col("k") / F.greatest(F.col("_len") - 1, F.lit(1)))
        top = placed.withColumn("dev", dev).groupBy("instrument", "seg").agg(F.max_by(F.struct("k", "dev"), F.struct("dev", -F.col("k"))).alias("x"), F.first("_len").alias("_len"))
        splits = top.select("instrument", "seg", (F.col("seg") + F.col("x.k")).alias("break_at"), (F.col("x.dev") * F.sqrt("_len")).alias("stat"), F.col("x.k").alias("k"), "_len")
        splits = splits.where((F.col("_len") >= 2 * min_size) & (F.col("stat") > penalty) & F.col("k").between(min_size, F.col("_len") - min_size)).drop("k", "_len")
        splits.write.parquet(f"{folder}/splits-{depth}")
        splits = spark.read.schema(splits.schema).parquet(f"{folder}/splits-{depth}")
        found = splits.drop("seg") if found is None else found.union(splits.drop("seg"))
        if splits.isEmpty():
            break
        # Only the two parts of a split can split again.
        rows = rows.join(splits.select("instrument", "seg", "break_at"), ["instrument", "seg"]).select("instrument", "n", "v", F.when(F.col("n") >= F.col("break_at"), F.col("break_at")).otherwise(F.col("seg")).alias("seg"))
        rows.write.parquet(f"{folder}/rows-{depth}")
        rows, depth = spark.read.schema(rows.schema).parquet(f"{folder}/rows-{depth}"), depth + 1
    return found


def causal_breaks(series: DataFrame, *, window: int = 250, least: int = 60, drift: float = 0.5, limit: float = 20.0, most: float = 10.0) -> DataFrame:
    """(instrument, break_at, stat, side): rows at which the variance is seen to have changed, from rows up to
    them alone. Each square is measured by the mean square of the ``window`` rows before it (``most`` at most, one
    subtracted); what it is above (side up) or below (down) by more than the drift adds up, from zero whenever the
    sum would be negative, and a break is where that passes the limit. That the sum starts anew is its running
    value less its running minimum, so windows suffice.
    """
    square = F.col("ret") * F.col("ret")
    past = by_n().rowsBetween(-window, -1)
    so_far = by_n().rowsBetween(Window.unboundedPreceding, 0)
    rows = series.select("instrument", "n", F.when(F.count("ret").over(past) >= least, F.avg(square).over(past)).alias("_base"), square.alias("_sq"))
    rows = rows.withColumn("_z", F.when(F.col("_base") > 0, F.least(F.lit(most), F.col("_sq") / F.col("_base")) - 1))
    sums = rows.withColumns({"_up": F.coalesce(F.sum(F.col("_z") - drift).over(so_far), F.lit(0.0)), "_down": F.coalesce(F.sum(-F.col("_z") - drift).over(so_far), F.lit(0.0))})
    found = sums.withColumns({c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(so_far)) for c in ("_up", "_down")})
    edges = found.withColumns({f"{c}_before": F.coalesce(F.lag(c).over(by_n()), F.lit(0.0)) for c in ("_up", "_down")})
    sides = edges.select("instrument", F.col("n").cast("long").alias("break_at"), F.explode(F.array(*[F.struct(F.col(c).alias("stat"), F.col(f"{c}_before").alias("before"), F.lit(c[1:]).alias("side")) for c in ("_up", "_down")])).alias("s"))
    return sides.where((F.col("s.stat") > limit) & (F.col("s.before") <= limit)).select("instrument", "break_at", "s.stat", "s.side")


class Markov:
    """A Gaussian Markov chain of few states with diagonal covariances, fitted by expectation and maximisation."""

    def __init__(self, x: np.ndarray, states: int = 3, rounds: int = 50, tol: float = 1e-3):
        order = np.argsort(x[:, -1])
        split = np.array_split(order, states)
        self.mean = np.array([x[s].mean(axis=0) for s in split])
        self.var = np.tile(np.maximum(x.var(axis=0), 1e-12), (states, 1))
        self.start, self.move = np.full(states, 1 / states), np.full((states, states), 0.05 / (states - 1))
        np.fill_diagonal(self.move, 0.95)
        last = -math.inf
        for _ in range(rounds):
            like = self._like(x)
            alpha, scale = self._forward(like)
            beta = np.ones_like(alpha)
            for t in range(len(x) - 2, -1, -1):
                beta[t] = self.move @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
            post = alpha * beta
            post /= post.sum(axis=1, keepdims=True)
            pair = np.einsum("ti,tj->ij", alpha[:-1], like[1:] * beta[1:] / scale[1:, None]) * self.move
            self.move = np.maximum(pair / np.maximum(pair.sum(axis=1, keepdims=True), 1e-300), 1e-12)
            self.move /= self.move.sum(axis=1, keepdims=True)
            self.start, weight = post[0], np.maximum(post.sum(axis=0), 1e-12)[:, None]
            self.mean = post.T @ x / weight
            self.var = np.maximum(post.T @ (x * x) / weight - self.mean**2, 1e-12)
            total = float(np.log(scale).sum() + self.shift.sum())
            if total - last < tol:
                break
            last = total
        rank = np.argsort(self.mean[:, -1])  # states by their volatility
        self.mean, self.var, self.start, self.move = self.mean[rank], self.var[rank], self.start[rank], self.move[np.ix_(rank, rank)]

    def _like(self, x: np.ndarray) -> np.ndarray:
        log = -0.5 * (((x[:, None, :] - self.mean) ** 2 / self.var) + np.log(2 * math.pi * self.var)).sum(axis=2)
        self.shift = log.max(axis=1)
        return np.maximum(np.exp(log - self.shift[:, None]), 1e-300)

    def _forward(self, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = np.empty_like(like), np.empty(len(like))
        now = self.start * like[0]
        for t in range(len(like)):
            if t:
                now = (alpha[t - 1] @ self.move) * like[t]
            scale[t] = now.sum()
            alpha[t] = now / scale[t]
        return alpha, scale

    def last_states(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every row, the last state of the most likely path up to it, and the states' probabilities."""
        like = self._like(x)
        alpha, _ = self._forward(like)
        best, log, move = np.empty(len(x), int), np.log(self.start) + np.log(like[0]), np.log(self.move)
        for t in range(len(x)):
            if t:
                log = (log[:, None] + move).max(axis=0) + np.log(like[t])
            best[t] = int(np.argmax(log))
        return best, alpha


REGIMES = "instrument string, n long, refit long, state long, confidence double, stay double"


def _markov(window: int, states: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n")
        x, n, refit = frame[["ret", "vol"]].to_numpy(float), frame["n"].to_numpy(), int(frame["refit"].iloc[0])
        fitted = Markov(x[n <= refit], states)
        state, p = fitted.last_states(x)
        at = np.flatnonzero(n >= refit)
        return pd.DataFrame({"instrument": frame["instrument"].iloc[0], "n": n[at], "refit": refit, "state": state[at], "confidence": p[at, state[at]], "stay": fitted.move[state[at], state[at]]})

    return run


def markov_regimes(series: DataFrame, *, window: int = 504, every: int = 30, states: int = 3, vol: int = 5) -> DataFrame:
    """Per row from ``window`` on: the state (by volatility, 0 the calmest) of a chain over return and five-day
    volatility, fitted on the last ``window`` rows at each refit, its probability and its chance to stay. Refits
    are independent groups of window + every rows."""
    w = by_n().rowsBetween(-vol + 1, 0)
    rows = series.withColumn("vol", F.when(F.count("ret").over(w) >= vol, F.stddev_samp("ret").over(w))).where("vol is not null").select("instrument", F.col("n").cast("long").alias("n"), "ret", "vol")
    size = rows.groupBy("instrument").agg(F.max("n").alias("_last"))
    first = vol - 1 + window - 1
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("n") - first - every + 1) / every)), F.floor((F.col("n") - first + window - 1) / every)
    dealt = rows.join(size, "instrument").withColumn("_lo", lo).withColumn("_hi", F.least(hi, F.floor((F.col("_last") - first) / every))).where("_lo <= _hi")
    dealt = dealt.select("instrument", "n", "ret", "vol", F.explode(F.transform(F.sequence("_lo", "_hi"), lambda k: (first + every * k).cast("long"))).alias("refit"))
    return dealt.groupBy("instrument", "refit").applyInPandas(_markov(window, states), REGIMES)


def regime_flips(regimes: DataFrame) -> DataFrame:
    """Refits whose first row has another state than the last row of the refit before: (instrument, refit, state, was)."""
    ends = regimes.groupBy("instrument", "refit").agg(F.min_by("state", "n").alias("state"), F.max_by("state", "n").alias("_end"))
    was = F.lag("_end").over(Window.partitionBy("instrument").orderBy("refit"))
    return ends.withColumn("was", was).where("was is not null and was != state").select("instrument", "refit", "state", "was")
