"""Edges and structures known at each origin against brute force over the rows before it."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import ladder as lad
from tidemill.operators import report as rep
from tidemill.operators import trailing


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    out = []
    for name, phi, n in (("a", 0.5, 700), ("b", 0.0, 430), ("short", 0.3, 40)):
        x = 0.0
        for k in range(n):
            x = phi * x + rng.normal(0, 0.01)
            out.append((name, dt.datetime(2020, 1, 1) + dt.timedelta(days=k), k, float(x)))
    return spark.createDataFrame(out, "instrument string, ts timestamp_ntz, n int, ret double")


@pytest.fixture(scope="module")
def arc(series):
    return trailing.archive_by_step(series, 4).toPandas()


def test_steps_follow_the_recursion(series, arc):
    one = {(r.instrument, r.origin): r for r in lad.ar_rung(series).collect()}
    fits = {(r.instrument, r.n): r for r in lad.ar_fits(series).collect()}
    mine = arc[arc.model == "ar"]
    assert set(mine.step) == {1, 2, 3, 4} and set(mine.instrument) == {"a", "b"}
    for r in mine.itertuples():
        f = fits[r.instrument, r.origin]
        mean, var = f.ret, 0.0
        for k in range(r.step):
            mean, var = f["_c"] + f["_phi"] * mean, var + f["_phi"] ** (2 * k)
        assert r.mean == pytest.approx(mean, abs=1e-12) and r.target == r.origin + r.step
        assert (r.q[6] - r.q[2]) == pytest.approx(f["_s"] * var**0.5 * (lad.Z[6] - lad.Z[2]))
        assert r.y == fits[r.instrument, r.target].ret
        if r.step == 1:
            assert r.mean == pytest.approx(one[r.instrument, r.origin].mean, abs=1e-12)


def test_edge_matches_brute_force(spark, arc):
    flat = arc[["instrument", "model", "origin", "step", "target", "y", "mean"]]
    got = {(r.instrument, r.origin): r.edge for r in trailing.trailing_edge(spark.createDataFrame(flat), 4).collect()}
    mine = flat[flat.model == "ar"]
    assert set(got) == {(r.instrument, r.origin) for r in mine[mine.step == 1].itertuples()}
    for (name, origin), edge in got.items():
        known = mine[(mine.instrument == name) & (mine.target < origin)]
        sizes, want = known.groupby("step").size(), []
        for step, part in known.groupby("step"):
            if len(part) >= 30 and ((part.y - part["mean"]) ** 2).sum() < (part.y**2).sum():
                want.append(step)
        assert edge == (None if not (sizes >= 30).any() else max(want, default=0)), (name, origin)
    assert {e for (i, _), e in got.items() if i == "a"} - {None, 0}


def test_edge_does_not_see_the_future(spark, arc):
    flat = arc[["instrument", "model", "origin", "step", "target", "y", "mean"]]
    whole = {(r.instrument, r.origin): r.edge for r in trailing.trailing_edge(spark.createDataFrame(flat), 4).collect()}
    cut = spark.createDataFrame(flat[flat.target <= 400])
    for r in trailing.trailing_edge(cut, 4).collect():
        assert whole[r.instrument, r.origin] == r.edge


def test_gate_takes_the_edge_of_the_origin(spark, series):
    rows = trailing.archive_by_step(series, 3)
    edge = spark.createDataFrame([("a", k, None if k < 300 else 0 if k < 400 else 3) for k in range(700)], "instrument string, origin int, edge int")
    for step in (1, 2):
        for r in lad.gate(rows, step=step, edge=edge).where("instrument = 'a'").collect():
            assert ("beyond_edge" in r.reasons) == (step == 2 and 300 <= r.origin < 400), r


def test_structure_matches_the_verdict_of_its_window(spark, series, tmp_path):
    lad.archive(series).write.parquet(str(tmp_path / "arc"))
    rows = spark.read.parquet(str(tmp_path / "arc"))
    got = {(r.instrument, r.cut): r.structure for r in trailing.trailing_structure(series, rows, window=300, every=100).collect()}
    assert set(got) == {("a", 400), ("a", 500), ("a", 600), ("b", 400)}
    for (name, cut), structure in got.items():
        within = lambda c: (F.col("instrument") == name) & (F.col(c) > cut - 300) & (F.col(c) <= cut)  # noqa: E731, B023
        want = rep.classify(rep.readings(rows.where(within("target"))), rep.ljung_box_p(series.where(within("n")))).collect()
        assert [r.structure for r in want] == [structure]
    assert got["a", 600] == "linear"
    placed = trailing.verdict_at(series.where("instrument = 'a' and n in (399, 400, 499)"), spark.createDataFrame([("a", 400, "linear")], "instrument string, cut long, structure string"), F.col("n"), 100)
    assert {r.n: r.structure for r in placed.collect()} == {399: None, 400: "linear", 499: "linear"}


def test_empty(spark, series):
    none = lad.archive(series.where("n < 0"))
    assert trailing.trailing_structure(series.where("n < 0"), none).count() == 0
    assert trailing.trailing_edge(none, 3).count() == 0
