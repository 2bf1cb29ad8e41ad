"""Tail probabilities against known values, and streams against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import distributions as dist
from tidemill.operators import bars, records, rules, scans
from tidemill.streaming.bars import run_to_table, session_bar_stream, volume_bar_stream

T0 = dt.datetime(2024, 1, 2, 15)


def test_tails():
    assert dist.chi2_tail(16.919, 9) == pytest.approx(0.05, abs=1e-4)
    assert dist.chi2_tail(3.325, 9) == pytest.approx(0.95, abs=1e-4)
    assert dist.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert dist.t_two_sided(1.96, 1e7) == pytest.approx(0.05, abs=1e-4)
    assert dist.binomial_two_sided(2, 10) == pytest.approx(2 * 56 / 1024)
    assert dist.binomial_two_sided(5, 10) == 1.0 == dist.binomial_two_sided(0, 0)


def test_tails_pass_nulls(spark):
    row = spark.createDataFrame([(None, 9.0)], "x double, df double").select(dist.chi2_sf(F.col("x"), F.col("df")).alias("p")).first()
    assert row.p is None


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(2)
    rows = [(rng.choice("XY"), T0 + dt.timedelta(minutes=i), i, rng.uniform(50, 60), rng.randrange(1, 30), "N") for i in range(2000)]
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, seq long, price double, size long, side string")


@pytest.fixture
def stream(spark, trades, tmp_path):
    """The trades in four files, in time order, one file for each micro-batch."""
    for k in range(4):
        trades.where(F.col("seq").between(500 * k, 500 * k + 499)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_volume_bars_over_micro_batches(spark, trades, stream, tmp_path):
    got = run_to_table(volume_bar_stream(stream, 200), str(tmp_path / "s"), spark).toPandas()
    columns = ["instrument", "bar_seq", "open", "high", "low", "close", "volume", "n_trades"]
    want = bars.volume_bars(trades, 200).select(*columns).toPandas()
    key = ["instrument", "bar_seq"]
    assert got.sort_values(key)[columns].reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))


def test_session_bars_over_micro_batches(spark, trades, stream, tmp_path):
    got = {tuple(r) for r in session_bar_stream(stream, str(tmp_path / "s"), spark).collect()}
    assert got == {tuple(r) for r in bars.session_bars(trades).collect()}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "k string, v int, n int")
    new = spark.createDataFrame([("b", 2, 3), ("b", 3, 4), ("c", 9, 5)], "k string, v int, n int")
    once = records.upsert(old, new, ["k"], order="n")
    assert {(r.k, r.v) for r in once.collect()} == {("a", 1), ("b", 3), ("c", 9)}
    assert {(r.k, r.v) for r in records.upsert(once, new, ["k"], order="n").collect()} == {("a", 1), ("b", 3), ("c", 9)}
    assert {(r.k, r.v) for r in records.upsert(old, new, ["k"], order="n", keep_first=True).collect()} >= {("a", 1), ("b", 1)}


def test_samples_and_rules(spark, trades):
    got = scans.sample_every(trades.where("instrument = 'X'"), 600).orderBy("ts").collect()
    assert all((b.ts - a.ts).total_seconds() >= 600 for a, b in zip(got, got[1:]))
    assert rules.cpcv_paths(spark).count() == 30
    closed = scans.rule_trades(trades, enter=5, stop=3, take=4).collect()
    assert closed and all((r.exit - r.entry) * (1 if r.side == "long" else -1) >= 4 or r.reason == "stop" for r in closed)
