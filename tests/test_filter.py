"""The tick filter against two-by-two matrices on irregular gaps, by state class, batch scan and stream."""

import datetime as dt
import random
import tempfile

import numpy as np
import pytest

from tidemill.operators import micro
from tidemill.streaming import states
from tidemill.streaming.bars import run_to_table

T0 = dt.datetime(2024, 1, 2, 15, 0)


def by_matrices(prices, gaps, r=1e-3, q=1e-5):
    """Level and velocity after each price: constant velocity, continuous white noise of the acceleration."""
    x, p, out = np.array([prices[0], 0.0]), np.eye(2), [(prices[0], 0.0)]
    for price, dt_ in zip(prices[1:], gaps[1:]):
        dt_ = max(dt_, 1e-4)
        f = np.array([[1.0, dt_], [0.0, 1.0]])
        x, p = f @ x, f @ p @ f.T + q * np.array([[dt_**3 / 3, dt_**2 / 2], [dt_**2 / 2, dt_]])
        gain = p[:, 0] / (p[0, 0] + r)
        rest = np.eye(2) - np.outer(gain, [1.0, 0.0])
        x, p = x + gain * (price - x[0]), rest @ p @ rest.T + r * np.outer(gain, gain)
        out.append((float(x[0]), float(x[1])))
    return out


@pytest.mark.parametrize("gap", [0.01, 1.0, 60.0, None])
def test_steps_equal_the_matrices(gap):
    rng = random.Random(8)
    gaps = [gap if gap else rng.choice([0.0, 0.01, 0.2, 1, 7, 60, 3600]) for _ in range(200)]
    prices = [1.1]
    for _ in gaps[1:]:
        prices.append(prices[-1] + rng.gauss(0, 0.01))
    state = micro.TickState()
    got = [state.step(p, g) for p, g in zip(prices, gaps)]
    assert np.allclose(got, by_matrices(prices, gaps), rtol=1e-6, atol=1e-9)


def test_scan_and_stream_equal_the_matrices(spark):
    rng, rows, t = random.Random(5), [], T0
    gaps, prices = [], [1.2]
    for i in range(400):
        gaps.append(rng.choice([0.05, 0.5, 2, 45]))
        t += dt.timedelta(seconds=gaps[-1])
        rows.append(("X", t, i, prices[-1]))
        prices.append(prices[-1] + rng.uniform(-1, 1) * 1e-3)
    want = by_matrices(prices[:400], gaps)
    schema = "instrument string, ts timestamp_ntz, seq long, price double"
    ticks = spark.createDataFrame(rows, schema)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k in range(3):
        ticks.where(f"floor(seq / 150) = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for found in (micro.condition_ticks(ticks), run_to_table(states.tick_stream(stream), folder, spark)):
        got = {r.seq: (r.level, r.velocity) for r in found.where("not spike").collect()}
        assert len(got) == 400 and np.allclose([got[i] for i in range(400)], want, rtol=1e-9, atol=1e-9)
