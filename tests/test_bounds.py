"""What bounds memory and time on large inputs: files of a replayed table, slices of a trigger, running sums."""

import datetime
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemill.operators import micro
from tidemill.operators.micro import TickState
from tidemill.sources.tables import tape_stream
from tidemill.streaming import bars, states
from tidemill.streaming.bars import run_to_table


class Held:
    """A group's state outside of a stream."""

    def __init__(self, value=None, watermark=0):
        self.value, self.watermark = value, watermark

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def frame(n, start=0):
    at = start + np.arange(n)
    return pd.DataFrame({"instrument": "a", "ts": pd.to_datetime(1_700_000_000 + at, unit="s").astype("datetime64[us]"), "seq": at, "price": 100 + np.sin(at), "size": 1 + at % 7, "side": "B"})


@pytest.mark.parametrize("name", ["in_order", "condition", "ticks", "bars"])
def test_results_of_a_trigger_come_in_slices(name):
    """10,000 rows of one instrument and trigger in, no 10,000 out at once."""
    run = {"in_order": states._release(["seq", "price", "size", "side"]), "condition": states._condition(256, 64), "ticks": states._ticks, "bars": bars._extend(5)}[name]
    state = Held(watermark=(1_700_000_000 + 9_999) * 1000)
    out = list(run(("a",), iter([frame(6_000), frame(4_000, 6_000)]), state))
    assert len(out) == 3 and max(map(len, out)) <= 4096
    if name != "bars":
        assert pd.concat(out)["seq"].tolist() == list(range(10_000))


def test_reordered_rows_are_held_packed():
    """What is held takes under 64 bytes a row and is released in order of time, equal times as they came."""
    run, state = states._release(["seq", "price", "size", "side"]), Held(watermark=1_700_000_000 * 1000 - 1)
    shuffled = frame(20_000).sample(frac=1, random_state=1)
    assert sum(map(len, run(("a",), iter([shuffled[:9_000], shuffled[9_000:]]), state))) == 0
    assert len(state.value[0]) < 64 * 20_000 and state.timeout == 1_700_000_000 * 1000 + 1
    state.watermark = (1_700_000_000 + 14_999) * 1000
    out = pd.concat(run(("a",), iter([]), state))
    assert out["seq"].tolist() == list(range(15_000)) and out["ts"].iloc[0] == datetime.datetime(2023, 11, 14, 22, 13, 20)
    state.watermark += 10_000_000
    assert pd.concat(run(("a",), iter([]), state))["seq"].tolist() == list(range(15_000, 20_000)) and not state.exists


def test_tape_is_replayed_in_bounded_files(spark, sf_dir):
    """The table is one file; the stream takes it in order of time, a bounded part of it at a trigger."""
    stream, folder = tape_stream(spark, sf_dir, rows_per_file=100), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    seen = []
    stream.writeStream.foreachBatch(lambda b, k: seen.append(b.selectExpr("count(*) n", "min(struct(ts, seq)) a", "max(struct(ts, seq)) b").first())).option("checkpointLocation", f"{folder}/seen").trigger(availableNow=True).start().awaitTermination()
    total = duckdb.execute(f"select count(*) from '{sf_dir}/events.parquet' where value > 0").fetchone()[0]
    assert sum(r.n for r in seen) == total and max(r.n for r in seen) < 250 and len(seen) >= total / 250
    assert all(x.b < y.a for x, y in zip(seen, seen[1:]))
    got = run_to_table(states.in_order(stream), folder, spark)
    kept = duckdb.execute(f"select count(*) from '{sf_dir}/events.parquet' where value > 0 and ts <= (select date_trunc('millisecond', max(ts)) - interval 20 minute from '{sf_dir}/events.parquet' where value > 0)").fetchone()[0]
    assert got.count() == kept == got.select("seq").distinct().count()


def test_running_sums_tell_the_same_spikes():
    """Against deviations and medians computed for every price: on random walks, ties, huge jumps and borders."""
    rng = np.random.default_rng(1)
    walks = [np.cumprod(1 + rng.standard_t(3, 2_000) * 1e-3), np.round(1.1 + rng.choice([0, 0, 0, 1e-4], 1_000), 4), 1e9 + rng.standard_t(2, 1_000), np.concatenate([rng.random(80), [1e12], 1e12 + rng.random(80), rng.random(200)])]
    walks += [np.array([0.0, 2.0] * 25 + [5.0] * 2 + [5.0000000001] + [0.0, 2.0] * 40), np.array([1.1] * 60 + [1.1000039] * 2 + [1.2] * 9 + [np.nan] + [1.1] * 60)]
    for walk in walks:
        state, accepted, rejects = TickState(), [], 0
        for price in walk.tolist():
            far, middle = False, price
            if len(accepted) >= 15:
                middle = float(np.median(accepted))
                far = abs(price - middle) / max(float(np.std(accepted)), 1e-6) > 4.0
            rejects = rejects + 1 if far else 0
            spike = far and rejects < 5
            if not spike:
                accepted, rejects = [*accepted[-49:], price], 0
            np.testing.assert_equal(state.accept(price), (spike, middle if spike else price))
        np.testing.assert_equal(state.accepted, accepted)
        assert TickState.restore(state.export()).export() == state.export()


def test_a_tick_computes_no_deviation_away_from_the_limit(monkeypatch):
    """Of 3,000 ticks few need the deviation of all accepted prices; each one did before."""
    asked, std = [], np.std
    monkeypatch.setattr(np, "std", lambda *a, **k: asked.append(1) or std(*a, **k))
    state, rng = TickState(), np.random.default_rng(2)
    for k, price in enumerate(rng.gamma(1, 50, 3_000).tolist()):
        state.tick(price, float(k))
    assert len(asked) < 60


def test_an_instrument_is_one_scan_after_a_join(spark):
    """The scan has its own shuffle: that of a join by instrument may be read in parts of an instrument."""
    hard = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    old = {k: spark.conf.get(k, None) for k in hard}
    for k, v in hard.items():
        spark.conf.set(k, v)
    try:
        ticks = spark.range(0, 60_000, 1, 8).selectExpr("concat('i', id % 2) instrument", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) ts", "id seq", "100 + sin(id) price")
        joined = ticks.join(ticks.groupBy("instrument").agg({"price": "max"}), "instrument")
        assert "REPARTITION_BY_COL" in micro.scan_ticks(joined)._jdf.queryExecution().executedPlan().toString()
        assert micro.tick_states(joined).count() == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
