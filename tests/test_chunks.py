"""Volume bars by chunk maps against a plain scan of the tape."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemill.operators import bars

T0 = dt.datetime(2024, 1, 2, 9, 30)
ROW = "instrument string, ts timestamp_ntz, seq long, price double, size long"
COLUMNS = ["instrument", "bar_seq", "close_ts", "open", "high", "low", "close", "volume", "n_trades"]


def plain(rows, bar_size):
    """Closed bars of rows sorted by instrument and time, one trade after another."""
    out, held, seq, last = [], {}, {}, {}
    for name, ts, _, price, size in rows:
        o, h, l, _, v, n = held.get(name, (price, price, price, price, 0, 0))
        held[name] = (o, max(h, price), min(l, price), price, v + size, n + 1)
        if v + size >= bar_size:
            ts = max(ts, last[name] + dt.timedelta(microseconds=1)) if name in last else ts
            last[name] = ts
            out.append((name, seq.get(name, 0), ts, *held.pop(name)))
            seq[name] = seq.get(name, 0) + 1
    return sorted(out)


def random_tape(rng, n=3000):
    rows = []
    for name in ("X", "Y", "Z"):
        t = T0
        for i in range(n if name == "X" else n // 10):
            t += dt.timedelta(seconds=rng.choice([0, 0, 0.5, 3, 60, 4000]))
            rows.append((name, t, i, round(100 + rng.gauss(0, 1), 3), rng.choice([1, 2, 5, 40, 700])))
    return rows


@pytest.mark.parametrize("bar_size", [1, 7, 100, 650, 10**6])
def test_random_tapes_equal_a_plain_scan(spark, bar_size):
    rows = random_tape(random.Random(bar_size))
    got = bars.volume_bars(spark.createDataFrame(rows, ROW).repartition(5), bar_size).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == plain(rows, bar_size)


def test_a_chunk_tells_what_it_makes_of_any_volume():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size, sizes = int(rng.integers(1, 60)), rng.integers(0, 30, int(rng.integers(1, 40)))
        lo, out, closed = bars.carry_map(sizes, size)
        assert (np.diff(lo) > 0).all()
        for v in range(size):
            volume, n = v, 0
            for x in sizes:
                volume += int(x)
                if volume >= size:
                    volume, n = 0, n + 1
            k = int(np.searchsorted(lo, v, "right")) - 1
            assert (volume, n) == ((int(out[k]), int(closed[k])) if k >= 0 else (v + int(sizes.sum()), 0))


def test_courses_that_meet_keep_maps_small():
    sizes = np.random.default_rng(4).integers(1, 9, 200_000)
    lo, _, _ = bars.carry_map(sizes, 5000)
    assert len(lo) < 400


@pytest.mark.parametrize("bar_size", [50, 900])
def test_days_scanned_apart_equal_one_scan(spark, bar_size):
    rows = random_tape(random.Random(9))
    cuts = [T0 + dt.timedelta(days=d) for d in (0.4, 3, 11)]
    state, got = None, []
    for lo, hi in zip([T0, *cuts], [*cuts, dt.datetime.max]):
        part = spark.createDataFrame([r for r in rows if lo <= r[1] < hi], ROW)
        got += bars.volume_bars(part, bar_size, state).select(COLUMNS).collect()
        after = bars.bar_state(bars.extend_bars(part, bar_size, state), state).collect()
        state = spark.createDataFrame(after, bars.BAR_STATE)
    assert sorted(map(tuple, got)) == plain(rows, bar_size)
    assert {r.instrument for r in after} == {"X", "Y", "Z"}


def test_an_empty_tape(spark):
    none = spark.createDataFrame([], ROW)
    assert bars.volume_bars(none, 10).count() == 0
    state = spark.createDataFrame([("X", 4, 1.0, 2.0, 0.5, 1.5, 6, 3, T0, 17)], bars.BAR_STATE)
    assert [tuple(r) for r in bars.bar_state(bars.extend_bars(none, 10, state), state).collect()] == [tuple(r) for r in state.collect()]


def test_bar_sizes_are_chosen_on_whole_sessions(spark):
    rng, rows, t = random.Random(2), [], T0 + dt.timedelta(hours=5)
    for i in range(4000):
        t += dt.timedelta(seconds=rng.choice([1, 2, 5]))
        rows.append(("X", t, i, 1.0, rng.randrange(1, 9)))
    got = bars.choose_bar_size(spark.createDataFrame(rows, ROW), [k * 20 for k in range(1, 21)], 45.0).collect()
    medians = {}
    for size in (k * 20 for k in range(1, 21)):
        at, v = [], 0
        for r in rows:
            v += r[4]
            if v >= size:
                v = 0
                at.append(r[1])
        took = [(b - a).total_seconds() for a, b in zip(at, at[1:]) if 13 * 60 + 30 <= b.hour * 60 + b.minute < 20 * 60]
        medians[size] = float(np.median(took)) if took else 0
    want = min(s for s, m in medians.items() if m >= 45)
    assert [(r.bar_size, r.median_seconds) for r in got] == [(want, medians[want])]
