"""Hand examples, causality, and independence from partitions."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import bars, characterize, indicators, ladder, micro, prep
from tidemill.operators.asof import asof

T0 = dt.datetime(2024, 1, 2, 15, 0, 0)


def tape(spark, prices, sizes, seconds=1, sides=None, same=False):
    rows = [("X", T0 + dt.timedelta(seconds=0 if same else seconds * i), i, float(p), int(s), (sides or "N" * len(prices))[i]) for i, (p, s) in enumerate(zip(prices, sizes))]
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, seq long, price double, size long, side string")


def test_volume_bars_by_hand(spark):
    got = bars.volume_bars(tape(spark, [1.0, 1.2, 0.9, 1.1, 1.3, 1.0, 1.05, 1.15, 0.95], [4] * 9), 10).orderBy("bar_seq").collect()
    assert len(got) == 3 and all(r.volume >= 10 for r in got)
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].volume) == (1.0, 1.2, 0.9, 0.9, 12)


def test_forming_bar_is_dropped(spark):
    got = bars.volume_bars(tape(spark, [1.0, 1.1, 1.2], [10, 10, 3]), 10).orderBy("bar_seq").collect()
    assert len(got) == 2 and got[-1].close == 1.1


def test_equal_times_increase(spark):
    got = [r.close_ts for r in bars.volume_bars(tape(spark, [1, 2, 3, 4], [10] * 4, same=True), 10).orderBy("bar_seq").collect()]
    assert all(a < b for a, b in zip(got, got[1:])) and len(set(got)) == 4


def test_sessions_across_summer_time(spark):
    rows = [("X", dt.datetime(2024, 7, 1, 20, 59), 0, 1.0, 1), ("X", dt.datetime(2024, 7, 1, 21, 1), 1, 2.0, 1), ("X", dt.datetime(2024, 1, 2, 21, 30), 2, 3.0, 1)]
    got = bars.session_bars(spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, seq long, price double, size long"))
    assert {str(r.session_date): r.close for r in got.collect()} == {"2024-07-01": 1.0, "2024-07-02": 2.0, "2024-01-02": 3.0}


def test_vpin_by_hand(spark):
    got = micro.vpin_buckets(tape(spark, [1, 1, 1], [6, 7, 27], sides="BAB"), 10).orderBy("bucket").collect()
    assert [(r.buy, r.sell) for r in got] == [(6, 4), (7, 3), (10, 0), (10, 0)]
    one = micro.vpin(micro.vpin_buckets(tape(spark, [1, 1], [80, 20], sides="BA"), 100)).first()
    assert one.vpin == pytest.approx(0.6)


def test_spike_filter_and_level_shift():
    state = micro.TickState()
    for i in range(30):
        state.accept(1.1440 + 0.0001 * math.sin(i / 3))
    spike, used = state.accept(1.29)
    assert spike and abs(used - 1.144) < 2e-4
    state = micro.TickState()
    for _ in range(30):
        state.accept(1.144)
    seen = [state.accept(1.16)[0] for _ in range(5)]
    assert seen == [True] * 4 + [False]
    seen = [state.accept(1.16)[0] for _ in range(250)]
    assert not seen[-1]


def test_kalman_follows_a_trend():
    state = micro.TickState()
    for i in range(120):
        level, velocity = state.step(1.14 + 0.0001 * i, 1.0)
    assert abs(level - (1.14 + 0.0001 * 119)) < 5e-4 and abs(velocity - 1e-4) < 2e-5


def test_anomaly_flags_are_causal(spark):
    rows = [("X", T0 + dt.timedelta(days=i), i, 0.5 if i == 150 else 0.0001 * (i % 7 - 3)) for i in range(300)]
    flagged = prep.flag_anomalies(spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, seq long, ret double"), window=30)
    got = {r.seq: r.any_flag for r in flagged.collect()}
    assert got[150] and not any(got[i] for i in range(150))


@pytest.fixture(scope="module")
def closes(spark):
    rng, price, rows = random.Random(1), 100.0, []
    for i in range(600):
        price *= math.exp(rng.gauss(0, 0.01))
        rows.append(("X", T0 + dt.timedelta(days=i), i, price))
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, seq long, price double").cache()


def frame(df, n):
    return df.where(F.col("ts") < F.lit(T0 + dt.timedelta(days=n)).cast("timestamp_ntz")).orderBy("ts").toPandas()


@pytest.mark.parametrize("step", ["condition", "flags", "ladder"])
def test_future_does_not_matter(closes, step):
    def run(df):
        returns = prep.log_returns(df)
        if step == "condition":
            return prep.condition(returns, 64, 20)
        if step == "flags":
            return prep.flag_anomalies(returns)
        return ladder.ewma_rung(ladder.numbered(returns), 100).select("instrument", F.col("origin").alias("o"), "mean", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.col("origin") + 1)).alias("ts"))

    cut = closes.where(F.col("seq") < 480)
    pd.testing.assert_frame_equal(frame(run(closes), 470), frame(run(cut), 470))


def test_partitions_do_not_matter(spark, closes):
    a = prep.condition(prep.log_returns(closes)).orderBy("ts").toPandas()
    b = prep.condition(prep.log_returns(closes.repartition(7).orderBy(F.rand(3)))).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_ewm_equals_pandas(closes):
    bars_ = closes.select("instrument", "ts", F.col("price").alias("close"), (F.col("price") * 0.99).alias("low"), (F.col("price") * 1.01).alias("high"), F.col("price").alias("open"))
    got = indicators.rsi(indicators.atr(indicators.ema(bars_, 12))).orderBy("ts").toPandas()
    change = got.close.diff().fillna(0)
    up, down = change.clip(lower=0).ewm(com=13, min_periods=14).mean(), (-change.clip(upper=0)).ewm(com=13, min_periods=14).mean()
    want = (100 - 100 / (1 + up / down)).fillna(50)
    assert (got.rsi - want).abs().max() < 1e-9
    assert (got.ema - got.close.ewm(span=12, adjust=False).mean()).abs().max() < 1e-9
    assert (got.atr - got.tr.ewm(span=14, adjust=False).mean()).abs().max() < 1e-9


def test_random_walk_is_efficient(closes):
    series = ladder.numbered(prep.log_returns(closes))
    arc = ladder.archive(series)
    assert ladder.r2_oos(arc).where("model = 'ar'").first().r2 < 0.05
    assert abs(characterize.hurst(series).first().hurst - 0.5) < 0.25
    assert characterize.permutation_entropy(series).first().entropy > 0.98
    gates = {r.gate for r in ladder.gate(arc).select("gate").distinct().collect()}
    assert gates <= {"VETO", "GO", "GO_REDUCED"}


def test_asof_takes_equal_times_and_no_later_ones(spark):
    left = spark.createDataFrame([("X", 1), ("X", 5), ("X", 9), ("Y", 5)], "k string, t long")
    right = spark.createDataFrame([("X", 5, "a"), ("X", 8, "b")], "k string, u long, v string")
    back = {(r.k, r.t): r.v for r in asof(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert back == {("X", 1): None, ("X", 5): "a", ("X", 9): "b", ("Y", 5): None}
    ahead = {(r.k, r.t): r.v for r in asof(left, right, ["k"], "t", "u", ["v"], forward=True).collect()}
    assert ahead == {("X", 1): "a", ("X", 5): "b", ("X", 9): None, ("Y", 5): None}


def test_breaks_and_regimes_are_seen_from_the_past_alone(spark):
    """A change of the variance is seen soon after it; cutting the future off changes no earlier flag."""
    from tidemill.operators import fits

    rng = random.Random(6)
    rows = [("X", i, rng.gauss(0, 0.01 if i < 600 or i >= 1100 else 0.03)) for i in range(1500)]
    whole = spark.createDataFrame(rows, "instrument string, n int, ret double")
    breaks = {(r.break_at, r.side): r.stat for r in fits.causal_breaks(whole).collect()}
    up, down = ([at for at, s in sorted(breaks) if s == side] for side in ("up", "down"))
    assert any(600 <= at < 630 for at in up) and not any(at < 600 for at in up) and any(1100 <= at < 1200 for at in down)
    regimes = {r.n: (r.vol, r.regime) for r in characterize.trailing_regimes(whole).collect()}
    for n in (620, 900):
        cut = whole.where(F.col("n") < n)
        assert {(r.break_at, r.side): r.stat for r in fits.causal_breaks(cut).collect()} == {k: v for k, v in breaks.items() if k[0] < n}
        assert {r.n: (r.vol, r.regime) for r in characterize.trailing_regimes(cut).collect()} == {k: v for k, v in regimes.items() if k < n}


def test_four_hour_part_sees_bars_that_have_ended(spark):
    """A session's row takes the bar that ends with it, at 17:00 in New York, and none that runs on."""
    start = dt.datetime(2024, 1, 2, 17, 0)
    rows = [("X", start + dt.timedelta(hours=4 * i), 100.0 + i, 100.0 + i + (1 if i % 3 else -1)) for i in range(14)]
    h4 = spark.createDataFrame(rows, "instrument string, bar_start timestamp_ntz, open double, close double")
    days = spark.createDataFrame([("X", dt.date(2024, 1, 1 + k)) for k in range(1, 6)], "instrument string, session_date date")
    got = {r.session_date.day: r for r in indicators.with_h4(days, h4).collect()}
    assert got[2].h4_two is None and got[2].h4_body is None  # no bar has ended at 17:00 of the second
    close = [r[3] for r in rows]
    last = 5  # of the third's session: 13:00 to 17:00
    assert got[3].h4_return_pct == pytest.approx(100 * (close[last] / close[last - 1] - 1)) and got[3].h4_trend6_pct == pytest.approx(100 * (close[5] / close[0] - 1))
    assert got[3].h4_vol6 == pytest.approx(pd.Series(close[:6]).pct_change().tail(6).std()) and got[3].h4_two == 2 and got[3].h4_body == 1
    assert got[4].h4_return_pct == pytest.approx(100 * (close[11] / close[10] - 1)) and got[6].h4_two == got[5].h4_two
    cut = indicators.with_h4(days.where("session_date <= '2024-01-03'"), h4.where("bar_start < timestamp_ntz'2024-01-03 17:00:00'"))
    assert {r.session_date.day: tuple(r) for r in cut.collect()} == {d: tuple(got[d]) for d in (2, 3)}
