"""Bars: session-aligned days and four hours, and volume bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ohlcv
from .tape import new_york, regular_hours

ORDER = ["ts", "seq"]


def session_date(ts):
    """The day a session ends, at 17:00 in New York."""
    return F.to_date(new_york(ts) + F.expr("INTERVAL 7 HOURS"))


def session_bars(trades: DataFrame) -> DataFrame:
    """Daily bars by session, labelled by the day of their end."""
    return trades.groupBy("instrument", session_date(F.col("ts")).alias("session_date")).agg(*ohlcv(ORDER))


def h4_start(ts):
    """Start, in New York time, of the four hours from 17, 21, 1, 5, 9 or 13 o'clock that hold ts."""
    local = new_york(ts)
    back = F.pmod(F.hour(local) - 17, F.lit(24)) % 4
    return F.date_trunc("hour", local).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), back)


def h4_bars(trades: DataFrame) -> DataFrame:
    """Four-hour bars on New York boundaries, labelled by their local start."""
    return trades.groupBy("instrument", h4_start(F.col("ts")).alias("bar_start")).agg(*ohlcv(ORDER))


def number_bars(sizes: np.ndarray, volume: int, bar: int, bar_size: int) -> tuple[np.ndarray, int, int]:
    """Each trade's bar, and the volume and number of the bar that is forming after them; one search a bar."""
    total, closes, at, start = np.cumsum(sizes), [], 0, -volume
    while (at := int(np.searchsorted(total, start + bar_size))) < len(total):
        closes.append(at)
        start = int(total[at])
    numbers = bar + np.searchsorted(np.array(closes, np.int64), np.arange(len(sizes)))
    return numbers, int(total[-1] - start) if len(total) else volume, bar + len(closes)


#: A chunk of a tape is one instrument's trades of one such span of time; no task holds more of them at once.
GRAIN = "hour"
CHUNK = ["instrument", "chunk"]
#: What goes on from one scan to the next: the forming bar, and how far close times have been moved.
BAR_STATE = "instrument string, bar_seq long, open double, high double, low double, close double, volume long, n_trades long, close_ts timestamp_ntz, lift long"


def carry_map(sizes: np.ndarray, bar_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk makes of the volume v that is carried into it: (lo, out, closed), steps by rising lo. The
    last step with lo <= v tells the volume carried out and the number of bars closed; below the first one no
    bar closes and the chunk's volume is added to v."""
    total = np.cumsum(sizes)
    last = min(int(np.searchsorted(total, bar_size)), len(total) - 1)  # the first close if nothing is carried in
    first = np.arange(last, -1, -1)
    lo, hi = np.maximum(bar_size - total[first], 0), bar_size - np.where(first > 0, total[first - 1], 0)
    first, lo = first[lo < hi], lo[lo < hi]
    # Each first close leads to closes that no longer depend on v; courses that meet go on as one.
    start, course = np.unique(total[first], return_inverse=True)
    closed = np.ones(len(first), np.int64)
    while True:
        at = np.searchsorted(total, start + bar_size)
        on = at < len(total)
        if not on.any():
            break
        closed += on[course]
        start, again = np.unique(np.where(on, total[np.minimum(at, len(total) - 1)], start), return_inverse=True)
        course = again[course]
    out = total[-1] - start[course] if len(first) else np.zeros(0, np.int64)
    step = np.append(True, (out[1:] != out[:-1]) | (closed[1:] != closed[:-1]))[: len(lo)]
    return lo[step], out[step], closed[step]


def _chunk_parts(frames):
    """(instrument, chunk, frame) of each chunk of sorted frames, whole."""
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        new = (f["instrument"].to_numpy()[1:] != f["instrument"].to_numpy()[:-1]) | (f["chunk"].to_numpy()[1:] != f["chunk"].to_numpy()[:-1])
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield f["instrument"].iat[lo], f["chunk"].iat[lo], f.iloc[lo:hi]
        held = f.iloc[edges[-1] :]
    if held is not None and len(held):
        yield held["instrument"].iat[0], held["chunk"].iat[0], held


MAPS = "instrument string, chunk timestamp_ntz, bar_size long, total long, lo array<long>, out array<long>, closed array<long>"
CARRY = "instrument string, bar_size long, chunk timestamp_ntz, carried long, bar long"


def _maps(bar_sizes: list[int]):
    def run(frames):
        for instrument, chunk, part in _chunk_parts(frames):
            sizes = part["size"].to_numpy(np.int64)
            rows = [(instrument, chunk, b, int(sizes.sum()), *carry_map(sizes, b)) for b in bar_sizes]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MAPS.split(", ")])

    return run


def _composed(frames):
    """The volume and bar that each chunk starts with, and at a null chunk those that the tape ends with; maps
    come sorted by instrument, bar size and chunk. A row without a map starts an instrument from a state."""
    name, v, bar, out = None, 0, 0, []
    ended = lambda: [(*name, None, v, bar)] if name else []
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            if (r.instrument, r.bar_size) != name:
                out += ended()
                name, v, bar = (r.instrument, r.bar_size), 0, 0
            if r.lo is None:
                v, bar = int(r.total), int(r.out[0])
                continue
            out.append((*name, r.chunk, v, bar))
            k = int(np.searchsorted(r.lo, v, "right")) - 1
            v, bar = (int(r.out[k]), bar + int(r.closed[k])) if k >= 0 else (v + int(r.total), bar)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CARRY.split(", ")])
    yield pd.DataFrame(ended(), columns=[c.split()[0] for c in CARRY.split(", ")])


def _carried(trades: DataFrame, bar_sizes: list[int], grain: str, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The trades dealt out by chunk, and (CARRY) what is carried into each chunk. Every chunk gives its map in
    a task of its own; only the maps, one small row for a chunk, meet by instrument."""
    spread = trades.withColumn("chunk", F.date_trunc(grain, "ts").cast("timestamp_ntz")).repartition(*CHUNK)
    maps = spread.select(*CHUNK, "ts", "seq", "size").sortWithinPartitions(*CHUNK, *ORDER).mapInPandas(_maps(bar_sizes), MAPS)
    if state is not None:
        none = F.lit(None)
        maps = maps.union(state.select("instrument", none.cast("timestamp_ntz"), F.lit(bar_sizes[0]).cast("long"), "volume", none.cast("array<long>"), F.array("bar_seq"), none.cast("array<long>")))
    by = F.col("chunk").asc_nulls_first()
    return spread, maps.repartition("instrument", "bar_size").sortWithinPartitions("instrument", "bar_size", by).mapInPandas(_composed, CARRY)


def _numbered(bar_size: int):
    def run(frames):
        for _, _, part in _chunk_parts(frames):
            found, _, _ = number_bars(part["size"].to_numpy(np.int64), int(part["carried"].iat[0]), int(part["bar"].iat[0]), bar_size)
            yield part.drop(columns=["chunk", "carried", "bar"]).assign(bar_seq=found)

    return run


def extend_bars(trades: DataFrame, bar_size: int, state: DataFrame | None = None, grain: str = GRAIN) -> DataFrame:
    """All volume bars of trades that follow a state (BAR_STATE), the forming one as well: (instrument, bar_seq,
    close_ts, open, high, low, close, volume, n_trades, closed). Bars that a state holds in part are completed.

    The rule resets on its own outcome, yet no task scans an instrument: each chunk of the tape tells what it
    makes of any volume carried in, a step function; these are applied one after another; then chunks are
    numbered apart.
    """
    rows = trades.select("instrument", "ts", "seq", "price", "size")
    spread, carry = _carried(rows, [bar_size], grain, state)
    joined = spread.join(carry.where("chunk is not null").drop("bar_size"), CHUNK).select(*CHUNK, "ts", "seq", "price", "size", "carried", "bar")
    numbered = joined.sortWithinPartitions(*CHUNK, *ORDER).mapInPandas(_numbered(bar_size), "instrument string, ts timestamp_ntz, seq long, price double, size long, bar_seq long")
    bars = numbered.groupBy("instrument", "bar_seq").agg(F.max("ts").alias("close_ts"), *ohlcv(ORDER))
    if state is not None:
        old = state.where("n_trades > 0").select("instrument", "bar_seq", *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close", "volume", "n_trades", "close_ts")])
        both = bars.join(old, ["instrument", "bar_seq"], "full")
        plus = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        bars = both.select("instrument", "bar_seq", F.coalesce("close_ts", "_close_ts").alias("close_ts"), F.coalesce("_open", "open").alias("open"), F.greatest("high", "_high").alias("high"), F.least("low", "_low").alias("low"), F.coalesce("close", "_close").alias("close"), plus("volume"), plus("n_trades"))
    return bars.withColumn("closed", F.col("volume") >= bar_size)


def bar_state(bars: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state (BAR_STATE) after the bars of ``extend_bars``, from which the next trades go on."""
    done = strictly_increasing(bars.where("closed"), state).groupBy("instrument").agg(F.max("bar_seq").alias("_last"), F.max(F.expr(MICROS) - F.col("bar_seq")).alias("_lift"))
    forming = bars.where("not closed").drop("closed")
    found = forming.join(done, "instrument", "full")
    found = found.withColumn("bar_seq", F.coalesce("bar_seq", F.col("_last") + 1))
    before = lambda c: F.lit(None).cast("long") if state is None else F.col(c)
    if state is not None:
        found = found.join(state.select("instrument", F.col("bar_seq").alias("_seq"), F.col("lift").alias("_old")), "instrument", "full")
    return found.select(
        "instrument", F.coalesce("bar_seq", before("_seq")).alias("bar_seq"), "open", "high", "low", "close",
        F.coalesce("volume", F.lit(0)).alias("volume"), F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "close_ts", F.coalesce("_lift", before("_old")).alias("lift"),
    )


def volume_bars(trades: DataFrame, bar_size: int, state: DataFrame | None = None, grain: str = GRAIN) -> DataFrame:
    """Bars that close on the trade that takes their own volume to bar_size; no trade is split, the bar that
    is still forming is dropped, and close times increase strictly (ties move on by a microsecond)."""
    return strictly_increasing(extend_bars(trades, bar_size, state, grain).where("closed").drop("closed"), state)


MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', close_ts)"


def strictly_increasing(bars: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """close_ts moved to the least strictly increasing times: max over earlier bars of time plus distance."""
    w = Window.partitionBy("instrument").orderBy("bar_seq")
    lift = F.max(F.expr(MICROS) - F.col("bar_seq")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if state is not None:
        bars, lift = bars.join(state.select("instrument", "lift"), "instrument", "left"), F.greatest(lift, F.col("lift"))
    moved = F.timestamp_add("MICROSECOND", lift + F.col("bar_seq"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return bars.withColumn("close_ts", moved).drop("lift")


def choose_bar_size(trades: DataFrame, candidates: list[int], least_seconds: float, sessions: int = 5, grain: str = GRAIN) -> DataFrame:
    """(instrument, bar_size, median_seconds): the smallest candidate whose bars of regular hours in the first
    sessions take at least so many seconds at the median."""
    dated = trades.withColumn("_day", session_date(F.col("ts")))
    first = dated.groupBy("instrument", "_day").agg(F.count(F.lit(1)).alias("n"))
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("instrument").orderBy("_day"))).where(F.col("_k") <= sessions)
    part = dated.join(first.select("instrument", "_day"), ["instrument", "_day"], "left_semi").select("instrument", "ts", "seq", "size")
    spread, carry = _carried(part, candidates, grain)
    carried = carry.where("chunk is not null").groupBy(*CHUNK).agg(F.collect_list(F.struct("bar_size", "carried", "bar")).alias("sizes"))  # one for each candidate
    done = spread.join(carried, CHUNK).sortWithinPartitions(*CHUNK, *ORDER).mapInPandas(_closes, "instrument string, bar_size long, bar_seq long, ts timestamp_ntz")
    w = Window.partitionBy("instrument", "bar_size").orderBy("bar_seq")
    took = done.withColumn("s", F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 1e6).where(regular_hours(F.col("ts")) & F.col("s").isNotNull())
    medians = took.groupBy("instrument", "bar_size").agg(F.percentile("s", F.lit(0.5)).alias("median_seconds"))
    slow = medians.where(F.col("median_seconds") >= least_seconds)
    return slow.groupBy("instrument").agg(F.min("bar_size").alias("bar_size"), F.min_by("median_seconds", "bar_size").alias("median_seconds"))


def _closes(frames):
    """The trades that close a bar, for each candidate size."""
    for instrument, _, part in _chunk_parts(frames):
        sizes, ts, out = part["size"].to_numpy(np.int64), part["ts"].to_numpy(), []
        for c in part["sizes"].iat[0]:
            numbers, _, after = number_bars(sizes, int(c["carried"]), int(c["bar"]), int(c["bar_size"]))
            at = np.flatnonzero(np.append(numbers[1:], after) != numbers)
            out.append(pd.DataFrame({"instrument": instrument, "bar_size": int(c["bar_size"]), "bar_seq": numbers[at], "ts": ts[at]}))
        yield pd.concat(out)
