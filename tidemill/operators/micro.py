"""Microstructure: volume-synchronised buckets, tick filters and conditioning."""

from __future__ import annotations


import json
import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vpin_buckets(trades: DataFrame, volume: int) -> DataFrame:
    """(instrument, bucket, buy, sell, close_ts): buckets of a fixed volume, trades split across them, trades of
    an unknown side split in halves; only full buckets. Sizes are whole numbers.

    A trade's place follows from a prefix sum, taken in two levels: day totals first, then trades in a day,
    so that no task sorts a whole instrument.
    """
    dated = trades.withColumn("_day", F.to_date("ts"))
    days = dated.groupBy("instrument", "_day").agg(F.sum("size").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy("instrument").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("instrument", "_day", earlier.alias("_before"))
    w = Window.partitionBy("instrument", "_day").orderBy("ts", "seq")
    placed = dated.join(days, ["instrument", "_day"]).withColumn("_cum", F.col("_before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.floor((F.col("_cum") - F.col("size")) / volume)
    last = F.floor((F.col("_cum") - 1) / volume)
    cut = placed.withColumn("bucket", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_cum") - F.col("size"), F.col("bucket") * volume)
    part = F.least("_cum", (F.col("bucket") + 1) * volume) - lo
    buy = F.when(F.col("side") == "B", part).when(F.col("side") == "A", 0.0).otherwise(part / 2)
    found = cut.withColumn("_part", part).withColumn("_buy", buy.cast("double")).groupBy("instrument", "bucket").agg(F.sum("_buy").alias("buy"), (F.sum("_part") - F.sum("_buy")).alias("sell"), F.sum("_part").alias("_v"), F.max("ts").alias("close_ts"))
    return found.where(F.col("_v") == volume).drop("_v")


def vpin(buckets: DataFrame, last: int = 50) -> DataFrame:
    """Mean imbalance of each instrument's last buckets."""
    newest = Window.partitionBy("instrument").orderBy(F.desc("bucket"))
    share = F.abs(F.col("buy") - F.col("sell")) / (F.col("buy") + F.col("sell"))
    return buckets.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last).groupBy("instrument").agg(F.avg(share).alias("vpin"), F.count(F.lit(1)).alias("n"))


def trailing_vpin(buckets: DataFrame, last: int = 50) -> DataFrame:
    """(instrument, bucket, close_ts, vpin): the mean imbalance of the last buckets up to each."""
    w = Window.partitionBy("instrument").orderBy("bucket").rowsBetween(-last + 1, 0)
    share = F.abs(F.col("buy") - F.col("sell")) / (F.col("buy") + F.col("sell"))
    return buckets.select("instrument", "bucket", "close_ts", F.avg(share).over(w).alias("vpin"))


TICKS = "instrument string, ts timestamp_ntz, seq long, price double, filtered double, spike boolean, level double, velocity double"


class TickState:
    """Spike filter and two-state Kalman filter of one instrument; plain values that can be kept and restored."""

    def __init__(self, memory: int = 50, least: int = 15, limit: float = 4.0, force: int = 5):
        self.memory, self.least, self.limit, self.force = memory, least, limit, force
        self.accepted: list[float] = []
        self.rejects, self.x, self.v, self.p, self.last = 0, None, 0.0, (1.0, 0.0, 1.0), None
        self._recount()

    def _recount(self) -> None:
        """The accepted prices in order, and their sums from a price among them; they follow from the prices, so they
        are no part of the state that is kept."""
        self.finite = all(map(math.isfinite, self.accepted))
        self.ordered = sorted(self.accepted) if self.finite else []
        self.origin = self.ordered[len(self.ordered) // 2] if self.ordered else 0.0
        away = [x - self.origin for x in self.accepted] if self.finite else []
        self.total, self.squares = math.fsum(away), math.fsum(x * x for x in away)
        self.error, self.age = 1e-12 * max([1e-300, *(x * x for x in away)]), 0

    def _is_far(self, price: float) -> tuple[bool, float]:
        """Whether a price is over ``limit`` deviations from the median, and the median. Running sums tell it where
        they are sure of it; near the limit, or where they cancel, the deviation is computed."""
        n = len(self.accepted)
        if self.finite:
            half = n // 2
            middle = self.ordered[half] if n % 2 else (self.ordered[half - 1] + self.ordered[half]) / 2
            variance, away = self.squares / n - (self.total / n) ** 2, abs(price - middle)
            if variance > 1e4 * self.error and variance > 1e-10:
                ratio = away / math.sqrt(variance)
                if not 0.999 * self.limit <= ratio <= 1.001 * self.limit:
                    return ratio > self.limit, middle
        else:
            middle = float(np.median(self.accepted))
        return abs(price - middle) / max(float(np.std(self.accepted)), 1e-6) > self.limit, middle

    def accept(self, price: float) -> tuple[bool, float]:
        """Whether the price is a spike, and the price to use; the fifth spike in a row is believed."""
        if len(self.accepted) >= self.least:
            far, middle = self._is_far(price)
            if far:
                self.rejects += 1
                if self.rejects < self.force:
                    return True, middle
        self.rejects, self.age = 0, self.age + 1
        gone = self.accepted.pop(0) if len(self.accepted) >= self.memory else None
        self.accepted.append(price)
        if self.age >= 256 or not (self.finite and math.isfinite(price)):
            self._recount()
            return False, price
        if gone is not None:
            del self.ordered[bisect_left(self.ordered, gone)]
            away = gone - self.origin
            self.total, self.squares = self.total - away, self.squares - away * away
        insort(self.ordered, price)
        away = price - self.origin
        self.total, self.squares = self.total + away, self.squares + away * away
        self.error = max(self.error, 1e-12 * away * away)
        return False, price

    def step(self, price: float, seconds: float, r: float = 1e-3, q: float = 1e-5) -> tuple[float, float]:
        """Level and velocity after a price, with closed forms for the two-by-two matrices."""
        if self.x is None:
            self.x, self.v = price, 0.0
            return self.x, self.v
        dt = seconds if seconds > 0 else 1e-4
        x, v = self.x + self.v * dt, self.v
        a, b, c = self.p
        a, b, c = a + 2 * dt * b + dt * dt * c + q * dt**3 / 3, b + dt * c + q * dt * dt / 2, c + q * dt
        gain, slope, rest, miss = a / (a + r), b / (a + r), r / (a + r), price - x
        self.x, self.v, self.p = x + gain * miss, v + slope * miss, (rest * a, rest * b, c - slope * b)
        return self.x, self.v

    def tick(self, price: float, at: float) -> tuple[float, bool, float, float]:
        spike, used = self.accept(price)
        level, velocity = self.step(used, 1.0 if self.last is None else at - self.last)
        self.last = at
        return used, spike, level, velocity


    def export(self) -> str:
        """All of the state as JSON; ``restore`` goes on exactly from it."""
        return json.dumps([self.accepted, self.rejects, self.x, self.v, self.p, self.last])

    @classmethod
    def restore(cls, kept: str) -> TickState:
        state = cls()
        state.accepted, state.rejects, state.x, state.v, p, state.last = json.loads(kept)
        state.p = tuple(p)
        state._recount()
        return state


def _resumed(rows: DataFrame, states: DataFrame | None) -> DataFrame:
    """rows by instrument in order, each instrument's state (instrument, state) before its first row. They are dealt
    out by a struct: after a join by instrument Spark would leave this shuffle out, and where that join becomes a
    broadcast as it runs, an instrument is read in parts by several tasks, each of which would scan by itself."""
    named = rows.withColumn("state", F.lit(None).cast("string"))
    if states is not None:
        named = named.unionByName(states.select("instrument", "state"), allowMissingColumns=True)
    return named.repartition(F.struct("instrument")).sortWithinPartitions("instrument", F.col("ts").asc_nulls_first(), "seq")


def _scan(start, each, columns: list[str]):
    """A scan of sorted rows that goes on from states. start(state or None) gives what an instrument's scan
    holds, each(held, row) a tuple of results or None; a last row of each instrument has only its state."""

    def run(frames):
        name, held = None, None
        ended = lambda: [] if held is None else [(name, *[None] * (len(columns) - 2), held.export())]
        for f in frames:
            out, at = [], f["ts"].astype("datetime64[us]").astype("int64").tolist()
            for row, t in zip(f.itertuples(index=False), at):
                if row.instrument != name:
                    out += ended()
                    name, held = row.instrument, start(row.state)
                    if row.state is not None:
                        continue
                found = each(held, row, t)
                if found is not None:
                    out.append((*found, None))
            yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in columns if c in WHOLE})
        yield pd.DataFrame(ended(), columns=columns).astype({c: "Int64" for c in columns if c in WHOLE})

    return run


WHOLE = ("seq", "bid_sz", "ask_sz", "n_orders")


def _runs(frames):
    """(instrument, frame) of sorted frames, cut where the instrument changes."""
    for f in frames:
        names = f["instrument"].to_numpy()
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for lo, hi in zip(edges, edges[1:]):
            if lo < hi:
                yield names[lo], f.iloc[lo:hi]


def _tick_scan(frames):
    columns = [c.split()[0] for c in TICKS.split(", ")] + ["state"]
    name, held = None, None
    ended = lambda: pd.DataFrame([] if held is None else [(name, *[None] * (len(columns) - 2), held.export())], columns=columns).astype({"seq": "Int64"})
    for instrument, f in _runs(frames):
        if held is None or instrument != name:
            yield ended()
            kept = f["state"].iloc[0]
            name, held = instrument, TickState() if kept is None else TickState.restore(kept)
            f = f if kept is None else f.iloc[1:]
        tick, seconds = held.tick, f["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        found = [tick(price, at) for price, at in zip(f["price"].astype(float).tolist(), seconds.tolist())]
        cells = pd.DataFrame(found, columns=columns[4:8], index=f.index)
        yield pd.concat([f[columns[:4]], cells], axis=1).astype({"seq": "Int64"}).assign(state=None)
    yield ended()


def scan_ticks(ticks: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """TICKS and state: the rows of ``condition_ticks`` from the states on, with a null state, and for each
    instrument a row with nothing but the state after its last tick."""
    return _resumed(ticks.select("instrument", "ts", "seq", "price"), states).mapInPandas(_tick_scan, TICKS + ", state string")


def condition_ticks(ticks: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Ticks with the filtered price, whether they are spikes, and the Kalman level and velocity: a sorted scan
    with a bounded state for each instrument, from the states (``tick_states``) of the ticks before."""
    return scan_ticks(ticks, states).where("state is null").drop("state")


def tick_states(ticks: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(instrument, state) after the ticks; an instrument without ticks keeps its state."""
    return scan_ticks(ticks, states).where("state is not null").select("instrument", "state")


CLIP = {"high_vol_choppy": 3.5, "high_vol_crash": 5.0, "low_vol": 2.5}


def tick_returns(conditioned: DataFrame, scale: float | str, regime: str | None = None, *, fixed: str = "high_vol_choppy") -> DataFrame:
    """The level's return on a scale of at least 1e-4, clipped by regime (3.5 for one that isn't known). scale is
    a number or a column, regime a column of each row's regime; without one all rows have the fixed one."""
    w = Window.partitionBy("instrument").orderBy("ts", "seq")
    name = F.lit(fixed) if regime is None else F.col(regime)
    most = F.coalesce(F.create_map(*[F.lit(x) for pair in CLIP.items() for x in pair])[name], F.lit(3.5))
    size = F.greatest(F.col(scale) if isinstance(scale, str) else F.lit(scale), F.lit(1e-4))
    raw = (F.col("level") / F.lag("level").over(w) - 1) / size
    return conditioned.withColumn("scaled_return", F.greatest(-most, F.least(most, F.coalesce(raw, F.lit(0.0)))))


MESSAGE = "action string, side string, order_id long, price double, size long"


def book_records(lines: DataFrame) -> DataFrame:
    """Book records (ts and MESSAGE) of JSON texts (ts, value); what doesn't parse or has no known action is left out."""
    rows = lines.select("ts", F.from_json("value", MESSAGE).alias("m")).select("ts", "m.*")
    return rows.where("action in ('A', 'C', 'M', 'F', 'R', 'T')")


def book_levels(orders: DataFrame, depth: int = 10) -> DataFrame:
    """The best levels of each side: (instrument, snap, side, price, size, level)."""
    sums = orders.groupBy("instrument", "snap", "side", "price").agg(F.sum("size").alias("size"))
    best = Window.partitionBy("instrument", "snap", "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    return sums.withColumn("level", F.row_number().over(best)).where(F.col("level") <= depth)


def book_snapshots(levels: DataFrame) -> DataFrame:
    """Best prices, and the imbalance of the best level and of all levels; null if a side is empty."""
    at = lambda side, c: F.max(F.when((F.col("side") == side) & (F.col("level") == 1), F.col(c)))
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("size")))
    found = levels.groupBy("instrument", "snap").agg(
        at("B", "price").alias("bid_px"), at("A", "price").alias("ask_px"), at("B", "size").alias("_b1"), at("A", "size").alias("_a1"), total("B").alias("_b"), total("A").alias("_a"),
    )
    return found.select("instrument", "snap", "bid_px", "ask_px", ((F.col("_b1") - F.col("_a1")) / (F.col("_b1") + F.col("_a1"))).alias("imbalance_l1"), ((F.col("_b") - F.col("_a")) / (F.col("_b") + F.col("_a"))).alias("imbalance_depth"))


SNAP = "instrument string, ts timestamp_ntz, seq long, bid_px double, ask_px double, bid_sz long, ask_sz long, imbalance_l1 double, imbalance_depth double, n_orders long"


class Book:
    """Resting orders of one instrument by id: (side, price, size)."""

    def __init__(self):
        self.orders: dict[int, tuple[str, float, int]] = {}

    def apply(self, action: str, side: str, order_id: int, price: float, size: int) -> None:
        """A adds, M changes (an unknown order is added if it tells its side), F takes off what was filled, C
        removes, R clears all."""
        known = self.orders.get(order_id)
        if action == "R":
            self.orders.clear()
        elif action == "C":
            self.orders.pop(order_id, None)
        elif action in ("A", "M"):
            own = side if side in ("A", "B") else known[0] if known and action == "M" else None
            if own:
                self.orders[order_id] = (own, price, size)
        elif action == "F" and known:
            if known[2] > size:
                self.orders[order_id] = (known[0], known[1], known[2] - size)
            else:
                del self.orders[order_id]

    def snapshot(self, depth: int = 10) -> tuple:
        """Best prices and sizes, imbalance of the best level and of the best ``depth`` levels, number of orders;
        null where a side is empty."""
        levels: dict[str, dict[float, int]] = {"B": {}, "A": {}}
        for side, price, size in self.orders.values():
            levels[side][price] = levels[side].get(price, 0) + size
        bids = sorted(levels["B"].items(), reverse=True)[:depth]
        asks = sorted(levels["A"].items())[:depth]
        if not bids or not asks:
            best = [side[0] if side else (None, None) for side in (bids, asks)]
            return best[0][0], best[1][0], best[0][1], best[1][1], None, None, len(self.orders)
        b, a, bd, ad = bids[0][1], asks[0][1], sum(s for _, s in bids), sum(s for _, s in asks)
        return bids[0][0], asks[0][0], b, a, (b - a) / (b + a) if b + a else None, (bd - ad) / (bd + ad) if bd + ad else None, len(self.orders)


class BookScan(Book):
    """A book that is sampled at the first record at least ``every`` seconds after the last sample."""

    def __init__(self, every: float, depth: int, kept: str | None = None):
        super().__init__()
        self.every, self.depth, self.last = every * 1e6, depth, None
        if kept is not None:
            orders, self.last = json.loads(kept)
            self.orders = {k: tuple(order) for k, *order in orders}

    def export(self) -> str:
        return json.dumps([[[k, *order] for k, order in self.orders.items()], self.last])

    def record(self, r, t: int) -> tuple | None:
        self.apply(r.action, r.side, int(r.order_id), float(r.price), int(r.size))
        if self.last is not None and t - self.last < self.every:
            return None
        self.last = t
        return (r.instrument, r.ts, r.seq, *self.snapshot(self.depth))


def scan_book(records: DataFrame, every: float = 1.0, depth: int = 10, states: DataFrame | None = None) -> DataFrame:
    """SNAP and state: the rows of ``replay_book`` from the states on, with a null state, and for each
    instrument a row with nothing but the orders that rest after its last record."""
    rows = records.select("instrument", "ts", "seq", "action", "side", "order_id", "price", "size")
    run = _scan(lambda kept: BookScan(every, depth, kept), BookScan.record, [c.split()[0] for c in SNAP.split(", ")] + ["state"])
    return _resumed(rows, states).mapInPandas(run, SNAP + ", state string")


def replay_book(records: DataFrame, every: float = 1.0, depth: int = 10, states: DataFrame | None = None) -> DataFrame:
    """The book of each instrument after its records (instrument, ts, seq, action, side, order_id, price, size)
    in order, sampled at the first record at least so many seconds after the last sample. A sorted scan; its
    state is the orders that rest, and it goes on from the states (``book_states``) of the records before. Pass
    instrument and day as the key where each day opens with a snapshot. ``book.book_at`` has no scan."""
    return scan_book(records, every, depth, states).where("state is null").drop("state")


def book_states(records: DataFrame, every: float = 1.0, depth: int = 10, states: DataFrame | None = None) -> DataFrame:
    """(instrument, state) after the records; an instrument without records keeps its state."""
    return scan_book(records, every, depth, states).where("state is not null").select("instrument", "state")
