"""The order book on a stream: orders and levels are map state, so a message touches two entries.

An order's and a level's entry are read when a message needs them and written once a micro-batch if they have
changed; nothing else of the state is rewritten. A book without messages for ``idle`` is dropped by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .states import fresh_rows, micros

TOP = "instrument string, ts timestamp, seq long, bid_px double, ask_px double, bid_sz long, ask_sz long, imbalance_l1 double, imbalance_depth double, n_orders long"
START = (-(1 << 62), -1, None, 0)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def map_states(spark: SparkSession):
    """Streams that start here keep their state in RocksDB, which map state and timers need."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


class _Entries:
    """Entries of a map state that one micro-batch has read or changed."""

    def __init__(self, state, whole: bool = False):
        self.state, self.changed = state, set()
        self.held = dict(state.iterator()) if whole else {}

    def get(self, key: tuple):
        if key not in self.held:
            self.held[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.held[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.held[key] = value
        self.changed.add(key)

    def clear(self) -> None:
        self.state.clear()
        self.held, self.changed = {}, set()

    def write(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue(key, self.held[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)


class BookProcessor(StatefulProcessor):
    """Keeps a book and samples it at the first message at least ``every`` seconds after the last sample."""

    def __init__(self, every: float, depth: int, idle: float):
        self.every, self.depth, self.idle = int(every * 1e6), depth, int(idle * 1e3)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("orders", "order_id long", "side string, price double, size long")
        self.levels = handle.getMapState("levels", "side string, price double", "size long, orders long")
        self.mark = handle.getValueState("mark", "ts long, seq long, sample long, n_orders long")

    def _level(self, levels: _Entries, order: tuple, sign: int) -> None:
        size, n = levels.get(order[:2]) or (0, 0)
        levels.put(order[:2], (size + sign * order[2], n + sign) if n + sign else None)

    def _apply(self, orders: _Entries, levels: _Entries, action: str, side, order_id: int, price: float, size: int) -> int | None:
        """The change of the number of orders; None if all are gone."""
        if action == "R":
            orders.clear()
            levels.clear()
            return None
        if action not in ("A", "M", "C", "F"):
            return 0
        old, key, new = orders.get((order_id,)), (order_id,), None
        old = old and tuple(old)
        if action in ("A", "M"):
            own = side if side in ("A", "B") else old[0] if old and action == "M" else None
            if own is None:
                return 0
            new = (own, price, size)
        elif action == "F":
            if old is None:
                return 0
            new = (*old[:2], old[2] - size) if old[2] > size else None
        if old:
            self._level(levels, old, -1)
        if new:
            self._level(levels, new, 1)
        if old or new:
            orders.put(key, new)
        return bool(new) - bool(old)

    def _sample(self, levels: _Entries) -> tuple:
        sides = [[(p, v[0]) for (s, p), v in levels.held.items() if s == side and v is not None] for side in "BA"]
        bids, asks = sorted(sides[0], reverse=True)[: self.depth], sorted(sides[1])[: self.depth]
        best = [side[0] if side else (None, None) for side in (bids, asks)]
        share = lambda b, a: (b - a) / (b + a) if b + a else None
        both = (share(bids[0][1], asks[0][1]), share(sum(v for _, v in bids), sum(v for _, v in asks))) if bids and asks else (None, None)
        return best[0][0], best[1][0], best[0][1], best[1][1], *both

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_ts, last_seq, sample, n = self.mark.get() if self.mark.exists() else START
        orders, levels, out = _Entries(self.orders), _Entries(self.levels, whole=True), []
        new = fresh_rows(rows, (last_ts, last_seq))
        for ts, at, seq, *message in zip(new["ts"], micros(new["ts"]).tolist(), new["seq"], new["action"], new["side"], new["order_id"], new["price"], new["size"]):
            change = self._apply(orders, levels, *message)
            n, last_ts, last_seq = 0 if change is None else n + change, at, int(seq)
            if sample is None or at - sample >= self.every:
                sample = at
                out.append((key[0], ts, seq, *self._sample(levels), n))
        orders.write()
        levels.write()
        if len(new):
            self.mark.update((last_ts, last_seq, sample, n))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last_ts // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOP.split(", ")]).astype({"bid_sz": "Int64", "ask_sz": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.orders, self.levels, self.mark):
            state.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in TOP.split(", ")])

    def close(self) -> None:
        pass


def book_stream(messages: DataFrame, every: float = 1.0, depth: int = 10, idle: float = 86_400.0, lateness: str = "20 minutes") -> DataFrame:
    """Samples of each instrument's book from a stream of messages (instrument, ts, seq, action, side, order_id,
    price, size) that come in order: as ``replay_book`` gives them. Messages at or before the last one seen
    come twice and are skipped. Start it within ``map_states``."""
    rows = messages.select("instrument", F.col("ts").cast("timestamp").alias("ts"), "seq", "action", "side", "order_id", "price", "size").withWatermark("ts", lateness)
    found = rows.groupBy("instrument").transformWithStateInPandas(BookProcessor(every, depth, idle), TOP, "append", "EventTime")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
