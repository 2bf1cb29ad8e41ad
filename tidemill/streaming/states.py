"""Streams with a bounded state for each instrument: conditioned returns, volume buckets, conditioned ticks.

Rows at or before an instrument's high-water mark (time, sequence) have been counted or come late; they are
skipped. A row that is still waited for must come in a file of its turn: sources that deliver out of order are
read through ``in_order``, which holds rows back until the watermark has passed them. All state is plain
numbers in the checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.micro import TickState

MARK = "last_ts long, last_seq long"
START = (-(1 << 62), -1)


def micros(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


def fresh_rows(batches, mark: tuple[int, int]) -> pd.DataFrame:
    """The rows of one trigger after the mark in order of (ts, seq), each sequence once, without their instrument.
    Spark gives a trigger's rows of a key in batches; the source bounds a trigger (``replayed`` does for a table)."""
    parts = []
    for f in batches:
        at = micros(f["ts"])
        parts.append(f[(at > mark[0]) | ((at == mark[0]) & (f["seq"] > mark[1]).to_numpy())].drop(columns="instrument"))
    rows = pd.concat(parts, ignore_index=True)
    del parts
    return rows.sort_values(["ts", "seq"], ignore_index=True).drop_duplicates(["ts", "seq"])


def slices(rows, size: int = 4096):
    """rows in slices, one empty slice if there are none: results go out before the next ones are made."""
    return (rows[k : k + size] for k in range(0, max(len(rows), 1), size))


def _mark(rows: pd.DataFrame, mark):
    return (int(micros(rows["ts"])[-1]), int(rows["seq"].iloc[-1])) if len(rows) else mark


CONDITIONED = "instrument string, ts timestamp_ntz, seq long, ret double, sigma double, scaled double"


def _deviations(known: np.ndarray, before: np.ndarray, window: int, least: int) -> np.ndarray:
    """The deviation of the ``window`` values of known before each place, NaN where there are under ``least``."""
    found = np.full(len(before), np.nan)
    full = before >= max(window, least)
    if full.any():
        views = np.lib.stride_tricks.sliding_window_view(known, window)
        found[full] = np.std(np.ascontiguousarray(views[before[full] - window]), axis=1, ddof=1)
    for k in np.flatnonzero(~full & (before >= least)):
        found[k] = np.std(known[max(0, before[k] - window) : before[k]], ddof=1)
    return found


def _condition(window: int, least: int):
    def run(key, batches, state):
        close, ring, last_ts, last_seq = state.get if state.exists else (None, "[]", *START)
        past, fresh = np.array(json.loads(ring), float), fresh_rows(batches, (last_ts, last_seq))
        for rows in slices(fresh):
            prices = rows["price"].to_numpy(float)
            before = np.concatenate([[np.nan if close is None else close], prices[:-1]]) if len(prices) else prices
            ret = np.log(prices) - np.log(before)
            is_known = ~np.isnan(ret)
            known = np.concatenate([past, ret[is_known]])
            sigma = _deviations(known, len(past) + np.cumsum(is_known) - is_known, window, least)
            close, past = float(prices[-1]) if len(prices) else close, known[-window:]
            with np.errstate(divide="ignore", invalid="ignore"):
                scaled = np.where(sigma > 0, ret / sigma, np.nan)
            yield pd.DataFrame({"instrument": key[0], "ts": rows["ts"], "seq": rows["seq"], "ret": ret, "sigma": sigma, "scaled": scaled})
        state.update((close, json.dumps(past.tolist()), *_mark(fresh, (last_ts, last_seq))))

    return run


def condition_stream(prices: DataFrame, window: int = 256, least: int = 64) -> DataFrame:
    """Each price's log return, the deviation of the ``window`` returns before it, and their ratio."""
    rows = prices.select("instrument", "ts", "seq", "price")
    return rows.groupBy("instrument").applyInPandasWithState(_condition(window, least), CONDITIONED, f"close double, ring string, {MARK}", "append", "NoTimeout")


BUCKETS = "instrument string, bucket long, buy double, sell double, close_ts timestamp_ntz"


def _buckets(volume: int):
    def run(key, batches, state):
        total, buy, last_ts, last_seq = state.get if state.exists else (0, 0.0, *START)
        rows = fresh_rows(batches, (last_ts, last_seq))
        size = rows["size"].to_numpy(np.int64)
        share = np.where(rows["side"] == "B", 1.0, np.where(rows["side"] == "A", 0.0, 0.5))
        ends = total + np.cumsum(size)
        bought = buy + np.cumsum(size * share)  # since the forming bucket began
        closed = np.arange(total // volume, (ends[-1] if len(ends) else total) // volume)
        at = np.searchsorted(ends, (closed + 1) * volume)  # the trade that fills each bucket
        level = bought[at] - (ends[at] - (closed + 1) * volume) * share[at] if len(closed) else np.zeros(0)
        filled = np.diff(level, prepend=0.0)
        if len(ends):
            total, buy = int(ends[-1]), float(bought[-1] - (level[-1] if len(level) else 0.0))
        state.update((total, buy, *_mark(rows, (last_ts, last_seq))))
        yield pd.DataFrame({"instrument": key[0], "bucket": closed.astype("int64"), "buy": filled, "sell": volume - filled, "close_ts": rows["ts"].to_numpy()[at] if len(closed) else pd.Series([], dtype="datetime64[us]")})

    return run


def bucket_stream(trades: DataFrame, volume: int) -> DataFrame:
    """Full volume buckets as their last trade comes; a partly filled bucket is state and isn't lost on a
    restart. A trade is split across buckets, one of an unknown side in halves."""
    rows = trades.select("instrument", "ts", "seq", "size", "side")
    return rows.groupBy("instrument").applyInPandasWithState(_buckets(volume), BUCKETS, f"total long, buy double, {MARK}", "append", "NoTimeout")


TICKS = "instrument string, ts timestamp_ntz, seq long, price double, filtered double, spike boolean, level double, velocity double"


def _ticks(key, batches, state):
    kept, last_ts, last_seq = state.get if state.exists else (None, *START)
    engine = TickState.restore(kept) if kept else TickState()
    fresh = fresh_rows(batches, (last_ts, last_seq))
    for rows in slices(fresh):
        seconds = rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9
        found = [engine.tick(p, s) for p, s in zip(rows["price"].astype(float).tolist(), seconds.tolist())]
        cells = pd.DataFrame(found, columns=["filtered", "spike", "level", "velocity"], index=rows.index)
        yield pd.concat([rows[["ts", "seq", "price"]].assign(instrument=key[0]), cells], axis=1)
    state.update((engine.export(), *_mark(fresh, (last_ts, last_seq))))


def tick_stream(ticks: DataFrame) -> DataFrame:
    """Ticks with filtered price, spike, level and velocity; filter and estimate are exported to the state."""
    rows = ticks.select("instrument", "ts", "seq", "price")
    return rows.groupBy("instrument").applyInPandasWithState(_ticks, TICKS, f"engine string, {MARK}", "append", "NoTimeout")


HELD = "rows binary"


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _release(columns: list[str]):
    def run(key, batches, state):
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_all()] if state.exists else []
        parts += [pa.Table.from_pandas(f[columns].assign(ts=micros(f["ts"])), preserve_index=False).replace_schema_metadata() for f in batches]
        held = pa.concat_tables(parts, promote_options="permissive") if parts else pa.table({c: [] for c in [*columns, "ts"]})
        del parts
        limit = state.getCurrentWatermarkMs() * 1000
        is_ready = pc.less_equal(held["ts"].cast(pa.int64()), limit)
        ready, rest = held.filter(is_ready), held.filter(pc.invert(is_ready))
        del held
        if len(rest):
            state.update((_packed(rest),))
            state.setTimeoutTimestamp(max(pc.min(rest["ts"]).as_py() // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        order = pc.sort_indices(ready, sort_keys=[("ts", "ascending")])
        for k in range(0, max(len(order), 1), 4096):
            out = ready.take(order[k : k + 4096]).to_pandas()
            yield out.assign(instrument=key[0], ts=pd.to_datetime(out["ts"], unit="us"))

    return run


def in_order(stream: DataFrame, lateness: str = "20 minutes", columns: str = "seq long, price double, size long, side string") -> DataFrame:
    """Rows released in order of time once the watermark has passed them; later ones are dropped by Spark,
    which counts them. What is held is bounded by the lateness."""
    names = [c.split()[0] for c in columns.split(", ")]
    rows = stream.select("instrument", F.col("ts").cast("timestamp").alias("ts"), *names).withWatermark("ts", lateness)
    return rows.groupBy("instrument").applyInPandasWithState(_release(names), f"instrument string, ts timestamp, {columns}", HELD, "append", "EventTimeTimeout")
