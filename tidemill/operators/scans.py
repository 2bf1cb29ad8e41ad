"""Sorted scans with a bounded state for each instrument, where a rule depends on its own last outcome."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "instrument string, ts timestamp_ntz, seq long, price double"


def _carried(frames, width: int):
    """(instrument, frame, carry) of sorted frames cut by instrument; carry: up to width rows before the frame."""
    name, held = None, None
    for f in frames:
        names = f["instrument"].to_numpy()
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for lo, hi in zip(edges, edges[1:]):
            if lo < hi:
                part = f.iloc[lo:hi]
                held = part.iloc[:0] if names[lo] != name else held
                name = names[lo]
                yield name, part, held
                held = pd.concat([held, part]).iloc[-width:]


def lag_moments(rows: DataFrame, column: str, lags: range, order: str = "n") -> DataFrame:
    """(instrument, lag, n, mean, sd) of the differences of a column to its value ``lag`` rows before. The scan
    gives each batch's sums; Spark adds them up."""

    def run(frames):
        for name, part, carry in _carried(frames, lags.stop - 1):
            x, had = np.concatenate([carry[column], part[column]]), len(carry)
            diffs = [(k, x[max(had, k) :] - x[max(had - k, 0) : len(x) - k]) for k in lags if len(x) > max(had, k)]
            yield pd.DataFrame([(name, k, len(d), d.sum(), d @ d) for k, d in diffs], columns=["instrument", "lag", "n", "s", "ss"])

    kept = rows.select("instrument", order, column)
    sums = kept.repartition(F.struct("instrument")).sortWithinPartitions("instrument", order).mapInPandas(run, "instrument string, lag long, n long, s double, ss double")
    total = sums.groupBy("instrument", "lag").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    return total.select("instrument", "lag", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select("instrument", "ts", "seq", "price").repartition(F.struct("instrument")).sortWithinPartitions("instrument", "ts", "seq")


def sample_every(rows: DataFrame, seconds: float) -> DataFrame:
    """Rows at least so many seconds after the last row taken; the first is taken."""

    def run(frames):
        name, last = None, None
        for f in frames:
            take = []
            for instrument, at in zip(f["instrument"].tolist(), f["ts"].astype("datetime64[us]").astype("int64").tolist()):
                if instrument != name:
                    name, last = instrument, None
                take.append(last is None or at - last >= seconds * 1e6)
                last = at if take[-1] else last
            yield f[take]

    return _sorted(rows).mapInPandas(run, ROW)


def rule_trades(rows: DataFrame, *, enter: float = 30.0, stop: float = 20.0, take: float = 40.0) -> DataFrame:
    """(instrument, side, entry_seq, entry, exit_seq, exit, reason): a move of ``enter`` from the last price opens
    in its direction; a loss of ``stop`` or a gain of ``take`` closes. One position at a time; no orders."""

    def run(frames):
        name, last, held = None, None, None
        for f in frames:
            out = []
            for instrument, seq, price in zip(f["instrument"].tolist(), f["seq"].tolist(), f["price"].tolist()):
                if instrument != name:
                    name, last, held = instrument, None, None
                if held is not None:
                    gain = (price - held[2]) * held[0]
                    if gain <= -stop or gain >= take:
                        out.append((instrument, "long" if held[0] > 0 else "short", held[1], held[2], seq, price, "stop" if gain <= -stop else "take"))
                        held = None
                elif last is not None and abs(price - last) >= enter:
                    held = (1 if price > last else -1, seq, price)
                last = price
            yield pd.DataFrame(out, columns=["instrument", "side", "entry_seq", "entry", "exit_seq", "exit", "reason"])

    return _sorted(rows).mapInPandas(run, "instrument string, side string, entry_seq long, entry double, exit_seq long, exit double, reason string")
