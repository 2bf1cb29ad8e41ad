"""Table functions for SQL text: walk-forward splits, splits by lags, and buckets of a fixed volume.

``register(spark)`` makes them known to a session as ``walk_splits``, ``split_lags`` and ``volume_buckets``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SPLIT = "origin int, train_start int, train_stop int, test_start int, test_stop int, refit_origin int"


def splits_of(length: int, horizon: int, min_train: int, step: int, embargo: int, refit_every: int = 21):
    """Half-open train and test ranges of a series of so many rows, with the origin whose fit each uses."""
    first = min_train - 1 + embargo
    for k, origin in enumerate(range(first, length - horizon, step)):
        if origin + 1 - embargo >= min_train:
            yield origin, 0, origin + 1 - embargo, origin + 1, origin + 1 + horizon, first + step * (k - k % refit_every)


@udtf(returnType=SPLIT)
class WalkSplits:
    """walk_splits(length, horizon, min_train, step, embargo)"""

    def eval(self, length: int, horizon: int, min_train: int, step: int, embargo: int):
        yield from splits_of(length, horizon, min_train, step, embargo)


@udtf(returnType=SPLIT + ", lag int")
class SplitLags:
    """split_lags(length, horizon, min_train, step, embargo, lags): every split with each lag from 1 on."""

    def eval(self, length: int, horizon: int, min_train: int, step: int, embargo: int, lags: int):
        for split in splits_of(length, horizon, min_train, step, embargo):
            for lag in range(1, lags + 1):
                yield *split, lag


@udtf(returnType="instrument string, bucket long, buy double, sell double, close_ts timestamp_ntz")
class VolumeBuckets:
    """volume_buckets(TABLE(trades) PARTITION BY instrument ORDER BY (ts, seq), volume): full buckets; a trade is
    split across them, one of an unknown side in halves. A partition's state is two numbers."""

    def __init__(self):
        self.total, self.buy = 0, 0.0

    def eval(self, row, volume: int):
        left, share = int(row["size"]), {"B": 1.0, "A": 0.0}.get(row["side"], 0.5)
        while left:
            part = min(left, volume - self.total % volume)
            self.total, self.buy, left = self.total + part, self.buy + part * share, left - part
            if self.total % volume == 0:
                ts: dt.datetime = row["ts"]
                yield row["instrument"], self.total // volume - 1, self.buy, volume - self.buy, ts
                self.buy = 0.0


def register(spark: SparkSession) -> None:
    for name, function in (("walk_splits", WalkSplits), ("split_lags", SplitLags), ("volume_buckets", VolumeBuckets)):
        spark.udtf.register(name, function)
