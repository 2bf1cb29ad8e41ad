"""Keyed tables that streams write exactly once.

Every micro-batch writes its rows under its epoch; an epoch that is repeated after a failure replaces itself.
A read takes the newest row of each key. ``compact`` merges what has been written so far into a base, and from
then on epochs up to it are not read, whether or not their files are still there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """One row for each key: that of the highest ``order`` columns; of equal ones, of the latest epoch."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, keys: list[str], order: list[str]):
        self.spark, self.folder, self.keys, self.order = spark, folder.rstrip("/"), keys, order
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _stored(self) -> tuple[int, list[int]]:
        """The last epoch of the newest base that is complete, and the epochs after it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        done = {kind: sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}=(\d+)", n)) and files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))) for kind in ("base", "epoch")}
        base = done["base"][-1] if done["base"] else -1
        return base, [e for e in done["epoch"] if e > base]

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [c for c in self.schema.names if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*names), F.struct(*self.order, "_epoch")).alias("_row"), F.max("_epoch").alias("_epoch"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in self.schema.names], "_epoch")

    def merge(self, rows: DataFrame, epoch: int) -> None:
        """Writes a micro-batch; as the function of foreachBatch. Rows of one key in it are merged first."""
        part = self._newest(rows.select(*self.schema.names).withColumn("_epoch", F.lit(epoch).cast("long")))
        part.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def _all(self) -> tuple[DataFrame, int, list[int]]:
        base, epochs = self._stored()
        paths = ([f"{self.folder}/base={base}"] if base >= 0 else []) + [f"{self.folder}/epoch={e}" for e in epochs]
        full = T.StructType([*self.schema.fields, T.StructField("_epoch", T.LongType())])
        rows = self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)
        return rows, base, epochs

    def read(self) -> DataFrame:
        return self._newest(self._all()[0]).drop("_epoch")

    def compact(self) -> None:
        """Merges the base and all epochs after it; readers see either the old files or the new base."""
        rows, _, epochs = self._all()
        if epochs:
            self._newest(rows).write.mode("overwrite").parquet(f"{self.folder}/base={epochs[-1]}")

    def epochs(self) -> list[int]:
        """The epochs that a read takes by themselves, after the base."""
        return self._stored()[1]


def write_keyed(stream: DataFrame, table: KeyedTable, checkpoint: str, *, unique: list[str] | None = None, lateness: str = "20 minutes", compact_every: int = 64) -> None:
    """Runs a stream over all that is there into a keyed table. With unique, rows equal in these columns and
    within the lateness of column ts are taken once, whichever micro-batch brings them again."""
    if unique:
        stream = stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(unique)

    def write(rows: DataFrame, epoch: int) -> None:
        table.merge(rows, epoch)
        if epoch % compact_every == compact_every - 1:
            table.compact()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
