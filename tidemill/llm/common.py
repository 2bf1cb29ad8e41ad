"""Helpers shared by the corpus operators: shared scratch tables, word arrays and column hygiene."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task turns into word arrays at once.
SLICE_BYTES = 3 << 20


class Scratch:
    """Tables written once below the folder that ``spark.checkpoint.dir`` names, and read back.

    Writing cuts lineage and survives lost executors. Only where the setting is absent and
    Spark itself is local (tests) a local folder is chosen.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not root:
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.sparkContext.setCheckpointDir(root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *by: str, most: int = 0) -> DataFrame:
        """by: columns that give folders; most: rows of a file, 0 for any number."""
        write = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", most)
        (write.partitionBy(*by) if by else write).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: str = "4m"):
    """Within it, a batch of rows for Python ends with the row that exceeds limit. Spark holds a batch several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that a result column of the same name (in any case) replaces."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batches, column: str | int = 0, limit: int = SLICE_BYTES):
    """Record batches cut so that the text of each stays near ``limit`` bytes (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's words start (one entry more than texts), each word's number, the distinct words."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.not_equal(flat, "")
    if not pc.all(full, min_count=0).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, the same on every machine."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, distinct.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(distinct))
