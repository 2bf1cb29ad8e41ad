"""op10: repeated 400-byte strings removed from all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch
from .repeats import remove_repeats


def op10_repeated_substrings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = remove_repeats(docs, Scratch(spark, "repeats"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    return cut.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_repeated_substrings": op10_repeated_substrings}
SQL = {}
