"""op5: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch
from .secrets import scan


def op5_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, Scratch(spark, "secrets")).select("doc_id", "start", F.length("value").cast("long").alias("length"), F.md5(F.col("value").cast("binary")).alias("value_md5"), F.round("score", 4).alias("score"), "secret")


QUERIES = {"op5_secret_scan": op5_secret_scan}
SQL = {}
