"""op7: near duplicates of all documents on two-word shingles."""

from __future__ import annotations

from .common import Scratch
from .near_dups import near_duplicates


def op7_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Scratch(spark, "near"), shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
SQL = {}
