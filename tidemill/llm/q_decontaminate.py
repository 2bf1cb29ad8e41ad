"""op8: benchmark passages in all documents."""

from __future__ import annotations

from .decontaminate import find_leaks


def op8_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), least_words=1)


QUERIES = {"op8_decontamination": op8_decontamination}
SQL = {}
