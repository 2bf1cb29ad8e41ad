"""op11: near duplicates of all documents by SimHash fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch
from .simhash import simhash_duplicates


def op11_simhash_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash_duplicates(docs, Scratch(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op11_simhash_duplicates": op11_simhash_duplicates}
SQL = {}
