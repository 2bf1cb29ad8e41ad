"""op2: personal data in all documents replaced by surrogates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch
from .pii import anonymise

#: The key of the registered query; a deployment keeps its own.
KEY = "surrogate-key"


def op2_pii_surrogates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return anonymise(docs, KEY, Scratch(spark, "pii")).select("doc_id", F.col("pii_count").alias("n_entities"), F.col("pii_text").alias("text"))


QUERIES = {"op2_pii_surrogates": op2_pii_surrogates}
SQL = {}
