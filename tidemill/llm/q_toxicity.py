"""op4: every document scored for toxicity by a lexicon learned from the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch
from .toxicity import fit, held_out, score_column


def learned(spark, docs, sf_dir):
    """The lexicon from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    return fit(docs, labels, Scratch(spark, "toxicity"))


def op4_toxicity(spark, sf_dir):
    """(doc_id, held_out, score, predicted) of every row; a row without an id is never held out, and no label is its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(learned(spark, docs, sf_dir))["score"].alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL = {}
