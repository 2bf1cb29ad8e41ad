"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. ``run`` applies them to documents.

Each stage takes null ids, texts and sources, empty and very long texts, repeated rows, empty tables and
further columns, as the operator it calls describes; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch
from tidemill.llm.decontaminate import without_leaks
from tidemill.llm.mixing import mix
from tidemill.llm.near_dups import keep_one
from tidemill.llm.q_toxicity import learned
from tidemill.llm.tokens import read_back, write_tokens
from tidemill.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels that are not held out, scores below a half."""
    return reject_toxic(docs, learned(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id."""
    return keep_one(docs, Scratch(spark, "near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), least_words=1)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix to the sources' target weights takes it."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the written token files."""
    folder = Scratch(spark, "tokens").path("out")
    write_tokens(docs.select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_back(docs.select("doc_id"), folder)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Learned scores, similarity joins and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
