"""op13: all documents aligned between a byte-level and a sentence-piece vocabulary."""

from __future__ import annotations

import public_tokenizers

from .alignment import align_counted
from .common import Scratch


def op13_tokenizer_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = align_counted(docs, Scratch(spark, "align"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
SQL = {}
