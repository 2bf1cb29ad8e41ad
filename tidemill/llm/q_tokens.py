"""op6: all documents encoded, written in the block format and read back through the index."""

from __future__ import annotations

import public_tokenizers

from .common import Scratch
from .tokens import read_back, write_tokens


def op6_token_output(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = Scratch(spark, "tokens").path("out")
    write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_back(docs.select("doc_id"), folder)


QUERIES = {"op6_token_output": op6_token_output}
SQL = {}
