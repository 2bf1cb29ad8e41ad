import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_near_dups import brute
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm.q_mixing import MIX_SQL


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "token_output" or docs.columns == columns
        kept[name] = docs.toPandas()
    toxic, near, clean, mixed, tokens = kept.values()

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    everything = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    gone = set(everything) - set(toxic.doc_id)
    assert sum(labels.get(i, 1) == 0 for i in gone) <= 3

    groups = brute(list(zip(toxic.doc_id, toxic.text)), 5)
    assert sorted(near.doc_id) == sorted(i for i, (n, c) in groups.items() if i == c)

    items = [f" {' '.join(r.text.lower().split())} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i, t in zip(near.doc_id, near.text) if any(x in f" {' '.join(t.lower().split())} " for x in items)}
    assert not leaks & set(clean.doc_id) and len(set(near.doc_id) - set(clean.doc_id) - leaks) <= 2

    con = duckdb.connect()
    con.register("clean", clean)
    want = con.execute("WITH " + MIX_SQL.format(docs="clean") + "SELECT doc_id, copies FROM mixed WHERE copies > 0").df()
    assert mixed.doc_id.value_counts().sort_index().to_dict() == dict(zip(want.doc_id, want.copies)) == dict(sorted(zip(want.doc_id, want.copies)))

    order = mixed.sort_values("doc_id")
    tokenizer, at, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in zip(order.doc_id, order.text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens[["doc_id", "start", "n_tokens", "ids_crc32"]].to_numpy().tolist())) == sorted(expected)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_and_empty_tables(spark, request, rows, tmp_path):
    table = request.getfixturevalue(rows)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage in these texts at all"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(out) > 0) == (rows == "odd")
