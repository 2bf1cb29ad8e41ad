import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemill.llm.q_tokens import op6_token_output
from tidemill.llm.tokens import BYTE_LETTERS, Encoder, build_mph, find, find_slots, read_back, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(texts):
    return [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_whole_texts():
    texts = ["", None, " ", "  a  b ", " a", "a ", "\n x", "don't  you're", "a <|endoftext|> b", " \n ", "é 😀 x2", "x\n\ny z\t w", "١٢ ²a", "\x1c a", "a b " * 50, "Straße ÷× ÿ"]
    ids, n = Encoder(PATH, 2).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == whole(texts)
    assert len(set(BYTE_LETTERS.values())) == 256


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    sizes, bits = build_mph(keys)
    assert sorted(find_slots(keys, sizes, bits)) == list(range(len(keys)))
    assert build_mph(keys[:0])[0] == []


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, start = {}, 0
    for (i, _), ids in zip(docs, whole([t for _, t in docs])):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op6_token_output(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_odd_rows(odd, scratch, block):
    folder = scratch.path("out")
    write_tokens(odd, folder, PATH, block_tokens=block)
    got = read_back(odd.select("doc_id"), folder).collect()
    assert len(got) == 13
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:]))
    ids = {r.doc_id: r.token_ids for r in read_tokens(odd.select("doc_id"), folder).collect()}
    assert ids[3] == [2] and ids[1] == whole(["alpha beta gamma delta epsilon zeta"])[0]


def test_unknown_key_and_empty(spark, odd, none, scratch):
    write_tokens(odd, scratch.path("a"), PATH)
    assert find(spark.createDataFrame([(99,), (None,)], "doc_id long"), scratch.path("a")).count() == 0
    write_tokens(none, scratch.path("b"), PATH)
    assert read_back(none.select("doc_id"), scratch.path("b")).count() == 0


def test_encoder_on_mixed_pieces():
    bits = ["a", "the", "Thon", "é", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "'s", "'", "don't", ".", ",", "...", "(x)", "3.14", "Привет", "日本", " ", "\x85", "😀", "<|endoftext|>", "_", "É.", "à-", "ß", "µ"]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "\n", ""]) for _ in range(rng.integers(0, 14))) for _ in range(2000)]
    ids, n = Encoder(PATH, 2).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == whole(texts)


def test_one_id_over_many_blocks_and_large_ids(spark, scratch):
    rows = [(i, f"text number {k}") for i in (None, 5, 2**60 + 1) for k in range(60)] + [(2**60 + 2, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)  # a block closes after a batch
    write_tokens(docs, scratch.path("out"), PATH, block_tokens=1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in read_back(docs, scratch.path("out")).collect())
    assert len(got) == len(rows) and sum(n for *_, n in got) == sum(len(x) for x in whole([t for _, t in rows]))
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:])) and [i for _, i, _ in got] == [i for i, _ in rows]
    assert spark.read.parquet(scratch.path("out/starts")).count() > 20
    some = read_back(spark.createDataFrame([(5,)], "doc_id long"), scratch.path("out")).collect()
    assert sum(r.doc_id == 5 for r in some) == 60
