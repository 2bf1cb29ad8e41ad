"""Tokenizer alignment against direct encoding of whole texts."""

import hashlib
import random
import time
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import alignment as L
from tidemill.llm.common import Scratch
from tidemill.llm.q_alignment import op13_tokenizer_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B), L.a_bytes(A), L.b_bytes(B)


def whole(text, tools):
    """(ids of A, ids of B, groups as text, links) of a text encoded in one go, by comparing byte ranges."""
    t, s, a_of, b_of = tools
    if not text:
        return [], [], "", []
    a, b, raw = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text), (" " + text).encode()
    if b"".join(a_of[i] for i in a) != raw or b"".join(b_of[i] for i in b) != raw:
        return [], [], "", []
    groups, links, x, y, ga, gb = [], [], 0, 0, [], []
    i = j = 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a) and not (x == y and ga and gb):
            x, ga, i = x + len(a_of[a[i]]), [*ga, a[i]], i + 1
        else:
            y, gb, j = y + len(b_of[b[j]]), [*gb, b[j]], j + 1
        if x == y and ga and gb:
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.append((ga[-1], gb[-1]))
            ga, gb = [], []
    return a, b, ";".join(groups), links


def expected(rows, tools):
    made = [(k, *whole(t, tools)) for k, t in rows]
    count = Counter(x for *_, links in made for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(
        ((k, len(a), len(b), len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for k, a, b, g, links in made),
        key=repr,
    )


def texts():
    rng = random.Random(11)
    some = ["the", "token's", "word.", "Straße", "naïve", "漢字", "😀", "<s>", "</s>", "<|endoftext|>", "<unk>", "x=1;", "12345", "don't", "▁", "é", "\xa0", "\x1c", "a\x00b", "<0x41>", "'s", "…", "​", "ﬁ"]
    gaps = [" ", " ", " ", "  ", "   ", "\n", "\n\n", " \n ", "\t", "\r\n", "\x85", "　", " \x1c", ""]
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "  a  b ", "a \n", "▁", "x" * 5000, "word " * 3000]
    return out + ["".join(rng.choice(some) + rng.choice(gaps) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]


def test_parts_give_what_whole_texts_give(tools):
    made = L.Aligner(A, B)
    n_a, n_b, n, groups, ends, links = made.align(pa.array(texts()))
    for i, text in enumerate(texts()):
        a, b, g, k = whole(text, tools)
        assert (n_a[i], n_b[i], n[i], groups[i], links[ends[i] : ends[i + 1]].tolist()) == (len(a), len(b), len(k), g, [x << 32 | y for x, y in k]), repr(text)


def test_rows_of_all_kinds(spark, tools):
    rows = list(enumerate(texts())) + [(None, "no id"), (5, "an id again"), (5, "an id again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("links", F.lit("x")).withColumn("n_a", F.lit(None).cast("int"))
    found = L.align_counted(docs, Scratch(spark, "t"), A, B)
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.select(order).collect()), key=repr) == expected(rows, tools)
    assert L.align_counted(docs.limit(0), Scratch(spark, "t"), A, B).collect() == []
    assert L.align(docs, A, B, texts=True).where("doc_id = 5 and n_a = 3").select("groups").first()[0].count(";") == 2


def test_query_against_whole_encoding(spark, sf_dir, tools):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op13_tokenizer_alignment(spark, sf_dir).collect()), key=repr) == expected(rows, tools)


def test_linked_pairs_are_bounded_by_the_vocabularies(tools):
    assert L.pair_bound(*tools[2:]) < 600_000
    assert L.pair_bound({0: b"ab", 1: b"b"}, {5: b"b", 6: b"ab", 7: b"b"}) == 6


def test_few_encodings_at_once():
    """An aligner encodes a slice's strings few at a time, whatever the slice holds, with the same groups."""
    rng, seen = random.Random(2), []
    texts = pa.array([" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(3000)) for _ in range(20)])

    class Counted:
        def encode(self, raw, **how):
            seen.append(sum(map(len, raw)))
            return model.encode(raw, **how)

    a, b = (L.Aligner(A, B) for _ in range(2))
    model, b.b = b.b, Counted()
    got = b.align(texts)
    assert max(seen) <= 2 << 16 and sum(seen) > 400_000
    one = [a.align(texts[k : k + 1])[3][0] for k in range(3)]
    assert got[3][:3] == one


def test_a_part_that_ends_within_a_token(tools):
    """Its string is set aside; the others of the call are aligned part by part."""
    (good, found), = L.Aligner(A, B)._aligned([[" hel", "lo"], [" hello", " world"]])
    assert good.tolist() == [False, True]
    assert found.counts.tolist() == [[len(whole(w, tools)[k]) for w in ("hello", "world")] for k in (0, 1, 3)]
    assert found.pairs.tolist() == [x << 32 | y for w in ("hello", "world") for x, y in whole(w, tools)[3]]


def test_aligning_costs_less_than_encoding():
    """What is done with the ids of new parts takes fewer CPU seconds than encoding them."""
    rng = random.Random(4)
    texts = pa.array([" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(20_000)) for _ in range(10)])

    def measured():
        made, spent = L.Aligner(A, B), 0.0
        inner = made._encoded

        def timed(raw):
            nonlocal spent
            found = inner(raw)
            while True:
                at = time.process_time()
                one = next(found, None)
                spent += time.process_time() - at
                if one is None:
                    return
                yield one

        made._encoded = timed
        at = time.process_time()
        made.align(texts)
        return (time.process_time() - at - spent) / spent

    assert min(measured() for _ in range(3)) < 1.3


def test_one_aligner_for_all_tasks_of_a_worker():
    """Task functions are pickled; they must share the worker's aligner, and counting frees it."""
    from pyspark import cloudpickle

    some = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b a"])], ["doc_id", "text"])
    made = []
    for _ in range(2):
        list(cloudpickle.loads(cloudpickle.dumps(L._align(A, B, False)))(iter([some])))
        made.append(L._aligners.get((A, B)))
    assert made[0] is not None and made[0] is made[1] and "a" in made[0].known
    list(cloudpickle.loads(cloudpickle.dumps(L._tally))(iter([])))
    assert not L._aligners
