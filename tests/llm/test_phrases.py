"""Collocations against brute force, and the tries."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import phrases as P
from tidemill.llm import tries
from tidemill.llm.common import Scratch
from tidemill.llm.q_phrases import SQL, op12_collocations


def brute(rows, least=10, within=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= within * a for q, b in found.items() if len(q) == 3 and p[0] in q):
                continue
            s, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def some_rows():
    rng = random.Random(4)
    words = ["the", "a", "É", "Straße", "new", "york", "City", "x\x1fy", "\xa0", "漢字", "\x00", "1", "#", "in"]
    gaps = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "! ?", "\x0b", " \r "]
    rows = [(rng.choice(["en", "de", None, "e\tn", ""]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 60)))) for _ in range(2500)]
    return rows + [("en", None), ("fr", ""), (None, " \n "), ("en", "new york city " * 3000), ("en", "in a row"), ("en", "in a row"), ("de", ";;;")]


def test_rows_of_all_kinds_equal_brute_force(spark, monkeypatch):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("words", F.lit(1)).withColumn("n", F.lit("n")).repartition(5)
    want = brute(rows)
    assert len(want) > 300
    assert rows_of(P.collocations(docs, Scratch(spark, "t"))) == want
    # Several passes of small tries, and a short list.
    monkeypatch.setattr(P, "TOGETHER", 2)
    assert rows_of(P.collocations(docs, Scratch(spark, "t"), trie_phrases=60, top=40)) == brute(rows, top=40)
    assert rows_of(P.collocations(docs.limit(0), Scratch(spark, "t"))) == []


def test_query_against_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    found = duckdb.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({SQL['op12_collocations']})").fetchall()
    assert rows_of(op12_collocations(spark, sf_dir)) == sorted(found)


@pytest.mark.parametrize("shape", ["even", "one first word", "one last word", "single", "none"])
def test_tries_hold_their_phrases_and_no_others(shape):
    rng = np.random.default_rng(2)
    n = {"single": 1, "none": 0}.get(shape, 6000)
    codes = rng.integers(0, 900, (n, 3))
    codes[rng.random(n) < 0.4, 2] = -1
    if shape == "one first word":
        codes[:, 0] = 7
    if shape == "one last word":
        codes[:, 1] = 7
    codes = np.unique(codes, axis=0)
    rng.shuffle(codes)
    trie = tries.Trie(codes, 31)
    held = {tuple(c): e for c, e in zip(codes.tolist(), trie.ends.tolist())}
    assert len(set(held.values())) == len(codes)
    asked = np.concatenate([codes, rng.integers(0, 900, (5000, 3))])
    state = np.zeros(len(asked), np.int64)
    for j in range(3):
        on = asked[:, j] >= 0
        state = np.where(on, trie.step(state, asked[:, j]), state)
    ends = set(trie.ends.tolist())
    for c, s in zip(asked.tolist(), state.tolist()):
        if tuple(c) in held:
            assert s == held[tuple(c)]
        else:
            assert s not in ends
    assert len(trie.check) < 20_000 + 8 * len(codes)
