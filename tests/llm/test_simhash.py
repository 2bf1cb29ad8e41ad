"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import simhash as S
from tidemill.llm.common import Scratch

WHITE = " \t\n\x0b\x0c\r"


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def by_hand(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, prints[i], least.get(top(i))) for i, (k, _) in enumerate(rows)), key=repr)


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("other")).withColumn("node", F.lit(1))
    found = S.simhash_duplicates(docs, Scratch(spark, "t")).collect()
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found), key=repr)


def test_texts_of_all_kinds_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "Ab", "x\x1cy", "a\xa0b"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 200]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(120):  # copies with a changed word, other case and white space
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 - i, rng.choice([" ", "\t", "\n \x0b"]).join(words).upper()))
    rows += [(7, None), (5, ""), (3, " \n"), (None, base[3]), (None, "only here and nowhere else"), (9, base[9]), (9, base[9]), (2000, " ".join(vocabulary) * 400)]
    assert result(spark, rows) == by_hand(rows)
    assert result(spark, []) == []


def test_crowded_fingerprints_keep_every_link(spark, monkeypatch):
    """Fingerprints within a few bits of one another, more than are compared at once."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre}
    while len(prints) < 1500:
        x = centre
        for j in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            x ^= 1 << int(j)
        prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 1 << 64, 500, dtype=np.uint64)}
    fp = sorted(prints)
    monkeypatch.setattr(S, "fingerprints", None)
    monkeypatch.setattr(S, "_fingerprint_rows", lambda size: lambda batches: (pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array([int(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64))], ["doc_id", "fp"]) for b in batches))
    docs = spark.createDataFrame([(i, str(x)) for i, x in enumerate(fp)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in S.simhash_duplicates(docs, Scratch(spark, "t")).collect()}
    x = np.array(fp, np.uint64)
    label, near = np.arange(len(x)), np.bitwise_count(x[:, None] ^ x[None]) <= 2
    while True:
        new = np.where(near, label[None], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert found == dict(enumerate(label.tolist()))
    assert len(set(label.tolist())) > 500


@pytest.mark.parametrize("later", [False, True])
def test_every_pair_of_two_bits_meets(later):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    flips = np.array([sum(1 << int(j) for j in rng.choice(64, int(n), replace=False)) for n in rng.integers(0, 3, 500)], np.uint64)
    seen = []
    for fp in (x, x ^ flips):
        key, kind, row = S.meetings(fp)
        if later:
            more, _, at = S.meetings(fp[row], kind)
            key, row = more ^ key[at], row[at]
        seen.append(set(zip(key.tolist(), row.tolist())))
    met = {r for _, r in seen[0] & seen[1]}
    assert met == set(range(500))
    assert (np.abs(S.distances(x) - S.distances(x ^ flips)).max(axis=1) <= 2).all()
