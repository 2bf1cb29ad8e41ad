import random

import numpy as np
import pytest

from tidemill.llm import near_dups
from tidemill.llm.components import components
from tidemill.llm.near_dups import branch, keep_one, mix64, near_duplicates
from tidemill.llm.q_near_dups import op7_near_duplicates


def brute(rows, k, percent=80):
    sets, root = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(ids[a]), find(ids[b])
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(got, want):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert got == want


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op7_near_duplicates(spark, sf_dir).collect(), brute(rows, 2))


@pytest.mark.parametrize("how", [{}, {"wide": 65}, {"wide": 65, "deeper": 0}])
def test_large_group(spark, scratch, monkeypatch, how):
    """A cloud of edited copies, larger than a small node, some linked only through others; in one block,
    through wide nodes that branch on, and in many small blocks."""
    if how:
        monkeypatch.setattr(near_dups, "CHUNK", 32)
    rng = random.Random(4)
    base = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(50))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_duplicates(docs, scratch, shingle=2, **how).collect(), brute(rows, 2))


def test_recall_of_branching():
    """Pairs at the threshold share a path in one of ten trees nearly always."""
    rng = np.random.default_rng(3)
    n = 2000
    a = rng.integers(0, 2**32, (n, 64), dtype=np.uint64).astype(np.uint32)
    b = np.where(rng.random((n, 64)) < 0.8, a, rng.integers(0, 2**32, (n, 64), dtype=np.uint64).astype(np.uint32))
    roots, met = mix64(np.arange(1, 11, dtype=np.uint64)), 0
    for i in range(n):
        sides = [set(branch(t[i : i + 1], roots.copy(), np.zeros(10, np.int64), 3)[0].tolist()) for t in (a, b)]
        met += bool(sides[0] & sides[1])
    assert met / n > 0.995


def test_recall_below_a_wide_node():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**32, (1500, 64), dtype=np.uint64).astype(np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 2**32, a.shape, dtype=np.uint64).astype(np.uint32))
    met = 0
    for k, pair in enumerate(zip(a, b)):
        top = mix64(np.full(near_dups.WIDE_TREES, k, np.uint64) ^ mix64(np.arange(1, near_dups.WIDE_TREES + 1, dtype=np.uint64)))
        sides = [set(branch(t[None], top.copy(), np.zeros(len(top), np.int64), 2)[0].tolist()) for t in pair]
        met += bool(sides[0] & sides[1])
    assert met / len(a) > 0.985


def test_components(spark, scratch):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}}


def test_odd_rows(odd, scratch):
    got = near_duplicates(odd, scratch).collect()
    assert len(got) == 13
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == by[2][0].component_id == by[2][1].component_id == 1
    assert by[1][0].kept and not by[2][0].kept
    assert by[3][0].n_shingles == by[4][0].n_shingles == by[5][0].n_shingles == 0
    assert by[7][0].component_id == 6
    kept = keep_one(odd, scratch)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [-3, 1, 3, 4, 5, 6, 8, None, None]


def test_empty(none, scratch):
    assert near_duplicates(none, scratch).count() == 0 and keep_one(none, scratch).count() == 0
