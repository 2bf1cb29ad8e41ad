"""Collocations: what a worker holds, and what a pass reads."""

import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.llm import phrases as P
from tidemill.llm.common import Scratch, small_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def built(number, phrases, radix):
    table = pa.table({"lang": ["e\tn"] * len(phrases), "phrase": phrases})
    rows = P._built(radix)((pa.scalar(number),), table).to_pylist()
    return SimpleNamespace(**rows[0]), {r["state"]: r["phrase"] for r in rows[1:]}


def test_a_walk_holds_no_object_for_each_word():
    n, radix = 40_000, 1 + int((2 * 40_000) ** 0.5)
    rows = [built(k, [f"a{k}x{i} b{k}x{i}" for i in range(n)], radix)[0] for k in (0, 1)]
    tracemalloc.start()
    walk = P.Walk(rows, 2, radix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(words) for _, words in walk.known.values()) == 4 * n
    assert peak < 150 * 4 * n  # bytes; a word and its language as Python strings take over 200


def test_phrases_are_laid_apart_and_walk_once():
    rng = np.random.default_rng(3)
    place = rng.integers(-1, 40, 6000).astype(np.int32)
    words = pa.array([f"w{i}" for i in range(40)])
    cut = pa.RecordBatch.from_arrays([pa.array(["e\tn"]), pa.array([6000]), pa.array([words.to_pylist()]), pa.array([place.tobytes()], pa.binary())], ["lang", "n", "words", "places"])
    full = P.Passing([np.full(1 << (P.FILTER_BITS - 3), 255, np.uint8)] * 3)
    want = Counter()
    for size in (2, 3):
        for i in range(len(place) - size + 1):
            if (place[i : i + size] >= 0).all():
                want[" ".join(f"w{x}" for x in place[i : i + size])] += 1
    n_tries, together, radix = 7, 2, 80
    table = next(iter(P._dealt(n_tries)([pa.RecordBatch.from_arrays([pa.array([f"e\tn\t{p}" for p in want])], ["phrase"])])))
    of = dict(zip(table.column("phrase").to_pylist(), table.column("trie").to_pylist()))
    tries = [built(k, [p for p in want if of[p] == k], radix) for k in range(n_tries)]
    found, parts = Counter(), list(P._laid_apart(SimpleNamespace(value=full), n_tries, together)([cut]))
    assert [p.column("part")[0].as_py() for p in parts] == [0, 1, 2, 3]
    assert sum(len(p.column("tries")[0].as_py()) // 4 for p in parts) == len(want)  # each phrase of a slice once, whatever the passes
    for part in parts:
        k = part.column("part")[0].as_py()
        mine = range(k * together, min(n_tries, (k + 1) * together))
        assert set(np.frombuffer(part.column("tries")[0].as_py(), np.int32)) <= set(mine)
        for out in P._walked(SimpleNamespace(value=[tries[t][0] for t in mine]), n_tries, radix)([part, part]):
            for row in (r for batch in P._unpacked([out]) for r in batch.to_pylist()):
                found[tries[row["trie"]][1][row["state"]]] += row["a"]
    assert found == {p: 2 * n for p, n in want.items()}


def test_few_large_rows_pass_at_once(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    with small_batches(spark):
        assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 5
    assert spark.conf.get(LIMIT, None) is None


def test_cut_texts_are_read_in_small_batches(spark):
    seen, limits = {}, {}

    class Watching(Scratch):
        def save(self, df, name, *by, **how):
            limits[name] = spark.conf.get(LIMIT, None)
            seen[name] = super().save(df, name, *by, **how)
            return seen[name]

    docs = spark.createDataFrame([("en", "new york city . " * 20)], "lang string, text string")
    out = P.collocations(docs, Watching(spark, "t"))
    assert out.count() == 1
    assert {limits[x] for x in ("words", "candidates", "sums-0")} == {"4m"}
    assert spark.conf.get(LIMIT, None) is None
