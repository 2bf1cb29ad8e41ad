import random

import pyarrow as pa
import pytest

from tidemill.llm.decontaminate import Items, edit_distance, edits_allowed, find_leaks, without_leaks


@pytest.fixture(scope="module")
def items():
    rng = random.Random(2)
    common = ["the", "of", "and", "in", "to"]
    return [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else f"q{rng.randrange(3000)}" for _ in range(rng.randrange(14, 60)))) for i in range(120)]


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        k, how = rng.randrange(len(words)), rng.choice("sdi")
        if how == "s":
            words[k] = f"new{rng.random()}"
        elif how == "d":
            words.pop(k)
        else:
            words.insert(k, f"new{rng.random()}")
    return words


def distance(a, b):
    """Fewest edits of a to any beginning of b, by the plain recurrence."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert edit_distance(np.array(a), np.array(b)) == distance(a, b)


def test_recall_and_exactness(items):
    """Passages with as many edits as allowed are met in 95 of 100 cases; every hit is within the bound."""
    rng, docs, want = random.Random(7), [], []
    for item_id, text in items:
        words = text.split()
        for _ in range(3):
            x = edited(words, edits_allowed(len(words)), rng)
            docs.append(" ".join([f"f{rng.randrange(999)}" for _ in range(30)] + x + ["end"] * 20))
            want.append(item_id)
    block = Items(items)
    found = block.search(pa.array(docs))
    got = {(row, block.item_ids[i][0]) for row, i, _, _ in found}
    assert sum((k, w) in got for k, w in enumerate(want)) >= 0.95 * len(want)
    for row, i, at, edits in found:
        words, item = docs[row].split(), items[block.item_ids[i][0]][1].split()
        assert distance(item, words[at : at + len(item) + edits_allowed(len(item))]) == edits <= edits_allowed(len(item))


def test_clean_parts_stay(items):
    docs = [" ".join(t.split()[:7]) + " other words follow here" for _, t in items]
    assert Items(items).search(pa.array(docs)) == []


def test_query_finds_every_whole_passage(spark, sf_dir):
    docs = [(r.doc_id, f" {' '.join((r.text or '').lower().split())} ") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [(r.item_id, f" {' '.join(r.text.lower().split())} ") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in bench if x in t}
    from tidemill.llm.q_decontaminate import op8_decontamination

    got = {(r.doc_id, r.item_id): r.edits for r in op8_decontamination(spark, sf_dir).collect()}
    assert want == {k for k, e in got.items() if e == 0}


def test_odd_rows(spark, odd, none, items):
    bench = spark.createDataFrame([(1, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5"), (2, None), (None, "a b c d e"), (3, ""), (4, "alpha beta"), (5, "w0x0 W1x1 w2x2 w3x3 w4x4 w5x5"), (6, "漢字 😀")], "item_id long, text string")
    hits = {(r.doc_id, r.item_id) for r in find_leaks(odd, bench).collect()}
    assert hits == {(6, 1), (7, 1), (6, 5), (7, 5)}
    kept = without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 11
    assert find_leaks(none, bench).count() == 0 and find_leaks(odd, bench.limit(0)).count() == 0 and without_leaks(odd, bench.limit(0)).count() == 13


@pytest.mark.parametrize("m", [10, 15, 40, 100, 200, 400, 1000])
def test_every_length_is_found_whole(m):
    """With as many edits as allowed, every passage is found, whatever the item's length."""
    rng = random.Random(m)
    rows = [(i, " ".join(f"q{rng.randrange(3000)}" for _ in range(m))) for i in range(20)]
    docs = [" ".join([f"f{rng.randrange(999)}" for _ in range(30)] + edited(t.split(), edits_allowed(m), rng) + ["end"] * 20) for _, t in rows]
    block = Items(rows)
    found = block.search(pa.array(docs))
    assert {(row, block.item_ids[i][0]) for row, i, _, _ in found} >= {(k, k) for k in range(20)}
    for row, i, at, edits in found[:3]:
        words, item = docs[row].split(), rows[block.item_ids[i][0]][1].split()
        assert distance(item, words[at : at + m + edits_allowed(m)]) == edits <= edits_allowed(m)


def test_nearest_window_of_few_words():
    """Against every start of short texts over four words, where runs repeat."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    docs = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    block = Items(rows, least_words=1)
    got = {(row, block.item_ids[i][0]): (edits, at) for row, i, at, edits in block.search(pa.array(docs))}
    firsts = {ids[0]: i for i, ids in enumerate(block.item_ids)}
    for d, text in enumerate(docs):
        for item_id, item in rows:
            if item_id in firsts:
                w, x = text.split(), item.split()
                most = edits_allowed(len(x))
                best = min(((distance(x, w[s : s + len(x) + most]), s) for s in range(len(w))), default=(99, 0))
                assert got.get((d, item_id)) == (best if best[0] <= most else None)


def test_queries_match_short_items_exactly(spark, tmp_path):
    import corpus_pipeline
    from tidemill.llm.q_decontaminate import op8_decontamination

    docs = spark.createDataFrame([(1, "so Alpha beta it is"), (2, "alpha gamma beta")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in op8_decontamination(spark, str(tmp_path)).collect()] == [(1, 4, 1, 0)]
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [2]


def by_whole_pieces(items, text, share=0.1):
    """{item: (edits, start)} of a text, exactly: e edits leave one of an item's e + 1 pieces whole, and around
    each place where one stands the whole item is compared."""
    w, out = text.split(), {}
    places = {}
    for i, word in enumerate(w):
        places.setdefault(word, []).append(i)
    for item_id, t in items:
        x = t.split()
        e = edits_allowed(len(x), share)
        edge = [k * len(x) // (e + 1) for k in range(e + 2)]
        starts = {p - a + d for a, b in zip(edge, edge[1:]) for p in places.get(x[a], []) if w[p : p + b - a] == x[a:b] for d in range(-e, e + 1)}
        best = min(((distance(x, w[s : s + len(x) + e]), s) for s in starts if 0 <= s < len(w)), default=(e + 1, 0))
        if best[0] <= e:
            out[item_id] = best
    return out


@pytest.mark.parametrize("m", [5, 9, 10, 14, 19, 29, 39, 47, 48, 59, 100, 400, 1000])
def test_recall_with_all_edits_allowed(m):
    """The share of passages with all their edits that are met, by length; at least 0.995 of 200."""
    rng = random.Random(m)
    rows = [(i, " ".join(f"q{rng.randrange(4000)}" for _ in range(m))) for i in range(200 if m < 100 else 40)]
    docs = [" ".join([f"q{rng.randrange(4000)}" for _ in range(20)] + edited(t.split(), edits_allowed(m), rng) + [f"q{rng.randrange(4000)}" for _ in range(20)]) for _, t in rows]
    block = Items(rows)
    got = {(row, block.item_ids[i][0]) for row, i, _, _ in block.search(pa.array(docs))}
    assert sum((k, k) in got for k in range(len(rows))) >= 0.995 * len(rows)


def test_matches_equal_the_exact_search(items):
    """Against the exact search, with any number of edits around the allowance; nothing more is found, and less
    only at the recall."""
    rng, docs = random.Random(17), []
    for _, text in items:
        words = text.split()
        n = max(0, edits_allowed(len(words)) + rng.randrange(-2, 3))
        docs.append(" ".join(rng.choice(items)[1].split()[:9] + edited(words, n, rng) + ["the", "of"] * 8))
    want = {(d, i, *found) for d, text in enumerate(docs) for i, found in by_whole_pieces(items, text).items()}
    block = Items(items)
    got = {(row, block.item_ids[i][0], edits, at) for row, i, at, edits in block.search(pa.array(docs))}
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 60


def test_blocks_of_items_give_the_same(spark, items):
    rng = random.Random(19)
    docs = spark.createDataFrame([(k, "so it is " + " ".join(edited(t.split(), 1, rng)) + " and on") for k, (_, t) in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, find_leaks(docs, bench).collect()))
    assert len(one) == len(items)
    assert sorted(map(tuple, find_leaks(docs, bench, block_words=1500).collect())) == one
    assert without_leaks(docs, bench, block_words=1500).count() == 0
