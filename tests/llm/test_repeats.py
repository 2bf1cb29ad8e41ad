import hashlib
import random

import numpy as np
import pytest

from tidemill.llm import repeats
from tidemill.llm.q_repeats import op10_repeated_substrings
from tidemill.llm.repeats import remove_repeats, repeated_windows, suffix_order


def brute(texts, length):
    """Removed spans and left bytes of each text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for k in range(len(d) - length + 1):
            w = hashlib.md5(d[k : k + length]).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[hashlib.md5(d[k : k + length]).digest()] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8).astype(int), [0]])))
        out.append((list(zip(spans[::2].tolist(), spans[1::2].tolist())), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        text = np.array([rng.choice([0, 97, 98, 98, 255]) for _ in range(rng.randrange(1, 70))], np.uint8)
        raw = text.tobytes()
        assert suffix_order(text, 1000).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_suffix_ranks():
    """Suffixes that are equal up to the depth share a rank."""
    rng = random.Random(4)
    for depth in (1, 3, 7, 8, 20):
        for _ in range(60):
            text = np.array([rng.choice([0, 97, 98, 98, 255]) for _ in range(rng.randrange(1, 70))], np.uint8)
            keys = [text.tobytes()[i : i + depth] for i in range(len(text))]
            assert repeats.suffix_ranks(text, depth)[0].tolist() == [sorted(keys).index(k) for k in keys]


def test_single_windows_are_not_sorted_on(monkeypatch):
    """Of texts that share nothing long little more is sorted than their first bytes, and no window is left."""
    rng, sizes, argsort = random.Random(6), [], np.argsort
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = np.frombuffer(" ".join(rng.choice(words) for _ in range(20_000)).encode(), np.uint8)
    monkeypatch.setattr(repeats.np, "argsort", lambda x, *a, **b: sizes.append(len(x)) or argsort(x, *a, **b))
    _, left = repeats.suffix_ranks(text, 400, np.arange(len(text) - 400))
    assert not len(left) and sum(sizes) < 2 * len(text)


def test_repeated_windows():
    rng = random.Random(5)
    for _ in range(100):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12, 50))) for _ in range(4)]
        segments = [rng.choice(base)[rng.randrange(4) :] + bytes(rng.choice(b"abc") for _ in range(5)) for _ in range(6)]
        count = {}
        for s in segments:
            for k in range(len(s) - 7):
                count[s[k : k + 8]] = count.get(s[k : k + 8], 0) + 1
        assert [h.tolist() for h in repeated_windows(segments, 8)] == [[count[s[k : k + 8]] > 1 for k in range(len(s) - 7)] for s in segments]


@pytest.mark.parametrize("group_bytes", [1, 1 << 20])
def test_against_brute_force(spark, scratch, group_bytes):
    """Shared passages at many places, periodic texts, copies; with small groups all counted by windows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh ü") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(160))
    texts = [" ".join(word() for _ in range(rng.randrange(5, 120))) for _ in range(40)]
    texts += [t[:50] + passage[k : k + 500] + t[50:] for k, t in enumerate(texts[:20])]
    texts += ["ab" * 400, "ab" * 300 + "x", "z" * 399, "z" * 400, "z" * 401, "", None, texts[3] * 3, texts[5] + passage, texts[5] + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ([(x.lo, x.hi) for x in r.removed], bytes(r.kept)) for r in remove_repeats(docs, scratch, group_bytes=group_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_query_against_brute_force(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = {i: (len(t.encode()), len(t.encode()) - len(k), len(s), hashlib.sha256(k).hexdigest()) for (i, t), (s, k) in zip(rows, brute([t for _, t in rows], 400))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_repeated_substrings(spark, sf_dir).collect()} == want


def test_odd_rows(odd, none, scratch):
    got = remove_repeats(odd, scratch).collect()
    assert len(got) == 13
    left = {r.doc_id: r for r in got}
    assert left[6].n_bytes > 300_000 and bytes(left[6].kept) == b"" and bytes(left[7].kept) == b" tail"
    assert left[4].n_bytes == 0 and bytes(left[1].kept) == b"alpha beta gamma delta epsilon zeta"
    assert remove_repeats(none, scratch).count() == 0
