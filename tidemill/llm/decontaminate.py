"""Benchmark decontamination by edit distance over words.

A text is contaminated by a benchmark item if some run of its words is within ``max_edits`` word edits
(a tenth of the item's words) of the whole item. Items are cut into pieces of bounded length, of which one
has no more than its share of the edits. Pieces and the text's windows of a piece's length are embedded by
CGK random walks: a step writes the word under the pointer, which then moves on or stays by a random bit of
step and word; edit distance becomes Hamming distance, since two walks that an edit has parted meet again by
chance. Samples of positions of the embeddings are hashed; equal hashes make a candidate. For each length of
pieces, walks are repeated until a simulation of passages with all edits that are allowed meets
``RECALL`` of them. Candidates are then compared with the whole item, around the place, by exact edit
distance.

Only windows that can match are embedded: n words with e edits keep n - e words and n - 1 - 2e pairs of
neighbours, so windows with fewer words and pairs of pieces of that length are passed over without loss.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix64, slices, words

EDIT_SHARE = 0.1
LEAST_WORDS = 5
MAX_ITEM_WORDS = 500_000  # words of one block of items, which every task holds
PIECE = 24  # words of a piece of a longer item, at least; pieces have fewer than twice as many
RECALL = 0.9995  # of passages with all edits that are allowed, by one piece
POSITIONS, SAMPLES = 3, 2  # sampled positions of a hash, hashes of a walk
MOST_WALKS = 256
WINDOWS = 1 << 10  # windows embedded at once
SLICE = 8 << 20  # bytes of text searched at once
_C = np.uint64(0x9E3779B97F4A7C15)


def edits_allowed(n_words: int, share: float = EDIT_SHARE) -> int:
    return int(n_words * share)


def edit_distance(item: np.ndarray, window: np.ndarray) -> int:
    """Fewest word edits between the item and a beginning of the window."""
    j = np.arange(len(window) + 1)
    row = j.copy()
    for i, w in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (window != w)]))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def start_distances(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """For every start in the region, the fewest word edits between the item and a run of words from there."""
    backwards, j = region[::-1], np.arange(len(region) + 1)
    row = np.zeros_like(j)  # read from the end, a run may begin anywhere
    for i, w in enumerate(item[::-1], 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (backwards != w)]))
        row = np.minimum.accumulate(new - j) + j
    return row[::-1]


def cut(n_words: int) -> list[tuple[int, int]]:
    """(start, length) of an item's pieces, as equal as can be."""
    n = max(1, n_words // PIECE)
    edge = [k * n_words // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


@lru_cache(None)
def _walks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of n words: (walks, steps) random words that decide where a walk moves on, and (walks, steps,
    SAMPLES) whether a hash takes the step; the same everywhere."""
    rng = np.random.default_rng(n)
    taken = np.zeros((MOST_WALKS, 2 * n, SAMPLES), bool)
    for w in range(MOST_WALKS):
        for s in range(SAMPLES):
            taken[w, rng.choice(2 * n, min(POSITIONS, 2 * n), replace=False), s] = True
    return rng.integers(0, 1 << 64, (MOST_WALKS, 2 * n), dtype=np.uint64), taken


def embed(tokens: np.ndarray, at: np.ndarray, length: np.ndarray, n: int, walks: int) -> np.ndarray:
    """(windows, walks, SAMPLES) hashes of sampled positions of the windows' embeddings. A window starts at a
    token and has length words, n at most; after its end a walk reads blanks."""
    salt, taken = _walks(n)
    out = np.broadcast_to(mix64(np.arange(1, walks * SAMPLES + 1, dtype=np.uint64) * _C).reshape(walks, SAMPLES), (len(at), walks, SAMPLES)).copy()
    off, last = np.zeros((len(at), walks), np.int64), len(tokens) - 1
    for j in range(2 * n):
        word = np.where(off < length[:, None], tokens[np.minimum(at[:, None] + off, last)], np.uint64(0))
        for s in range(SAMPLES):
            here = np.flatnonzero(taken[:walks, j, s])
            if len(here):
                out[:, here, s] = mix64(out[:, here, s] * _C + word[:, here] + np.uint64(j))
        off += (((word ^ salt[:walks, j]) * _C) >> np.uint64(63)).astype(np.int64)
    return out


@lru_cache(None)
def walks_needed(n: int, edits: int, recall: float = RECALL, trials: int = 256, tried: int = 64) -> int:
    """Walks with which windows that are so many random edits from a piece of n words meet it in the wanted
    share of cases, from the share of walks that meet in simulated cases."""
    if not edits:
        return 1
    rng = np.random.default_rng(1000 * n + edits)
    rows = []
    for _ in range(trials):
        piece = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        text = piece.tolist()
        for _ in range(edits):
            k, how, new = int(rng.integers(len(text))), int(rng.integers(3)), int(rng.integers(1, 1 << 62))
            text[k : k + (how < 2)] = [] if how == 0 else [new]
        rows.append(np.concatenate([piece, np.array(text, np.uint64), rng.integers(1, 1 << 62, 2 * n, dtype=np.uint64)])[: 3 * n])
    tokens, start, full = np.concatenate(rows), np.arange(trials) * 3 * n, np.full(trials, n)
    met = (embed(tokens, start, full, n, tried) == embed(tokens, start + n, full, n, tried)).any(axis=2)
    share = np.maximum(met.mean(axis=1), 0.5 / tried)
    for walks in range(1, MOST_WALKS):
        if np.mean(1 - (1 - share) ** walks) >= recall:
            return walks
    return MOST_WALKS


def _runs(tokens: np.ndarray, size: int) -> np.ndarray:
    return tokens if size == 1 else tokens[:-1] * _C + tokens[1:]


def _bits_of(asked: np.ndarray, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of the known hashes among those asked for, 0 for others."""
    if not len(known):
        return np.zeros(len(asked), np.uint64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, bits[at], np.uint64(0))


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]], share: float = EDIT_SHARE, least_words: int = LEAST_WORDS):
        starts, ids, distinct = words(pa.array([t for _, t in rows], pa.string()), lower=True)
        tokens = hash_words(distinct)[ids] | np.uint64(1)
        by_text: dict[bytes, list[int]] = {}
        for (item_id, _), a, b in zip(rows, starts[:-1], starts[1:]):
            if b - a >= max(1, least_words):
                by_text.setdefault(tokens[a:b].tobytes(), []).append(item_id)
        texts = sorted(by_text, key=lambda t: (len(t), t))
        self.item_ids, self.items = [by_text[t] for t in texts], [np.frombuffer(t, np.uint64) for t in texts]
        self.edits = [edits_allowed(len(x), share) for x in self.items]
        pieces: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(self.items):
            for at, n in cut(len(x)):
                pieces.setdefault(n, []).append((i, at))
        self.classes = [(n, edits_allowed(n, share)) for n in sorted(pieces)]
        self.tables = [self._table(pieces[n], n, walks_needed(n, e)) for n, e in self.classes]
        self.pairs, self.of_pair = self._known(pieces, 2)
        self.words, self.of_word = self._known(pieces, 1)

    def _table(self, pieces, n: int, walks: int):
        """Sorted hashes of the class's pieces by all walks, and the piece of each."""
        rows = np.concatenate([self.items[i][at : at + n] for i, at in pieces])
        start = np.arange(len(pieces)) * n
        key = np.concatenate([embed(rows, start[k : k + WINDOWS], np.full(len(start[k : k + WINDOWS]), n), n, walks).ravel() for k in range(0, len(start), WINDOWS)])
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), walks * SAMPLES)
        order = np.argsort(key, kind="stable")
        item, at = (np.array(x, np.int64) for x in zip(*pieces))
        return key[order], piece[order], item, at, walks

    def _known(self, pieces, size: int):
        """Sorted hashes of all runs of size words in pieces, and the classes that have each, as bits."""
        found = []
        for c, n in enumerate(sorted(pieces)):
            runs = [_runs(self.items[i][at : at + n], size) for i, at in pieces[n]]
            runs = np.unique(np.concatenate(runs))
            found.append((runs, np.full(len(runs), c)))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        run, kind = (np.concatenate(x) for x in zip(*found))
        distinct, at = np.unique(run, return_inverse=True)
        bits = np.zeros(len(distinct), np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << kind.astype(np.uint64))
        return distinct, bits

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, start word, edits) of every text and item that match; the nearest window counts, the
        first of several as near."""
        if not self.items:
            return []
        starts, ids, distinct = words(texts, lower=True)
        if not len(ids):
            return []
        coded = hash_words(distinct) | np.uint64(1)
        tokens = coded[ids]
        word_bits = _bits_of(coded, self.words, self.of_word)[ids]
        ends = np.repeat(starts[1:], np.diff(starts))
        both = np.flatnonzero((word_bits[:-1] != 0) & (word_bits[1:] != 0) & (ends[:-1] == ends[1:]))
        pair_bits = _bits_of(tokens[both] * _C + tokens[both + 1], self.pairs, self.of_pair)
        both, pair_bits = both[pair_bits != 0], pair_bits[pair_bits != 0]
        near: dict[tuple[int, int], set[int]] = {}
        for c, ((n, e), table) in enumerate(zip(self.classes, self.tables)):
            bit = np.uint64(1) << np.uint64(c)
            if n == 1:
                here = np.flatnonzero(word_bits & bit)
            else:
                here = self._possible(both[(pair_bits & bit) != 0], n, e, starts, ends)
            for lo in range(0, len(here), WINDOWS):
                self._meet(table, n, here[lo : lo + WINDOWS], tokens, ends, starts, near)
        out = []
        for (row, i), places in sorted(near.items()):
            best = self._nearest(i, np.array(sorted(places)), tokens, int(starts[row]), int(starts[row + 1]))
            if best is not None:
                out.append((row, i, best[1], best[0]))
        return out

    @staticmethod
    def _possible(pairs: np.ndarray, n: int, e: int, starts, ends) -> np.ndarray:
        """Starts of windows of n + e words with enough of the class's pairs, which stand at the places given."""
        need = max(1, n - 1 - 2 * e)
        if len(pairs) < need:
            return pairs[:0]
        first, last = pairs[: len(pairs) - need + 1], pairs[need - 1 :]
        close = (last - first <= n + e - 2) & (ends[first] == ends[last])
        first, last = first[close], last[close]
        if not len(first):
            return first
        row = np.searchsorted(starts, first, "right") - 1
        lo = np.maximum(last - (n + e - 2), starts[row])
        size = first - lo + 1
        return np.unique(np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))

    def _meet(self, table, n: int, here, tokens, ends, starts, near) -> None:
        """Adds the words at which an item may stand: where a window's hash is one of a piece's."""
        keys, pieces, items, offsets, walks = table
        key = embed(tokens, here, np.minimum(n, ends[here] - here), n, walks).reshape(len(here), -1)
        left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for k, s in zip(*np.nonzero(right > left)):
            p = int(here[k])
            row = int(np.searchsorted(starts, p, "right")) - 1
            for x in np.unique(pieces[left[k, s] : right[k, s]]).tolist():
                near.setdefault((row, int(items[x])), set()).add(p - int(offsets[x]))

    def _nearest(self, i, places, tokens, first, last) -> tuple[int, int] | None:
        """(edits, start word in the text) of the nearest window of item i with a start near the places."""
        item, most, best = self.items[i], self.edits[i], None
        cuts = np.flatnonzero(np.diff(places) > 2 * most) + 1
        for part in np.split(places, cuts):
            lo, end = max(first, int(part[0]) - most), min(last, int(part[-1]) + most + len(item) + most)
            region = tokens[lo:end]
            if int(np.isin(region, item).sum()) < len(item) - most:
                continue
            edits = start_distances(item, region)[:-1]
            at = int(np.argmin(edits))
            if edits[at] <= most and (best is None or edits[at] < best[0]):
                best = int(edits[at]), lo + at - first
        return best


_ready: dict = {}


def hits_column(rows: list[tuple[int, str]], text="text", share: float = EDIT_SHARE, least_words: int = LEAST_WORDS):
    """array<struct<item_id, start_word, edits>> of a text column against one block of items."""
    key = hash((tuple(rows), share, least_words))

    @F.arrow_udf("array<struct<item_id: bigint, start_word: bigint, edits: bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        if key not in _ready:
            _ready.clear()
            _ready[key] = Items(rows, share, least_words)
        items, out, base = _ready[key], [None] * len(texts), 0
        for part in slices([pa.RecordBatch.from_arrays([texts], ["t"])], "t", SLICE):
            for row, i, at, edits in items.search(part.column("t")):
                out[base + row] = (out[base + row] or []) + [{"item_id": x, "start_word": at, "edits": edits} for x in items.item_ids[i]]
            base += part.num_rows
        return pa.array([x or [] for x in out], pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("edits", pa.int64())])))

    return run(F.col(text) if isinstance(text, str) else text)


def item_blocks(benchmark: DataFrame, most: int = MAX_ITEM_WORDS):
    """The benchmark in blocks of a bounded size, one at a time; items without an id or a text are left out."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    n = -(-total // most)
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(1, n)))
    for k in range(max(1, n)):
        yield [(r.item_id, r.text) for r in rows.where(part == k).orderBy("item_id", "text").collect()]  # a block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, block_words: int = MAX_ITEM_WORDS, **how) -> DataFrame:
    """(doc_id, item_id, start_word, edits): every document and item that match, at the nearest window.

    Words are runs without ASCII white space, A-Z in lower case. Null and empty texts match nothing, and
    neither do items of fewer than least_words words (five); shorter ones that are let in match exactly. Rows of one doc_id give rows each; items of equal words
    give a row for each item_id. Extra columns are not read; empty tables give an empty table. Of items of
    ten words and more, which may have edits, RECALL of the matches with all edits allowed are met at least
    (one without edits always is). A benchmark of several blocks is searched block by block, each written.
    """
    scratch, out, held = None, None, None
    for k, rows in enumerate(item_blocks(benchmark, block_words)):
        if held is not None:  # one block's items are held at a time
            scratch = scratch or Scratch(docs.sparkSession, "leaks")
            held = scratch.save(held, f"block-{k}")
            out = held if out is None else out.union(held)
        held = docs.select("doc_id", F.explode(hits_column(rows, **how)).alias("h")).select("doc_id", "h.*")
    if out is None:
        return held
    return out.union(scratch.save(held, "block-last"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, block_words: int = MAX_ITEM_WORDS, **how) -> DataFrame:
    """The rows of docs that match no item, all columns as they were; nulls and the rest as in find_leaks. A
    benchmark of several blocks is applied block by block, each result written."""
    scratch, held = None, docs
    for k, rows in enumerate(item_blocks(benchmark, block_words)):
        if k:
            scratch = scratch or Scratch(docs.sparkSession, "clean")
            held = scratch.save(held, f"block-{k}")
        held = held.where(F.size(hits_column(rows, **how)) == 0)
    return held
