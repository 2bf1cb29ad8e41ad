"""SimHash near duplicates, found with a table of distances to reference fingerprints.

A text's fingerprint has 64 bits; bit j is set if more than half of the hashes of its shingles have it set.
Texts link if their fingerprints differ in ``BITS`` bits at most, and links close to components.

Every distinct fingerprint gets its Hamming distances to many references. Two fingerprints that are BITS
apart differ by BITS at most in each of these coordinates, so a pair with a larger difference anywhere is
discarded; the others are verified on the fingerprints. No pair is lost.

Which rows meet at all is read from the same table. The first 65 references are a staircase: each flips one
more bit of the one before. From one stair to the next a distance moves by one, up or down, and BITS
differing bits can change that in BITS stairs at most. The stairs are cut into BITS + 3 stretches; a linked
pair moves alike in at least three of them, so it meets under the moves of some three stretches. Where that
leaves many fingerprints together (near copies of one text), the stairs of the other stretches are cut in
the same way again; after that at most 2 ** 10 fingerprints can share all moves, so every group that a
task compares is bounded, however many rows a text has.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, slices, words
from .components import components

BITS = 2
SHINGLE = 3
SEED = 42
ALIKE = 3  # stretches in which a linked pair moves alike
SMALL = 128  # fingerprints that meet under the first stretches and are compared at once
RANDOM = 31  # references besides the staircase

_rng = np.random.default_rng(64)
_base = _rng.integers(0, 1 << 64, dtype=np.uint64)
#: The staircase (65 references), then others at random.
REFERENCES = np.concatenate([
    np.array([_base ^ np.uint64((1 << k) - 1) for k in range(65)], np.uint64),
    _rng.integers(0, 1 << 64, RANDOM, dtype=np.uint64),
])
_weights = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts, one after another, and each text's number of shingles."""
    import xxhash

    starts, ids, distinct = words(texts, lower=True)
    count = np.diff(starts)
    flat = distinct.take(pa.array(ids))
    inside = np.arange(len(ids)) + size <= np.repeat(starts[1:], count)
    at = np.flatnonzero(inside)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(at):
        runs = pc.binary_join_element_wise(*[flat.take(pa.array(at + j)) for j in range(size)], " ")
    else:
        runs = pa.array([], flat.type)
    whole = [" ".join(flat.slice(starts[k], count[k]).to_pylist()) for k in short]
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    n = np.maximum(count - size + 1, 0)
    hashes = np.fromiter(map(digest, runs.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(at))
    if len(short):
        hashes = np.insert(hashes, np.cumsum(n)[short], np.array([digest(w) for w in whole], np.uint64))
        n[short] = 1
    return hashes, n


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text; zero without words."""
    hashes, n = shingle_hashes(texts, size)
    out, full = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ends = np.cumsum(n[full])
        ones = np.add.reduceat(bits, ends - n[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_rows(size: int):
    def run(batches):
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text"), size).view(np.int64))], ["doc_id", "fp"])

    return run


def distances(fp: np.ndarray) -> np.ndarray:
    """(n, references) Hamming distances."""
    out = np.empty((len(fp), len(REFERENCES)), np.int8)
    for k, r in enumerate(REFERENCES):
        out[:, k] = np.bitwise_count(fp ^ r)
    return out


def stretches(stairs: list[int], bits: int = BITS) -> list[list[int]]:
    """The stairs in bits + ALIKE stretches, as equal as can be."""
    n = bits + ALIKE
    edge = [k * len(stairs) // n for k in range(n + 1)]
    return [stairs[a:b] for a, b in zip(edge, edge[1:])]


def _moves(table: np.ndarray, stairs: list[int]) -> np.ndarray:
    """A number for the moves of the distances over some stairs; stair k leads to reference k + 1."""
    out = np.zeros(len(table), np.uint64)
    for k in stairs:
        up = (table[:, k + 1] > table[:, k]).astype(np.uint64)
        out += up * _weights[k]
    return mix64(out + np.uint64(len(stairs)))


def meetings(fp: np.ndarray, choice: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, choice, row): under which keys each fingerprint meets others. Without a choice: by three of the
    stretches of all stairs, the choice being their number. With one: by three stretches of the other stairs."""
    table, chosen = distances(fp), list(combinations(range(bits + ALIKE), ALIKE))
    first = stretches(list(range(64)), bits)
    keys, kinds, rows = [], [], []

    def add(at, parts, some, kind, salt):
        key = np.full(len(at), salt, np.uint64)
        for s in some:
            key = mix64(key ^ _moves(table[at], parts[s]))
        keys.append(key)
        kinds.append(np.full(len(at), kind, np.int32))
        rows.append(at)

    for i, some in enumerate(chosen):
        if choice is None:
            add(np.arange(len(fp)), first, some, i, i + 1)
            continue
        at = np.flatnonzero(choice == i)
        others = stretches([k for s in range(bits + ALIKE) if s not in some for k in first[s]], bits)
        for j, more in enumerate(chosen):
            add(at, others, more, i, j + 1)
    return np.concatenate(keys), np.concatenate(kinds), np.concatenate(rows)


def _first_meetings(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        key, kind, row = meetings(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), pa.array(fp[row].view(np.int64))], ["node", "kind", "fp"])


def _later_meetings(batches):
    for batch in batches:
        fp, node = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "node"))
        key, kind, row = meetings(fp, batch.column("kind").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(mix64(key ^ node[row]).view(np.int64)), pa.array(kind), pa.array(fp[row].view(np.int64))], ["node", "kind", "fp"])


def near_pairs(node: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of fingerprints of one node (rows stand by node) that differ in bits at most."""
    table, a, b = distances(fp), [], []
    at, k = np.arange(len(node)), 0
    while True:
        k += 1
        at = at[at + k < len(node)]
        at = at[node[at] == node[at + k]]
        if not len(at):
            break
        left = at
        for some in np.array_split(np.arange(len(REFERENCES))[::-1], 6):  # most pairs fall at the first few
            far = np.abs(table[np.ix_(left, some)] - table[np.ix_(left + k, some)]).max(axis=1)
            left = left[far <= bits]
        left = left[np.bitwise_count(fp[left] ^ fp[left + k]) <= bits]
        a.append(left)
        b.append(left + k)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _stars(batches):
    """Links (a, b) that join, in each node, what near pairs join; rows come sorted by node. A row is linked
    to the first one that pairs lead it to, so that a node has fewer links than rows."""
    held = None

    def links(t: pa.RecordBatch) -> pa.RecordBatch:
        fp = t.column("fp").to_numpy()
        a, b = near_pairs(t.column("node").to_numpy(), fp.view(np.uint64))
        first = np.arange(len(fp))
        while True:
            low = np.minimum(first[a], first[b])
            new = first.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if np.array_equal(new, first):
                break
            first = new
        at = np.flatnonzero(first != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[first[at]])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        node = t.column("node").to_numpy()
        cut = int(np.flatnonzero(np.append(True, node[1:] != node[:-1]))[-1])  # the last node may go on
        if cut:
            yield links(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield links(held)


def _linked(rows: DataFrame) -> DataFrame:
    return rows.select("node", "fp").repartition("node").sortWithinPartitions("node", "fp").mapInArrow(_stars, "a long, b long")


def simhash_duplicates(docs: DataFrame, scratch: Scratch, *, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text): the fingerprint as a signed long and
    the smallest doc_id reachable over fingerprints that differ in BITS bits at most.

    A-Z is lower-cased, words are runs without ASCII white space, repeated shingles count; a text of fewer
    words is one shingle; null, empty and blank texts have the fingerprint zero and link like any other.
    Rows of one doc_id have rows each. A row without a doc_id links others by its fingerprint and has the
    smallest doc_id of its component, null if there is none. Extra columns are not read; an empty table gives
    an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = scratch.save(docs.mapInArrow(_fingerprint_rows(shingle), "doc_id long, fp long"), "prints")
    classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    kind = "node long, kind int, fp long"
    rows = scratch.save(classes.select("fp").mapInArrow(_first_meetings, kind), "meetings")
    sizes = scratch.save(rows.groupBy("node").count().where("count > 1"), "sizes")
    near = _linked(rows.join(sizes.where(F.col("count") <= SMALL), "node", "left_semi"))
    crowd = rows.join(sizes.where(F.col("count") > SMALL), "node", "left_semi")
    again = scratch.save(crowd.mapInArrow(_later_meetings, kind), "again")
    alone = again.groupBy("node").count().where("count > 1")
    far = _linked(again.join(alone, "node", "left_semi"))
    labels = components(scratch.save(near.union(far).distinct(), "links"), scratch)
    named = scratch.save(classes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "id", F.coalesce("label", "fp").alias("label")), "labels")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    found = scratch.save(named.join(least, "label").select("fp", "component_id"), "components")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")
