"""Exact repeated substrings by suffix sorting.

Every byte covered by a ``length``-byte string that also starts elsewhere is removed; strings are judged
on the input and never cross documents.

1. Each window of ``length`` bytes belongs to the smallest hash of its 64-byte grams. Windows in a row
   with the same smallest hash form a run; equal windows have the same hash, so runs meet by it.
2. Hashes of a single place are done with. Of the others the runs' bytes (segments) are cut out; equal
   segments are counted first and kept once: all their windows repeat.
3. Different segments of one hash meet in a task and their suffixes are sorted by doubled prefixes, as long as
   they may be equal; windows that share a place are repeated.
4. A hash with more bytes of different segments than a task should hold (the border of a very common passage) is
   settled by counting hashes of its windows instead, which spreads over all tasks.

Work is on distinct texts; a text that several rows share repeats as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, slices

LENGTH = 400
GRAM = 64
GROUP_BYTES = 1 << 20  # bytes of one hash's different segments that are sorted in one task
SORT_BYTES = 1 << 18  # bytes sorted at once, but for a larger hash
NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 22), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of so many bytes."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_INVERSE, n), out=total[1:])
        return mix64((total[size:] - total[:-size]) * _power(_BASE, n - size + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins (one entry more than texts)."""
    binary = pc.fill_null(texts, "").cast(pa.large_binary())
    size = pc.binary_length(binary).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    return np.frombuffer(b"".join(x.as_py() for x in binary), np.uint8), starts


def runs_of(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, hash, whether it holds its gram twice) of the runs of windows with
    one smallest hash. Only a run that holds its gram twice can have equal windows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(bool)
    grams, width = gram_hashes(data, GRAM), length - GRAM + 1
    least = sliding_min(grams, width)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + length <= starts[1:][row]
    edge = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])])
    at = np.flatnonzero(edge)
    n = np.diff(np.append(at, len(least)))
    at, n = at[inside[at]], n[inside[at]]
    twice = np.fromiter((np.count_nonzero(grams[a : a + m + width - 1] == k) > 1 for a, m, k in zip(at.tolist(), n.tolist(), least[at])), bool, len(at))
    return row[at], at - starts[row[at]], n, least[at].view(np.int64), twice


def _runs(length: int):
    def run(batches):
        for part in slices(batches, "text"):
            data, starts = _flat(part.column("text"))
            row, start, n, key, twice = runs_of(data, starts, length)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("text_id").take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(twice)], ["doc_id", "text_id", "start", "n", "key", "twice"])

    return run


def _segments(length: int):
    def run(batches):
        import xxhash

        for part in slices(batches, "text"):
            out = []
            for text_id, text, runs in zip(*(part.column(c).to_pylist() for c in ("text_id", "text", "runs"))):
                data = (text or "").encode()
                for r in runs:
                    cut = data[r["start"] : r["start"] + r["n"] + length - 1]
                    out.append((r["key"], xxhash.xxh3_128_digest(cut), text_id, r["start"], r["n"], cut))
            for at in range(0, len(out), 4096):
                columns = list(zip(*out[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))], ["key", "seg_id", "text_id", "start", "n", "bytes"])

    return run


def suffix_ranks(text: np.ndarray, depth: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The rank of each suffix of a byte array by up to so many bytes, the end being smaller than any byte; equal
    suffixes share a rank.

    Suffixes are sorted by seven bytes, then by twice as many each time: a suffix's rank by 2 h bytes follows from its
    rank by h and that of the suffix h bytes on. One that is alone has its place and is sorted no more.

    With starts (their suffixes have ``depth`` bytes) only what may be equal to another start is sorted on: a start
    over h bytes that nothing else has is single. Then the starts left are told, too, and only their ranks count.
    """
    n, done = len(text), min(7, depth)
    symbols = np.concatenate([text.astype(np.int64) + 1, np.zeros(done, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(done):
        key = key << 9 | symbols[k : k + n]
    rank, tied, live, old = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n), np.zeros(n, np.int64)
    while len(live):
        order = np.argsort(key)
        by, old, live = key[order], old[order], live[order]
        first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        size = np.diff(np.append(first, len(by)))
        group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        base = old - np.repeat(group, np.diff(np.append(group, len(old))))
        rank[live] = np.repeat(first, size) + base
        tied[live] = np.repeat(size > 1, size)
        live = np.sort(live[tied[live]])
        if done == depth:
            break
        step = min(done, depth - done)
        if starts is not None:
            lone = np.concatenate([[0], np.cumsum(~tied)])
            starts = starts[lone[starts + depth - done + 1] == lone[starts]]
            needed = np.bincount(starts, minlength=n + 1) - np.bincount(starts + depth - done - step + 1, minlength=n + 1)
            live = live[np.cumsum(needed)[live] > 0]
        after = live + step
        old = rank[live]
        key = old * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        done += step
    return rank, starts


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte array in order up to so many bytes."""
    return np.argsort(suffix_ranks(text, depth)[0], kind="stable")


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """Of each segment, which of its windows also starts elsewhere in the segments."""
    text = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
    size = np.array([len(s) + 1 for s in segments])
    base = np.cumsum(size) - size
    window = np.zeros(len(text), bool)
    for b, s in zip(base, segments):
        window[b : b + len(s) - length + 1] = True
    rank, starts = suffix_ranks(text, length, np.flatnonzero(window))
    hit = np.zeros(len(text), bool)
    _, at, count = np.unique(rank[starts], return_inverse=True, return_counts=True)
    hit[starts[count[at] > 1]] = True
    return [hit[b : b + len(s) - length + 1] for b, s in zip(base, segments)]


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs [from, to) of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


RANGES = "key long, seg_id binary, ranges array<struct<lo: int, hi: int>>"
_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _sort(length: int):
    """Repeated ranges of segments, from rows (key, seg_id, bytes) sorted by key."""

    def run(batches):
        held, size, last = [], 0, None

        def flush(rows):
            hits = repeated_windows([r[2] for r in rows], length)
            found = [(r[0], r[1], [{"lo": a, "hi": b} for a, b in _spans(h)]) for r, h in zip(rows, hits) if h.any()]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.binary(), _RANGES))], ["key", "seg_id", "ranges"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "seg_id", "bytes"))):
                if size > SORT_BYTES and row[0] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[2]), row[0]
        if held:
            yield flush(held)

    return run


def _windows(length: int):
    """One row per window: (key, seg_id, at, two hashes)."""

    def run(batches):
        for batch in batches:
            for key, seg_id, cut in zip(*(batch.column(c).to_pylist() for c in ("key", "seg_id", "bytes"))):
                for base in range(0, len(cut) - length + 1, 1 << 16):
                    part = cut[base : base + (1 << 16) + length - 1]
                    n, h = len(part) - length + 1, gram_hashes(np.frombuffer(part, np.uint8), length)
                    check = [int.from_bytes(hashlib.blake2b(part[i : i + length], digest_size=8).digest(), "little", signed=True) for i in range(n)]
                    at = np.arange(base, base + n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([seg_id] * n, pa.binary()), pa.array(at), pa.array(h.view(np.int64)), pa.array(check, pa.int64())], ["key", "seg_id", "at", "h", "h2"])

    return run


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(text_id, copies, ranges): for every distinct text, how many rows have it and the [lo, hi) window
    starts that also start elsewhere. docs: (doc_id, text, text_id)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), "text_id", "text")
    texts = scratch.save(rows.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "texts")
    long_enough = rows.where(F.octet_length("text") >= length)
    runs = scratch.save(long_enough.mapInArrow(_runs(length), "doc_id long, text_id binary, start int, n int, key long, twice boolean"), "runs")
    place = F.xxhash64("text_id", "start")
    places = runs.groupBy("key").agg(F.min(place).alias("p0"), F.max(place).alias("p1"), F.max("twice").alias("twice"))
    keys = scratch.save(places.where("p0 != p1 or twice").select("key"), "keys")
    wanted = runs.join(keys, "key").join(texts.select("text_id", "doc_id"), ["text_id", "doc_id"])
    by_text = wanted.groupBy("text_id", "doc_id").agg(F.collect_list(F.struct("start", "n", "key")).alias("runs"))
    cut = rows.join(by_text, ["text_id", "doc_id"]).select("text_id", "text", "runs")
    segments = scratch.save(cut.mapInArrow(_segments(length), "key long, seg_id binary, text_id binary, start int, n int, bytes binary"), "segments")

    counted = segments.groupBy("key", "seg_id").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min(F.struct("text_id", "start")).alias("one"))
    counted = scratch.save(counted, "counted")
    groups = scratch.save(counted.groupBy("key").agg(F.sum((F.col("n") + length).cast("long")).alias("size"), F.sum((F.col("c") == 1).cast("long")).alias("open")).where("open > 0"), "groups")
    one = counted.join(groups, "key").select("key", "seg_id", "size", F.col("one.text_id").alias("text_id"), F.col("one.start").alias("start"))
    contents = segments.join(one, ["key", "seg_id", "text_id", "start"]).select("key", "seg_id", "size", "bytes")
    few = contents.where(F.col("size") <= group_bytes).select("key", "seg_id", "bytes")
    sorted_in = few.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(length), RANGES)
    windows = contents.where(F.col("size") > group_bytes).select("key", "seg_id", "bytes").mapInArrow(_windows(length), "key long, seg_id binary, at int, h long, h2 long")
    windows = scratch.save(windows, "windows")
    twice = scratch.save(windows.groupBy("h", "h2").count().where("count > 1").select("h", "h2"), "twice")
    hits = windows.join(twice, ["h", "h2"]).groupBy("key", "seg_id").agg(F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))).alias("ranges"))
    whole = counted.where("c > 1").select("key", "seg_id", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("ranges"))
    found = scratch.save(sorted_in.unionByName(hits).unionByName(whole), "found")
    back = segments.select("key", "seg_id", "text_id", "start").join(found, ["key", "seg_id"])
    shifted = F.transform("ranges", lambda r: F.struct((r["lo"] + F.col("start")).alias("lo"), (r["hi"] + F.col("start")).alias("hi")))
    per_text = back.groupBy("text_id").agg(F.flatten(F.collect_list(shifted)).alias("ranges"))
    return scratch.save(texts.select("text_id", "copies").join(per_text, "text_id", "left"), "ranges")


def _cut(length: int):
    def run(batches):
        for part in slices(batches, "text"):
            rows = []
            for text, copies, ranges in zip(*(part.column(c).to_pylist() for c in ("text", "copies", "ranges"))):
                data = (text or "").encode()
                if copies > 1 and len(data) >= length:
                    spans = [(0, len(data))]
                else:
                    spans = []
                    for lo, hi in sorted((r["lo"], r["hi"] + length - 1) for r in ranges or []):
                        if spans and lo <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                        else:
                            spans.append((lo, hi))
                left, at = [], 0
                for lo, hi in spans:
                    left.append(data[at:lo])
                    at = hi
                rows.append((spans, b"".join([*left, data[at:]]), len(data)))
            names = [c for c in part.schema.names if c not in ("copies", "ranges", "text")]
            spans = pa.array([[{"lo": a, "hi": b} for a, b in r[0]] for r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array([r[2] for r in rows], pa.int64()), spans, pa.array([r[1] for r in rows], pa.binary())], [*names, "n_bytes", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for every row of docs (doc_id, text): the removed [lo, hi) byte spans
    and the bytes that are left.

    A null text is empty; texts under ``length`` bytes lose nothing; rows with equal texts (of the same id,
    too) are each other's repeats; null ids are rows like any other. Extra columns are not read; an empty
    table gives an empty table. Cut bytes need not be whole UTF-8 characters.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_id", F.unhex(F.md5(F.col("text").cast("binary"))))
    ranges = repeated_ranges(given, scratch, length, group_bytes)
    schema = docs.select("doc_id").schema.add("n_bytes", "long")
    found = given.join(ranges, "text_id").select("doc_id", "text", "copies", "ranges")
    return found.mapInArrow(_cut(length), f"doc_id {schema[0].dataType.simpleString()}, n_bytes long, removed array<struct<lo: bigint, hi: bigint>>, kept binary")
