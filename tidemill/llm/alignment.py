"""Alignment of two tokenizers over the same texts.

Tokenizer A is byte-level, B a sentence-piece model that puts a space before a text; both read a space and
the text. Where a token of A and one of B end at the same byte, the ids before are cut into a group: each
side's cumulative ends mark the bytes of a run of strings, and the marks in both close the groups and give
the links (tokens whose bytes end together). All of it is array work on many parts at once.

Both tokenizers cut a text before a single space or line feed between other characters (A's pre-tokeniser
does, and no piece of B has a space or a line feed after another character), so a text is aligned part by
part, and a part that comes again is looked up. Runs of white space are cut only before their first character.

A link's shorter token is the end of the longer one's bytes. So the number of different linked id pairs is
bounded by the vocabularies (``pair_bound``), whatever the corpus: their counts can be broadcast.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .tokens import BYTE_LETTERS, WHITE

#: Parts kept from one slice to the next, and the longest text of one that is.
KEPT_PARTS, KEPT_CHARS = 80_000, 40
#: White space beside white space, or at either end.
TOGETHER = rf"[{WHITE} \n][{WHITE} \n]|\A[{WHITE} \n]|[{WHITE} \n]\z"
CUT = re.compile(r"(?<=\S)(?=[ \n]\s*\S)")
WHITE_IN = re.compile(r"\s")
JOINED = 64  # parts encoded as one string
ENCODED_CHARS = 1 << 16  # characters whose encodings are held at once, but for a longer string
#: Bytes of text that are aligned at once.
ALIGNED_BYTES = 1 << 19
#: Links that are looked up at once.
LINKS = 1 << 18


def a_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    from tokenizers import Tokenizer

    byte = {letter: b for b, letter in BYTE_LETTERS.items()}
    found = Tokenizer.from_file(path).get_vocab().items()
    return {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in found}


def b_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id of a sentence-piece model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return {i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}


def pair_bound(a: dict[int, bytes], b: dict[int, bytes]) -> int:
    """The most id pairs that can ever be linked: those where one token's bytes end the other's."""

    def ends_of(short, long):
        n: dict[bytes, int] = {}
        for t in short.values():
            n[t] = n.get(t, 0) + 1
        return sum(n.get(t[k:], 0) for t in long.values() for k in range(len(t)))

    same: dict[bytes, int] = {}
    for t in b.values():
        same[t] = same.get(t, 0) + 1
    return ends_of(a, b) + ends_of(b, a) - sum(same.get(t, 0) for t in a.values())


def parts_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's parts start (one entry more than texts), each part's number, the distinct parts. A
    part's first space is left out, but where white space follows."""
    texts = pc.fill_null(texts, "")
    hard = pc.match_substring_regex(texts, TOGETHER).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    count = np.where(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    own = np.repeat(~hard & (count > 0), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    cut = [[p if p[0] != " " or p[1:2] in ("", " ", "\n") else p[1:] for p in CUT.split(" " + t)] for t in texts.filter(pa.array(hard)).to_pylist()]
    count[hard] = [len(c) for c in cut]
    flat = pa.concat_arrays([lists.flatten().filter(pa.array(own)), pa.array([p for c in cut for p in c], texts.type)]).dictionary_encode()
    code, starts = flat.indices.to_numpy(zero_copy_only=False), np.append(0, np.cumsum(count))
    at = np.empty(len(code), np.int64)  # the hard texts' parts stand last
    of_hard = np.repeat(hard, count)
    at[~of_hard], at[of_hard] = np.arange(int((~of_hard).sum())), int((~of_hard).sum()) + np.arange(int(of_hard.sum()))
    return starts, code[at], flat.dictionary.to_pylist()


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each part, one part after the other."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return at


@dataclass
class Found:
    """Alignments of parts, one after the other: how many ids of A, ids of B and groups each has (one row for each of
    these), whether its bytes differ, its tokens group by group as rows of ``Aligner.written``, its linked pairs."""

    counts: np.ndarray
    bad: np.ndarray
    tokens: np.ndarray
    pairs: np.ndarray

    def take(self, at: np.ndarray) -> Found:
        size, n = self.counts[0] + self.counts[1], self.counts[2]
        tokens, pairs = (x[ragged((np.cumsum(k) - k)[at], k[at])] for x, k in ((self.tokens, size), (self.pairs, n)))
        return Found(self.counts[:, at], self.bad[at], tokens, pairs)


def none_found(n: int = 0) -> Found:
    """So many parts whose bytes differ."""
    return Found(np.zeros((3, n), np.int64), np.ones(n, bool), np.zeros(0, np.int32), np.zeros(0, np.int64))


def joined(some: list[Found]) -> Found:
    return Found(*(np.concatenate([getattr(f, c) for f in some], axis=-1) for c in ("counts", "bad", "tokens", "pairs")))


def flat_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size


def end_to_end(of: pa.Array, at: np.ndarray, cuts: np.ndarray) -> tuple[memoryview, list[int]]:
    """The values at so many places, one after the other, and where the first so many of them end."""
    if not len(at):
        return memoryview(b""), [0] * len(cuts)
    made = of.take(pa.array(at))
    return memoryview(made.buffers()[2]), np.frombuffer(made.buffers()[1], np.int64)[cuts].tolist()


class Aligner:
    """Alignment of texts by part."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        table = lambda of: [of.get(i, b"") for i in range(max(of) + 1)]
        a_of, b_of = table(a_bytes(a_path)), table(b_bytes(b_path))
        self.a_of, self.b_of = (pa.array(of, pa.large_binary()) for of in (a_of, b_of))
        self.a_size, self.b_size = (np.array([len(t) for t in of], np.int64) for of in (a_of, b_of))
        #: How an id stands in a text of groups: inside one and at its end, ids of A, then those of B.
        self.written = pa.array([f"{i}{mark}" for of, marks in ((a_of, ",|"), (b_of, ",;")) for i in range(len(of)) for mark in marks], pa.large_binary())
        self.lone = self.b.piece_to_id("▁")
        self.known: dict[str, int] = {}  # a part's number in kept
        self.kept = none_found()

    def _encoded(self, raw: list[str]):
        """(strings, ids of A, ids of B) of strings that open with a space or a line feed; few are held at a time, since
        an encoding is many times its string."""
        total = np.cumsum([len(t) for t in raw])
        cuts = np.flatnonzero(np.diff(total // ENCODED_CHARS, prepend=0)).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(raw)]):
            some = raw[lo:hi]
            if some:
                b_all = self.b.encode([t[1:] if t[0] == " " else t for t in some], num_threads=1)
                # B puts a space before a line feed; it is a token of its own.
                b_all = [b if t[0] == " " else b[1:] if b[:1] == [self.lone] else [] for t, b in zip(some, b_all)]
                yield some, [a.ids for a in self.a.encode_batch_fast(some, add_special_tokens=False)], b_all

    def _same_bytes(self, of: pa.Array, ids: np.ndarray, n: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which strings have the bytes of their ids, so many for each."""
        data, ends = end_to_end(of, ids, np.cumsum(n))
        data = bytes(data)  # compared much faster than a view
        return np.array([data[lo:hi] == t for lo, hi, t in zip([0, *ends], ends, raw)], bool)

    def _aligned(self, lists: list[list[str]]):
        """For lists of raw parts, encoded in one string each: which lists were aligned part by part, and what was found
        for their parts. The others' bytes differ, or a part of theirs ends within a token."""
        at = 0
        for some, a_lists, b_lists in self._encoded(["".join(p) for p in lists]):
            parts, at = lists[at : at + len(some)], at + len(some)
            raw, (a, n_a), (b, n_b) = [t.encode() for t in some], flat_ids(a_lists), flat_ids(b_lists)
            good = self._same_bytes(self.a_of, a, n_a, raw) & self._same_bytes(self.b_of, b, n_b, raw)
            in_part, size = np.array([len(p) for p in parts]), np.array([len(p.encode()) for some in parts for p in some], np.int64)
            while True:
                a_of, b_of = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
                a_end, b_end, end = np.cumsum(self.a_size[a_of]), np.cumsum(self.b_size[b_of]), np.cumsum(size[np.repeat(good, in_part)])
                in_a, in_b = (np.zeros(int(end[-1]) + 1 if len(end) else 1, bool) for _ in range(2))
                in_a[a_end], in_b[b_end] = True, True
                cut = ~(in_a & in_b)[end]
                if not cut.any():
                    break
                good[np.flatnonzero(good)[np.repeat(np.arange(int(good.sum())), in_part[good])[cut]]] = False
            a_last, b_last = in_b[a_end], in_a[b_end]
            a_at, b_at = np.flatnonzero(a_last), np.flatnonzero(b_last)
            # A group's ids of A stand before its ids of B.
            tokens = np.empty(len(a_of) + len(b_of), np.int32)
            tokens[np.arange(len(a_of)) + np.append(0, b_at + 1)[np.cumsum(a_last) - a_last]] = a_of * 2 + a_last
            tokens[np.arange(len(b_of)) + (a_at + 1)[np.cumsum(b_last) - b_last]] = (len(self.a_of) + b_of) * 2 + b_last
            pairs = a_of[a_at].astype(np.int64) << 32 | b_of[b_at]
            upto = [np.searchsorted(x, end, "right") for x in (a_end, b_end, a_end[a_at])]
            yield good, Found(np.array([np.diff(x, prepend=0) for x in upto], np.int64).reshape(3, -1), np.zeros(len(end), bool), tokens, pairs)

    def _learn(self, parts: list[str]) -> Found:
        """What ``_aligned`` finds for each part. Parts of a space and no other white space are encoded many in one
        string; what such a string doesn't give is encoded alone."""
        raw = [p if p[:1] in (" ", "\n") and p else " " + p for p in parts]
        plain = [bool(p) and p[0] not in " \n" and len(p) <= KEPT_CHARS and not WHITE_IN.search(p) for p in parts]
        found, order = [], []

        def learn(lists):
            left, at = [], 0
            for good, x in self._aligned([[raw[k] for k in some] for some in lists]):
                found.append(x)
                for some, ok in zip(lists[at : at + len(good)], good.tolist()):
                    (order if ok else left).extend(some)
                at += len(good)
            return left

        many = [k for k, x in enumerate(plain) if x]
        left = learn([many[k : k + JOINED] for k in range(0, len(many), JOINED)])
        bad = learn([[k] for k in left + [k for k, x in enumerate(plain) if not x]])
        place = np.empty(len(parts), np.int64)
        place[order + bad] = np.arange(len(parts))
        return joined([*found, none_found(len(bad))]).take(place)

    def align(self, texts: pa.Array):
        """(n_a, n_b, n_groups, groups as text, starts of the links, linked pairs) of all texts."""
        starts, code, parts = parts_of(texts)
        at = np.fromiter((self.known.get(p, -1) for p in parts), np.int64, len(parts))
        new = at < 0
        found = joined([self.kept, self._learn([parts[k] for k in np.flatnonzero(new).tolist()])])
        at[new] = len(self.kept.bad) + np.arange(int(new.sum()))
        more = (np.bincount(code, minlength=len(parts)) > 1) & (np.fromiter(map(len, parts), np.int64, len(parts)) <= KEPT_CHARS)
        if len(self.known) > KEPT_PARTS:  # goes on with the parts of this slice
            self.known, self.kept, more = {}, none_found(), more | ~new
        else:
            more &= new
        self.known.update(zip([parts[k] for k in np.flatnonzero(more).tolist()], range(len(self.known), len(self.known) + int(more.sum()))))
        self.kept = joined([self.kept, found.take(at[more])])

        n = len(starts) - 1
        row, lost = np.repeat(np.arange(n), np.diff(starts)), np.zeros(n, bool)
        lost[row[found.bad[at][code]]] = True
        row, code = row[~lost[row]], code[~lost[row]]
        found = found.take(at[code])
        totals = [np.bincount(row, weights=k, minlength=n).astype(np.int64) for k in found.counts]
        data, ends = end_to_end(self.written, found.tokens, np.cumsum(totals[0] + totals[1]))
        groups = [str(data[lo : hi - 1], "ascii") if lo < hi else "" for lo, hi in zip([0, *ends], ends)]
        return *totals, groups, np.append(0, np.cumsum(totals[2])), found.pairs


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The one aligner of a worker, for all its tasks. Task functions must come by it through this function: one that
    they name themselves is pickled with each task, so that every task loads its own."""
    if (a_path, b_path) not in _aligners:
        _aligners.clear()
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def let_go() -> None:
    """Frees the aligner of a worker that goes on to count links."""
    _aligners.clear()


def _align(a_path: str, b_path: str, texts: bool):
    def run(batches):
        made = aligner(a_path, b_path)
        for part in slices(batches, "text", ALIGNED_BYTES):
            gc.disable()  # millions of small lists and no cycles
            try:
                *n, groups, ends, pairs = made.align(part.column("text"))
            finally:
                gc.enable()
            digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], links, pa.array(digest, pa.string()), *([pa.array(groups, pa.string())] if texts else [])],
                ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256", *(["groups"] if texts else [])],
            )

    return run


def align(docs: DataFrame, a_path: str, b_path: str, *, texts: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links, groups_sha256) for every row of docs (doc_id, text), and with texts
    the groups themselves (``a1,a2|b1;a3|b2,b3``). links are array<long>: id of A << 32 | id of B.

    Null and empty texts, and those whose tokens' bytes are not a space and the text (B's model changes or
    lacks a character), have no tokens: zeros, no links and an empty digest. A null doc_id and repeated rows
    stay as they are; extra columns are not read; an empty table gives an empty table.
    """
    schema = "doc_id long, n_a long, n_b long, n_groups long, links array<long>, groups_sha256 string" + (", groups string" if texts else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_align(a_path, b_path, texts), schema)


def _pieces(batches, column: str):
    """Batches cut so that each has about LINKS links at most (one row at least)."""
    for batch in batches:
        total, at = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)), 0
        while at < len(total):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, "right")))
            yield batch.slice(at, end - at)
            at = end


def _tally(batches):
    """(pair, n) over a part of the rows; the pairs of a task are bounded by the vocabularies."""
    let_go()
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in _pieces(batches, "links"):
        new, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        pairs, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(pairs)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of the linked pairs of all rows: in how many links each is, and whether no other
    pair of its id of B is in more."""
    counts = aligned.select("links").mapInArrow(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.expr("pair & 4294967295")
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned with n_links, n_best and count_sum in place of links. The counts are broadcast: their rows are
    bounded by the vocabularies, not by the corpus."""
    table = counts.toArrow().sort_by("pair")
    held = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        let_go()
        pairs, n, best = held.value
        for batch in _pieces(batches, "links"):
            links = batch.column("links")
            size = pc.list_value_length(links).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pairs, links.flatten().to_numpy())
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[np.append(0, np.cumsum(size))])
            kept = [batch.column(c) for c in batch.schema.names if c != "links"]
            values = [size, total(best[at].astype(np.int64)), total(n[at])]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(x, pa.int64()) for x in values], [c for c in batch.schema.names if c != "links"] + ["n_links", "n_best", "count_sum"])

    schema = ", ".join(f"{c} {t}" for c, t in aligned.dtypes if c != "links")
    return aligned.mapInArrow(run, schema + ", n_links long, n_best long, count_sum long")


def align_counted(docs: DataFrame, scratch: Scratch, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum) for every row of docs: its
    alignment, and how often its links' id pairs are linked over all rows. Nulls and the rest as in ``align``."""
    aligned = scratch.save(align(docs, a_path, b_path), "aligned")
    return with_counts(aligned, scratch.save(pair_counts(aligned), "counts"))
