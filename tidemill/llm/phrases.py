"""Collocations: phrases of two and three words that stand together more often than their parts suggest.

Texts are cut into pieces at marks and line ends and into words once; each slice of texts keeps its
distinct words and the words' numbers by place. Then level by level (Apriori: a phrase is as frequent as the
rarest of its parts at most):

1. words are counted exactly;
2. places whose two words are frequent are counted by hash into a filter of a fixed number of bits, one for
   each hash that can belong to a frequent pair; the same for three words, where both pairs pass;
3. the distinct phrases at the places that pass are the candidates: no frequent phrase is missing;
4. candidates are dealt by hash over double-array tries of a bounded size, which are broadcast a few at a
   time. The phrases of a slice, with their occurrences in it, are laid apart by the tries that they are dealt
   to; they go through these at once, word by word, and occurrences are counted at the states that end a
   phrase; counts are added over the slices. This count is exact: words are compared as strings.

A filter has a fixed size and a trie at most about ``TRIE_PHRASES`` phrases, so nothing that is broadcast
grows with the texts; what grows is the number of passes of step 4, one for each ``TOGETHER`` tries. A pass reads
the phrases of its own tries alone. Slices are large rows, so few of them pass to Python at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix64, slices, small_batches
from .tries import ROOT, Trie

MARKS = r"[.,;:!?\n-\r]+"
LEAST = 10  # occurrences of a candidate
WITHIN = 50  # per cent of a phrase's occurrences that lie inside one longer candidate, from which it is dropped
FILTER_BITS = 27
BLOCK_BITS = 16  # of a filter's bits, those that one task adds up together
TRIE_PHRASES = 1 << 16
TOGETHER = 16
SLOTS = 1 << 14  # states of a trie whose counts are added up together
SLICE = 6 << 20  # bytes of text of a slice
MOST = 255  # counted of a hash at once; a hash is frequent from fewer on
FLUSH = 1 << 22  # hashes that a task gathers before it writes their counts
FILE_SLICES = 16  # of a file; Spark reads a file's rows into memory together
STRIDE = 1 << 18  # phrases that walk together
_C = np.uint64(0x9E3779B97F4A7C15)

SLICED = "lang string, n long, words array<string>, places binary"
SPOTTED = "part long, lang string, words array<string>, codes binary, tries binary, counts binary"


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, A-Z in lower case, and their numbers by place, -1 where a piece ends."""
    texts = pc.replace_substring_regex(pc.binary_join_element_wise(pc.fill_null(texts, ""), ";", ""), MARKS, " ; ")
    flat = pc.ascii_split_whitespace(pc.ascii_lower(texts)).flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    place, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    end = pc.index(words, ";").as_py()  # stands after every text
    if end >= 0:
        place = np.where(place == end, -1, place - (place > end)).astype(np.int32)
        words = pa.concat_arrays([words.slice(0, end), words.slice(end + 1)])
    return words, place


def _sliced(batches):
    for part in slices(batches, "text", SLICE):
        langs = pc.fill_null(part.column("lang"), "und")
        for lang in pc.unique(langs).to_pylist():
            words, place = cut_words(part.column("text").filter(pc.equal(langs, lang)))
            n = int((place >= 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int64()), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([place.tobytes()], pa.binary())], ["lang", "n", "words", "places"])


def _rows(batches):
    """(lang, distinct words, places) of each slice."""
    for batch in batches:
        for k in range(batch.num_rows):
            words = batch.column("words").slice(k, 1).flatten()
            yield batch.column("lang")[k].as_py(), words, np.frombuffer(batch.column("places")[k].as_buffer(), np.int32)


def _word_counts(batches):
    for lang, words, place in _rows(batches):
        n = np.bincount(place[place >= 0], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(words), np.int64))), words, pa.array(n, pa.int64())], ["lang", "word", "n"])


def hash_of(lang: str, words: pa.Array) -> np.ndarray:
    return mix64(hash_words(words) ^ hash_words(pa.array([lang]))[0])


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left * _C + right)


class Passing:
    """Filters of the hashes of frequent words, pairs and triples, as far as they are known."""

    def __init__(self, filters: list[np.ndarray]):
        self.filters, self.shift = filters, np.uint64(64 - FILTER_BITS)

    def has(self, level: int, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.filters[level][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def runs(self, lang: str, words: pa.Array, place: np.ndarray):
        """(starts, hashes) of the places where a pair, and then a triple, can be frequent."""
        h = hash_of(lang, words)
        good = np.append(self.has(0, h), False)[place]  # -1: not a word
        at = np.flatnonzero(good[:-1] & good[1:])
        pair = joined(h[place[at]], h[place[at + 1]])
        if len(self.filters) > 1:
            keep = self.has(1, pair)
            at, pair = at[keep], pair[keep]
        yield at, pair
        if len(self.filters) > 1:
            k = np.flatnonzero(np.diff(at) == 1)  # pairs that overlap
            triple = joined(pair[k], h[place[at[k] + 2]])
            if len(self.filters) > 2:
                keep = self.has(2, triple)
                k, triple = k[keep], triple[keep]
            yield at[k], triple


def _by_block(key: np.ndarray, n: np.ndarray, size: int, kind=np.uint32) -> pa.RecordBatch:
    """Rows (block, lows, counts) of sorted keys; a block has 2 ** 16 keys at most."""
    block = key // size
    edge = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    low, n = (key % size).astype(np.uint16), n.astype(kind, copy=False)
    cut = list(zip(edge[:-1], edge[1:]))
    return pa.RecordBatch.from_arrays(
        [pa.array(block[edge[:-1]].astype(np.int64)), pa.array([low[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([n[a:b].tobytes() for a, b in cut], pa.binary())],
        ["block", "lows", "counts"],
    )


BLOCKS = "block long, lows binary, counts binary"


def _added(batches, size: int, kind=np.uint32):
    """(block, sums) from rows sorted by block; one block's sums are held at a time."""
    block, sums = None, None
    for batch in batches:
        for k, b in enumerate(batch.column("block").to_pylist()):
            if b != block:
                if block is not None:
                    yield block, sums
                block, sums = b, np.zeros(size, np.int64)
            sums[np.frombuffer(batch.column("lows")[k].as_buffer(), np.uint16)] += np.frombuffer(batch.column("counts")[k].as_buffer(), kind)
    if block is not None:
        yield block, sums


def _hash_counts(hashes_of):
    """Counts by filter bit of the hashes that each slice gives."""

    def run(batches):
        held, n = [], 0

        def flush():
            bit = np.concatenate(held)
            held.clear()
            bit.sort()
            first = np.flatnonzero(np.append(True, bit[1:] != bit[:-1]))
            count = np.minimum(np.diff(np.append(first, len(bit))), MOST).astype(np.uint8)
            return _by_block(bit[first], count, 1 << BLOCK_BITS, np.uint8)

        for row in _rows(batches):
            held.append((hashes_of(*row) >> np.uint64(64 - FILTER_BITS)).astype(np.uint32))
            n += len(held[-1])
            if n >= FLUSH:
                yield flush()
                n = 0
        if n:
            yield flush()

    return run


def _bits(least: int):
    def run(batches):
        for block, sums in _added(batches, 1 << BLOCK_BITS, np.uint8):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    return run


def _filter(counts: DataFrame, least: int) -> np.ndarray:
    """The filter's bits: 2 ** FILTER_BITS of them, whatever the texts."""
    made = counts.repartition("block").sortWithinPartitions("block").mapInArrow(_bits(least), "block long, bits binary")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for r in made.toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _spotted(passing: Passing, lang: str, words: pa.Array, place: np.ndarray):
    """(words a phrase, starts, hashes, occurrences) of a slice's distinct phrases at the places that pass."""
    for size, (at, h) in enumerate(passing.runs(lang, words, place), 2):
        h, first, same = np.unique(h, return_index=True, return_inverse=True)
        other = np.zeros(len(at), bool)  # equal hashes of different words: each place by itself
        for j in range(size):
            other |= place[at + j] != place[at[first] + j][same]
        n, lone = np.bincount(same[~other], minlength=len(first)), np.flatnonzero(other)
        yield size, np.append(at[first], at[lone]), np.append(h, h[same[lone]]), np.append(n, np.ones(len(lone), np.int64))


def _candidates(passing):
    """(phrase): the language and the phrase, with a tab, of each slice's distinct phrases at the places that pass."""

    def run(batches):
        for lang, words, place in _rows(batches):
            for size, at, _, _ in _spotted(passing.value, lang, words, place):
                for k in range(0, len(at), 1 << 16):
                    start = at[k : k + (1 << 16)]
                    phrase = pc.binary_join_element_wise(*[words.take(pa.array(place[start + j])) for j in range(size)], " ")
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.scalar(lang), phrase, "\t")], ["phrase"])

    return run


def _laid_apart(passing, n_tries: int, together: int):
    """The distinct phrases of each slice, by the tries that are broadcast together: as three numbers of words each
    (-1: no third one), all first words before all second ones, with their tries and occurrences."""

    def run(batches):
        for lang, words, place in _rows(batches):
            codes, tries, counts = [], [], []
            for size, at, h, n in _spotted(passing.value, lang, words, place):
                codes.append(np.stack([place[at + j] if j < size else np.full(len(at), -1, np.int32) for j in range(3)]))
                tries.append(trie_of(h, n_tries).astype(np.int32))
                counts.append(n.astype(np.int32))
            codes, tries, counts = np.concatenate(codes, axis=1), np.concatenate(tries), np.concatenate(counts)
            order = np.argsort(tries, kind="stable")
            tries = tries[order]
            edge = np.searchsorted(tries, np.arange(0, n_tries + together, together))
            for part in np.flatnonzero(np.diff(edge)):
                here = order[edge[part] : edge[part + 1]]
                mine = codes[:, here]
                used = np.zeros(len(words) + 1, bool)
                used[mine] = True
                used[-1] = False
                number = np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)
                raw = [number[mine], tries[edge[part] : edge[part + 1]], counts[here]]
                kept = pa.ListArray.from_arrays(pa.array([0, int(used.sum())], pa.int32()), words.take(pa.array(np.flatnonzero(used))))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([lang]), kept, *[pa.array([x.tobytes()], pa.binary()) for x in raw]], ["part", "lang", "words", "codes", "tries", "counts"])

    return run


def _dealt(n_tries: int):
    """(trie, lang, phrase) of candidates."""

    def run(batches):
        for batch in batches:
            pairs = [x.rsplit("\t", 1) for x in batch.column("phrase").to_pylist()]  # no word has a tab
            if not pairs:
                continue
            lang, phrase = (pa.array(x, pa.string()) for x in zip(*pairs))
            lists = pc.split_pattern(phrase, " ")
            size, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
            h, start = np.zeros(len(flat), np.uint64), np.cumsum(size) - size
            of = lang.take(pa.array(np.repeat(np.arange(len(size)), size)))
            for x in pc.unique(lang).to_pylist():
                mine = pc.equal(of, x)
                h[mine.to_numpy(zero_copy_only=False)] = hash_of(x, flat.filter(mine))
            pair = joined(h[start], h[start + 1])
            whole = np.where(size > 2, joined(pair, h[start + size - 1]), pair)
            yield pa.RecordBatch.from_arrays([pa.array(trie_of(whole, n_tries)), lang, phrase], ["trie", "lang", "phrase"])

    return run


def trie_of(h: np.ndarray, n_tries: int) -> np.ndarray:
    """The trie that a phrase is dealt to by its hash."""
    return ((h >> np.uint64(1)) % np.uint64(n_tries)).astype(np.int64)


def packed(values) -> bytes:
    """An array as compressed bytes."""
    out = pa.BufferOutputStream()
    table = pa.table({"x": pa.array(values)})
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all()["x"].combine_chunks()


def _built(radix: int):
    """One trie's phrases with their last states, and in a first row the trie itself."""

    def run(key, table):
        table = table.sort_by([("lang", "ascending"), ("phrase", "ascending")])
        langs, phrases = table["lang"].combine_chunks(), table["phrase"].combine_chunks()
        lists = pc.split_pattern(phrases, " ")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        both = pc.binary_join_element_wise(langs.take(pa.array(np.repeat(np.arange(len(size)), size))), lists.flatten(), "\t").dictionary_encode()  # no word has a tab
        codes, symbol = np.full((len(size), 3), -1, np.int64), both.indices.to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        for j in range(3):
            has = np.flatnonzero(size > j)
            codes[has, j] = symbol[start[has] + j]
        trie, n = Trie(codes, radix), len(size)
        head = lambda x, kind: pa.array([x] + [None] * n, kind)
        below = lambda x: pa.concat_arrays([pa.array([None], x.type), x])
        return pa.table({
            "trie": pa.array([key[0].as_py()] * (n + 1), pa.int64()), "state": below(pa.array(trie.ends, pa.int64())), "lang": below(langs), "phrase": below(phrases),
            "base": head(packed(trie.base), pa.binary()), "check": head(packed(trie.check), pa.binary()), "ends": head(packed(trie.ends.astype(np.int32)), pa.binary()),
            "symbols": head(packed(both.dictionary), pa.binary()),
        })

    return run


BUILT = "trie long, state long, lang string, phrase string, base binary, check binary, ends binary, symbols binary"


class Walk:
    """A few tries over one alphabet of words by language. Holds arrays alone, no object for each word."""

    def __init__(self, rows: list, n_tries: int, radix: int):
        """rows: (trie, base, check, ends, symbols) of each of the tries that are here, of n_tries in all."""
        symbols = [unpacked(r.symbols) for r in rows]
        shared = pa.concat_arrays(symbols).dictionary_encode()
        code, cut = shared.indices.to_numpy(zero_copy_only=False), np.append(0, np.cumsum([len(x) for x in symbols]))
        both = pc.split_pattern(shared.dictionary, "\t", max_splits=1, reverse=True).flatten()
        n = len(shared.dictionary)
        langs, words = both.take(pa.array(np.arange(0, 2 * n, 2))), both.take(pa.array(np.arange(1, 2 * n, 2)))
        self.known = {}
        for lang in pc.unique(langs).to_pylist():
            at = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
            self.known[lang] = (at, words.take(pa.array(at)))
        self.trie, self.roots = Trie.together([(lambda r=r: (unpacked(r.base).to_numpy(), unpacked(r.check).to_numpy())) for r in rows], radix)
        self.own = np.full((len(rows), n), -1, np.int32)  # each trie's own codes
        self.at = np.full(n_tries, -1)  # where each trie is, if it is here
        ends = []
        for k, r in enumerate(rows):
            self.own[k, code[cut[k] : cut[k + 1]]] = np.arange(cut[k + 1] - cut[k])
            ends.append(np.sort(self.roots[k] + unpacked(r.ends).to_numpy()))
            self.at[r.trie] = k
        self.ends = np.concatenate(ends)  # the states that end a phrase
        self.end = np.full(len(self.trie.check), -1, np.int32)  # a state's place in ends
        self.end[self.ends] = np.arange(len(self.ends))
        self.numbers, self.sums = np.array([r.trie for r in rows]), np.zeros(len(self.ends), np.int64)

    def count(self, lang: str, words: pa.Array, codes: np.ndarray, tries: np.ndarray, counts: np.ndarray) -> None:
        """Adds phrases, as numbers of words (3, phrases), -1 for no third one, with their tries and occurrences, to the sums."""
        if lang not in self.known:
            return
        at, value_set = self.known[lang]
        found = pc.index_in(words, value_set=value_set)
        code = np.append(np.where(found.is_valid().to_numpy(zero_copy_only=False), at[pc.fill_null(found, 0).to_numpy()], -1), -1)
        for k in range(0, len(tries), STRIDE):
            some = codes[:, k : k + STRIDE]
            self._walk(code[some], some[2] >= 0, self.at[tries[k : k + STRIDE]], counts[k : k + STRIDE])

    def _walk(self, code: np.ndarray, long: np.ndarray, which: np.ndarray, n: np.ndarray) -> None:
        """All phrases at once, each through its trie."""
        on = np.flatnonzero((which >= 0) & (code[0] >= 0) & (code[1] >= 0) & ((code[2] >= 0) | ~long))
        states = self.roots[which[on]]
        for j in range(3):
            moved = on if j < 2 else on[long[on]]
            ahead = self.trie.step(states if j < 2 else states[long[on]], self.own[which[moved], code[j, moved]])
            if j < 2:
                on, states = on[ahead >= 0], ahead[ahead >= 0]
            else:
                on, states = np.append(on[~long[on]], moved[ahead >= 0]), np.append(states[~long[on]], ahead[ahead >= 0])
        end = self.end[states]
        np.add.at(self.sums, end[end >= 0], n[on[end >= 0]])

    def counted(self) -> pa.RecordBatch:
        """The sums of all phrases that occurred, by trie and state."""
        at = np.flatnonzero(self.sums)
        trie = np.searchsorted(self.roots, self.ends[at], "right") - 1
        return _by_block((self.numbers[trie] << 32) + self.ends[at] - self.roots[trie], self.sums[at], SLOTS, np.int64)


def _walked(tries, n_tries: int, radix: int):
    def run(batches):
        walk = Walk(tries.value, n_tries, radix)
        for batch in batches:
            for k in range(batch.num_rows):
                codes, of, n = (np.frombuffer(batch.column(x)[k].as_buffer(), np.int32) for x in ("codes", "tries", "counts"))
                walk.count(batch.column("lang")[k].as_py(), batch.column("words").slice(k, 1).flatten(), codes.reshape(3, -1), of, n)
        yield walk.counted()

    return run


def _unpacked(batches):
    for block, sums in _added(batches, SLOTS, np.int64):
        at = np.flatnonzero(sums)
        key = block * SLOTS + at
        yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(sums[at])], ["trie", "state", "a"])


def count_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, trie_phrases: int = TRIE_PHRASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of two and three words that occur least times or more (MOST at most),
    (lang, word, n) of the words that do, and (lang, n) of all words, over docs (text, lang)."""
    if not 1 <= least <= MOST:
        raise ValueError(f"least must lie between 1 and {MOST}")
    sliced = scratch.save(docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_sliced, SLICED), "sliced", most=FILE_SLICES)
    with small_batches(scratch.spark):
        return _counted(sliced, scratch, least, trie_phrases)


def _counted(sliced: DataFrame, scratch: Scratch, least: int, trie_phrases: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    context = scratch.spark.sparkContext
    totals = scratch.save(sliced.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = sliced.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = scratch.save(words.where(F.col("n") >= least), "words")

    def word_bits(batches):
        for batch in batches:
            lang, word = batch.column("lang"), batch.column("word")
            h = [hash_of(x, word.filter(pc.equal(lang, x))) for x in pc.unique(lang).to_pylist()]
            if h:
                bit = np.unique(np.concatenate(h) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                yield _by_block(bit, np.ones(len(bit)), 1 << BLOCK_BITS, np.uint8)

    filters = [_filter(words.mapInArrow(word_bits, BLOCKS), 1)]
    for level in (0, 1):
        passing = context.broadcast(Passing(filters))
        hashes = _hash_counts(lambda *row, level=level, passing=passing: list(passing.value.runs(*row))[level][1])
        filters = [*filters, _filter(sliced.mapInArrow(hashes, BLOCKS), least)]
        passing.destroy()
    passing = context.broadcast(Passing(filters))
    found = scratch.save(sliced.mapInArrow(_candidates(passing), "phrase string").distinct(), "candidates")

    together = TOGETHER
    n_tries = max(together, -(-found.count() // trie_phrases))
    spotted = scratch.save(sliced.mapInArrow(_laid_apart(passing, n_tries, together), SPOTTED), "spotted", "part")
    passing.destroy()
    scratch.drop("sliced")
    built = scratch.save(found.mapInArrow(_dealt(n_tries), "trie long, lang string, phrase string"), "dealt")
    scratch.drop("candidates")
    largest = built.groupBy("trie").count().agg(F.max("count")).first()[0] or 0
    radix = int(np.sqrt(3 * largest)) + 1  # a phrase has three words at most
    built = scratch.save(built.groupBy("trie").applyInArrow(_built(radix), BUILT), "tries")
    scratch.drop("dealt")
    sums, schema = [], "trie long, state long, a long"
    for part, k in enumerate(range(0, n_tries, together)):
        some = built.where((F.col("trie") >= k) & (F.col("trie") < k + together) & F.col("base").isNotNull())
        rows = some.select("trie", "base", "check", "ends", "symbols").collect()  # tries of a bounded size, so many
        if not rows:
            continue
        tries = context.broadcast(rows)
        added = spotted.where(F.col("part") == part).mapInArrow(_walked(tries, n_tries, radix), BLOCKS)
        added = added.repartition("block").sortWithinPartitions("block").mapInArrow(_unpacked, schema)
        scratch.save(added, f"sums-{part}")
        sums.append(scratch.path(f"sums-{part}"))
        tries.destroy()
    scratch.drop("spotted")
    phrases = built.where("state is not null").select("trie", "state", "lang", "phrase")
    if not sums:
        return phrases.select("lang", "phrase", F.lit(0).cast("long").alias("a")).where("false"), words, totals
    counted = phrases.join(scratch.spark.read.schema(schema).parquet(*sums), ["trie", "state"]).where(F.col("a") >= least)
    return scratch.save(counted.select("lang", "phrase", "a"), "counted"), words, totals


def collocations(docs: DataFrame, scratch: Scratch, *, least: int = LEAST, within: int = WITHIN, top: int = 2000, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first top phrases by score, a descending and
    phrase, over docs (text, lang).

    A-Z is lower-cased; marks .,;:!? and line ends separate pieces, space and tab words; nothing reaches over
    a piece. a counts the phrase's occurrences, l and r those of its two parts at the cut with the lowest
    score floor(1000000 * a * a / (l * r)), the first of equal ones; n counts the language's words. Phrases
    of which within per cent or more lie inside one longer candidate are left out. A null text has no words,
    a null lang is ``und``; repeated rows count each time; extra columns are not read; an empty table gives
    an empty table. Counts are exact; a * a * 1000000 must stay below 10 ** 38.
    """
    phrases, words, totals = count_phrases(docs, scratch, least, trie_phrases)
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).union(words.select("lang", "word", "n"))
    w = F.split("phrase", " ")
    n = F.size(w)
    side = lambda start, length: F.array_join(F.slice(w, start, length), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), n - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 1, n - F.col("k")).alias("right"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    big = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({big('a')} * {big('a')} * cast(1000000 as decimal(7, 0))) div ({big('l')} * {big('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = phrases.where(n == 3).select("lang", F.explode(F.array(side(F.lit(1), F.lit(2)), side(F.lit(2), F.lit(2)))).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < within * F.col("a"), F.lit(True)))
    kept = scratch.save(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "kept")

    # Ranks without one task for a language: rows sorted over all tasks, and how many of a language stand before.
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    laid = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = scratch.save(laid.withColumn("place", F.monotonically_increasing_id()).withColumn("task", F.shiftright("place", 33)), "laid")
    size = laid.groupBy("lang", "task").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("lang").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.select("lang", "task", "first", before.alias("before")).where(F.col("before") < top)  # few tasks have a language's first rows
    ranked = laid.join(size, ["lang", "task"]).withColumn("rank", F.col("before") + F.col("place") - F.col("first") + 1).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
