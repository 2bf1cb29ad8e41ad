"""Token ids in binary blocks, with a minimal perfect hash index for keyed access.

The format is a folder with three Parquet tables:

- ``payload``: one row per block of about a million ids, in ascending doc_id order: (part, seq, width,
  n_tokens, keys, lengths, ids). ids are raw little-endian unsigned integers of width bytes: 2, or 4 if the
  vocabulary needs them; the documents one after another, each closed by the end id.
- ``starts``: one row per block: its place in the whole stream, block_start, its sizes and its first and last key.
- ``index``: one row per index shard: a minimal perfect hash of the shard's keys (levels of bits; a key
  sits in the first level where it is alone) and, by slot, a stored fingerprint and the key's place.

A lookup hashes the key to a shard, takes the slot by rank in the bits, compares the fingerprint and
reads one slice of one block, whose stored keys settle the rare equal fingerprint: constant time, whatever
the size of the corpus.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, slices

BLOCK_TOKENS = 1 << 20
SHARD_KEYS = 1 << 14
CACHE_WORDS = 500_000
#: White space of the pre-tokeniser, without space and line feed. A text is encoded in one go where white space
#: stands beside other white space, but for two line feeds between other characters, which are two pieces.
WHITE = r"\x1c-\x1f\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHOLE = rf" [{WHITE} \n]|[{WHITE}\n] |\n[{WHITE}]|[{WHITE}]\n|\n\n\n|\n\n\z"
#: A piece that is one run of Latin letters, after a space or a line feed, and one run of ASCII marks.
PLAIN = r"^(?P<word>\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
JOINED = 256  # words that the library takes as one string


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable Latin-1 stands for itself, the other bytes for letters from U+0100 on."""
    plain = {b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)}
    return {b: chr(b) if b in plain else chr(256 + k - len([x for x in plain if x < b])) for k, b in enumerate(range(256))}


BYTE_LETTERS = _byte_letters()
SPACE, FEED = BYTE_LETTERS[32], BYTE_LETTERS[10]
WORD_LETTERS = BYTE_LETTERS | {32: " "}  # words stand apart by plain spaces

_tokenizers: dict = {}


class Encoder:
    """Ids of whole texts. A byte-level pre-tokeniser always cuts before a single space and around a single
    line feed between other characters, and between letters and marks; so texts are cut there and each
    distinct piece is encoded once a batch. Texts that hold an added token are encoded as they are, and so
    are all texts with any other pre-tokeniser or a normaliser."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id, self.cache = Tokenizer.from_file(path), end_id, {}
        spec, vocabulary = json.loads(self.tokenizer.to_str()), self.tokenizer.get_vocab()
        pre, self.added = spec["pre_tokenizer"] or {}, [a["content"] for a in spec["added_tokens"]]
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not (spec["normalizer"] or spec["truncation"] or spec["padding"])
        self.cuts = self.cuts and {SPACE, FEED} <= vocabulary.keys()
        self.dtype = np.dtype("<u2" if max([end_id, *vocabulary.values()]) < 1 << 16 else "<u4")
        if self.cuts:
            self.space, self.feed = (np.array([vocabulary[t]], self.dtype) for t in (SPACE, FEED))
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
            # A run of letters is one piece of the pre-tokeniser: only the model is left to apply.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    @classmethod
    def of(cls, path: str, end_id: int) -> Encoder:
        if (path, end_id) not in _tokenizers:
            _tokenizers[path, end_id] = cls(path, end_id)
        return _tokenizers[path, end_id]

    def _texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters; those that don't open with a line feed have a space before them."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = [w for w in words if w not in cache]
        spaced, fed = [w for w in new if w[0] != "\n"], [w for w in new if w[0] == "\n"]
        for some, before, after in ((spaced, SPACE, ""), (fed, "", " " + SPACE)):
            for k in range(0, len(some), JOINED):
                group = some[k : k + JOINED]
                letters = " ".join([w.strip("\n") for w in group]).encode().decode("latin-1").translate(WORD_LETTERS)
                ids = np.array(self.model.encode_batch_fast([before + letters.replace(" ", after + " " + before) + after], add_special_tokens=False)[0].ids, self.dtype)
                raw, size = ids.tobytes(), ids.itemsize
                if before:  # each word's first id holds its space
                    edges = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * size).tolist()
                    cache.update(zip(group, [raw[a:b] for a, b in zip(edges, edges[1:])], strict=True))
                else:  # a lone space ends each word
                    edges, feed = (np.flatnonzero(ids == self.space) * size).tolist(), self.feed.tobytes()
                    cache.update(zip(group, [feed + raw[a:b] for a, b in zip([0, *[e + size for e in edges]], edges)], strict=True))
        return [cache[w] for w in words]

    def _later(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces that don't begin a text."""
        found = pc.extract_regex(pieces, PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        word, marks = (pc.struct_field(found, k).filter(pa.array(plain)).dictionary_encode() for k in (0, 1))
        ids = pa.array(self._words(_strings(word.dictionary)), pa.large_binary()).take(word.indices)
        tails = pa.array(self._texts(_strings(marks.dictionary)), pa.large_binary()).take(marks.indices)
        others = self._texts([p if p[:1] == "\n" else " " + p for p in _strings(pieces.filter(pa.array(~plain)))])
        pool = pa.concat_arrays([pc.binary_join_element_wise(ids, tails, pa.scalar(b"", pa.large_binary())), pa.array(others, pa.large_binary())])
        place = np.empty(len(pieces), np.int64)
        place[plain], place[~plain] = np.arange(len(ids)), len(ids) + np.arange(len(others))
        return pool.take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the encoder's width and each text's number of ids, the end id included."""
        texts, n = pc.fill_null(texts, ""), len(texts)
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False) if self.cuts else np.ones(n, bool)
        for token in self.added:
            whole = whole | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(whole), "", texts)
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts, flat = starts - starts[0], lists.flatten()
        first = np.zeros(len(flat), bool)
        first[starts[:-1]] = True
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        head = flat.filter(pa.array(first)).to_pylist()
        for i, text in zip(np.flatnonzero(whole), texts.filter(pa.array(whole)).to_pylist()):
            head[i] = text
        own = pa.array([*self._texts(head), np.array([self.end_id], self.dtype).tobytes()], pa.large_binary())
        pool = pa.concat_arrays([own, self._later(rest.dictionary)]) if len(rest) else own
        code = np.empty(len(flat), np.int64)
        code[first] = np.arange(n)
        code[~first] = n + 1 + rest.indices.to_numpy(zero_copy_only=False)
        taken = pool.take(pa.array(np.insert(code, starts[1:], n)))
        edges = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if n else np.zeros(1, np.int64)
        size = np.diff(edges[np.append(0, starts[1:] + np.arange(1, n + 1))]) // self.dtype.itemsize
        return np.frombuffer(taken.buffers()[2].to_pybytes()[: edges[-1]] if edges[-1] else b"", self.dtype), size


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("width", pa.int32()), ("n_tokens", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])
BLOCK_COLUMNS = "part int, seq int, width int, n_tokens long, keys array<long>, lengths array<long>, ids binary"


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(path: str, end_id: int, block_tokens: int):
    def run(batches):
        encoder, part, seq = Encoder.of(path, end_id), TaskContext.get().partitionId(), 0
        keys, lengths, ids, held = [], [], [], 0

        def block():
            row = [part, seq, encoder.dtype.itemsize, held]
            lists = [_one(pa.concat_arrays(keys)), _one(pa.array(np.concatenate(lengths))), pa.array([np.concatenate(ids).tobytes()])]
            return pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(row, BLOCK)], *lists], schema=BLOCK)

        for batch in slices(batches, "text"):
            found, size = encoder.encode(batch.column("text"))
            keys.append(batch.column("doc_id"))
            lengths.append(size)
            ids.append(found)
            held += len(found)
            if held >= block_tokens:
                yield block()
                keys, lengths, ids, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield block()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every row's whole text and write payload, starts and index below folder.

    docs needs doc_id (an integer) and text; other columns are not read. A null text is empty: its one
    id is the end id. Rows stand in ascending doc_id order, null ids first, then by the text's hash;
    rows of one id stand side by side and share one index entry. Null ids are stored, and have no entry.
    An empty table writes tables without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
    ranged.mapInArrow(_blocks(tokenizer_path, end_id, block_tokens), BLOCK_COLUMNS).write.option("compression", "zstd").parquet(f"{folder}/payload")

    edges = [F.col("keys")[0].alias("first_key"), F.element_at("keys", -1).alias("last_key")]
    blocks = spark.read.schema(BLOCK_COLUMNS).parquet(f"{folder}/payload").select("part", "seq", "n_tokens", F.size("keys").cast("long").alias("n_docs"), *edges)
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("t0"))  # a row a task
    starts = blocks.withColumn("t1", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part").withColumn("block_start", F.col("t0") + F.col("t1"))
    starts.drop("t0", "t1").write.parquet(f"{folder}/starts")
    write_index(spark, folder)


#: A place: rows nth to nth + n_docs - 1 of a block; offset, n_tokens and start are those of the first.
PLACE = ["part", "seq", "nth", "n_docs", "offset", "n_tokens", "start"]


def _runs(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys of a block begin, and their lengths."""
    k, full = keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (full[1:] != full[:-1])))
    return first, np.diff(np.append(first, len(k)))


def _places(batches):
    for batch in batches:
        part, seq, base = (batch.column(c).to_pylist() for c in ("part", "seq", "block_start"))
        for i in range(batch.num_rows):
            n, keys = batch.column("lengths")[i].values.to_numpy(), batch.column("keys")[i].values
            nth, many = _runs(keys)
            offset = (np.cumsum(n) - n)[nth]
            row = [np.full(len(nth), part[i]), np.full(len(nth), seq[i]), nth, many, offset, n[nth], base[i] + offset]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(nth)), *[pa.array(x, pa.int64()) for x in row]], ["doc_id", *PLACE])


PLACES = "doc_id long, " + ", ".join(f"{c} long" for c in PLACE)


def places(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each block and each key in it, null too: the key and the place of its documents there."""
    blocks = spark.read.parquet(f"{folder}/payload").select("part", "seq", "keys", "lengths").join(spark.read.parquet(f"{folder}/starts").select("part", "seq", "block_start"), ["part", "seq"])
    return blocks.mapInArrow(_places, PLACES)


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray, room: float = 1.6) -> tuple[list[int], np.ndarray]:
    """Level sizes and the levels' bits, one after another, for distinct unsigned 64-bit keys."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = int(len(left) * room) + 1
        at = _level(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def find_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Each key's slot, a number below the number of keys; -1 for a key that falls through all levels."""
    slot, left, base, rank = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        at = base + _level(keys[left], level, size)
        here = bits[at]
        slot[left[here]] = rank[at[here]]
        left, base = left[~here], base + size
    return slot


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    keys = frame.doc_id.to_numpy(np.int64).view(np.uint64)
    sizes, bits = build_mph(keys)
    slot = find_slots(keys, sizes, bits)
    order = np.empty(len(keys), np.int64)
    order[slot] = np.arange(len(keys))
    row = {"shard": frame.shard.iloc[0], "n_keys": len(keys), "sizes": [sizes], "bits": np.packbits(bits).tobytes(), "fingerprints": fingerprints(keys)[order].tobytes()}
    return pd.DataFrame(row | {c: frame[c].to_numpy(np.int64)[order].tobytes() for c in PLACE}, index=[0])


INDEX = "shard long, n_keys long, sizes array<long>, bits binary, fingerprints binary, " + ", ".join(f"{c} binary" for c in PLACE)


def write_index(spark: SparkSession, folder: str, shard_keys: int = SHARD_KEYS) -> None:
    """The index shards; a shard has about shard_keys keys, so one task holds one bounded shard. A key's entry
    is its place in the first block that has it; ``continued`` tells the others."""
    stored = places(spark, folder).where(F.col("doc_id").isNotNull())
    first = stored.groupBy("doc_id").agg(F.min_by(F.struct(*PLACE), "start").alias("p"))
    shards = max(1, -(-(spark.read.parquet(f"{folder}/starts").agg(F.sum("n_docs")).first()[0] or 0) // shard_keys))
    entries = first.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "p.*")
    entries.groupBy("shard").applyInPandas(_build, INDEX).withColumn("n_shards", F.lit(shards)).write.parquet(f"{folder}/index")


def continued(spark: SparkSession, folder: str) -> DataFrame:
    """Places at the head of blocks whose first key the index has not there: the key goes on from the block
    before, or is null. n_docs is -1, for as many rows as have the key."""
    blocks = spark.read.parquet(f"{folder}/starts")
    ends = blocks.select((F.col("block_start") + F.col("n_tokens")).alias("block_start"), F.col("last_key").alias("first_key"))
    heads = blocks.join(ends, ["block_start", "first_key"], "left_semi").unionByName(blocks.where("first_key is null"))
    zero = F.lit(0).cast("long")
    return heads.select(F.col("first_key").alias("doc_id"), "part", "seq", zero.alias("nth"), (zero - 1).alias("n_docs"), zero.alias("offset"), zero.alias("n_tokens"), F.col("block_start").alias("start"))


def _find(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"doc_id": keys.doc_id.to_numpy(np.int64)})
    if not len(index) or not len(out):
        return pd.DataFrame({"doc_id": [], **{c: [] for c in PLACE}})
    x = index.iloc[0]
    k = out.doc_id.to_numpy().view(np.uint64)
    sizes = [int(s) for s in x.sizes]
    slot = find_slots(k, sizes, np.unpackbits(np.frombuffer(x.bits, np.uint8), count=sum(sizes)).astype(bool))
    hit = slot >= 0
    hit[hit] = np.frombuffer(x.fingerprints, np.uint32)[slot[hit]] == fingerprints(k)[hit]
    return out[hit].assign(**{c: np.frombuffer(x[c], np.int64)[slot[hit]] for c in PLACE})


def find(keys: DataFrame, folder: str) -> DataFrame:
    """Places of the distinct non-null keys (column doc_id) that the index has; a key that isn't stored is
    left out (a foreign key passes a fingerprint once in 2**32)."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{folder}/index")
    top = index.agg(F.max("n_shards")).first()[0] or 1
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(top)))
    return wanted.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_find, PLACES)


def _take(digest: bool):
    """Documents of blocks at their wanted places, from the ids there: their crc32, or the ids."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                width, base = batch.column("width")[i].as_py(), batch.column("block_start")[i].as_py()
                n, keys = batch.column("lengths")[i].values.to_numpy(), batch.column("keys")[i].values
                nth, many = (batch.column(c)[i].values.to_numpy().copy() for c in ("nth", "n_docs"))
                if (many < 0).any():
                    many[many < 0] = _runs(keys)[1][0]
                row = np.repeat(nth - (np.cumsum(many) - many), many) + np.arange(many.sum())
                found = keys.take(pa.array(row))
                asked = batch.column("asked")[i].values.take(pa.array(np.repeat(np.arange(len(many)), many)))
                own = pc.fill_null(pc.equal(asked, found), True).to_numpy(zero_copy_only=False)  # a fingerprint may err
                row, found = row[own], found.filter(pa.array(own))
                offset = (np.cumsum(n) - n)[row]
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), f"<u{width}").astype("<u4")
                spans = list(zip(offset.tolist(), (offset + n[row]).tolist()))
                if digest:
                    raw = memoryview(ids.tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64())
                else:
                    last = pa.array([ids[a:b].tolist() for a, b in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([found, pa.array(base + offset), pa.array(n[row]), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "token_ids"])

    return run


def _fetch(at: DataFrame, folder: str, digest: bool) -> DataFrame:
    """The documents at places: each block that has some is joined once with its places."""
    spark = at.sparkSession
    by_block = at.groupBy("part", "seq").agg(F.collect_list(F.struct("nth", F.struct("doc_id", "n_docs").alias("x"))).alias("p"))  # of one block
    wanted = by_block.select("part", "seq", F.col("p.nth").alias("nth"), F.col("p.x.n_docs").alias("n_docs"), F.col("p.x.doc_id").alias("asked"))
    blocks = spark.read.parquet(f"{folder}/payload").select("part", "seq", "width", "keys", "lengths", "ids")
    starts = spark.read.parquet(f"{folder}/starts").select("part", "seq", "block_start")
    last = "ids_crc32 long" if digest else "token_ids array<long>"
    return blocks.join(wanted.join(starts, ["part", "seq"]), ["part", "seq"]).mapInArrow(_take(digest), f"doc_id long, start long, n_tokens long, {last}")


def read_back(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document of the keys: the index gives each key's
    place, and the ids there are read. All rows of one id come back; so do all rows without an id, which
    have no entry and are found at the heads of blocks."""
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rest = continued(keys.sparkSession, folder)
    more = rest.join(wanted, "doc_id", "left_semi").union(rest.where("doc_id is null"))
    return _fetch(find(wanted, folder).unionByName(more), folder, digest=True)


def read_tokens(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, token_ids) of the keys' first stored documents, by the index."""
    first = find(keys, folder).withColumn("n_docs", F.lit(1).cast("long"))
    return _fetch(first, folder, digest=False).drop("n_tokens")
