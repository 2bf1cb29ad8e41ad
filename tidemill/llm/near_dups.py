"""Near duplicates by a chosen-path set similarity join.

Documents become sets of word shingles; equal sets are one class from then on. A class has minwise
tokens; independent trees branch the classes down: a node picks one token position, and now and then a
second one, so that a pair at the threshold keeps about one common path. Classes that share a node are
compared by sketch; likely pairs are confirmed on the full sets of their texts; links close to
components.

Nodes are counted before rows meet: a small node is compared exhaustively in one task; a large one
(copies of one text with edits) first meets a few pivots, and what pivots have joined needs no more
comparing. Only in large nodes whose members are still in different components, the members outside
the node's main component are compared with all others on their full sets, block by block; both sides of
a block are bounded. Where that would be too many pairs, the node first branches on in several trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix64, slices, words
from .components import components

TOKENS = 64
TREES = 10
SMALL = 64  # classes of a node that one task compares among themselves
CHUNK = 1024  # classes of a chunk of a node that isn't small
CHUNK_SHINGLES = 1 << 20  # shingles of a chunk, but for a single longer text
WIDE_TREES = 4  # trees below a wide node; two levels of one lose a pair at the threshold in 0.27 of cases
NEEDED = 1_000_000  # ids up to which the documents to compare are picked by a broadcast
PIVOTS = 8
#: Sketches: the low 4 bits of 64 minwise tokens. At similarity 0.8 a pair differs in 26 bits on average
#: (deviation 7); pairs up to FAR bits are confirmed on the texts.
FAR = 58
SKETCH = ["s0", "s1", "s2", "s3"]

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**63, TOKENS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, TOKENS, dtype=np.int64).astype(np.uint64) * np.uint64(2)
_C = np.uint64(0x9E3779B97F4A7C15)
ROWS = 4096  # rows handled at once, so that row number and hash share 64 bits
SHIFT = np.uint64(12)


def shingle_keys(texts: pa.Array, size: int) -> np.ndarray:
    """Sorted distinct (row << 52 | hash of a shingle) of at most ROWS texts."""
    starts, ids, distinct = words(texts, lower=True)
    h, n = hash_words(distinct)[ids], len(ids)
    count = np.diff(starts)
    row = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            run = run * _C + mix64(h[j : n - size + 1 + j] + np.uint64(j)) if n >= size else run
        ends = np.repeat(starts[1:], count)
        at = np.flatnonzero(np.arange(n) + size <= ends)
        keys = [row[at] << np.uint64(52) | mix64(run[at]) >> SHIFT]
        short = np.flatnonzero((count > 0) & (count < size))
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            more = count[short] > j
            whole[more] = whole[more] * _C + mix64(h[starts[short[more]] + j] + np.uint64(j))
        keys.append(short.astype(np.uint64) << np.uint64(52) | mix64(whole + count[short].astype(np.uint64)) >> SHIFT)
    return np.unique(np.concatenate(keys))


def _parts(batches, column):
    for part in slices(batches, column):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def _signatures(size: int):
    def run(batches):
        import xxhash

        for part in _parts(batches, "text"):
            n = part.num_rows
            keys = shingle_keys(part.column("text"), size)
            starts = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(52))
            count = np.diff(starts)
            plain = keys & np.uint64((1 << 52) - 1)
            view = memoryview(plain.tobytes())
            ids = [xxhash.xxh3_128_digest(view[8 * a : 8 * b]) if b > a else None for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            tokens = np.zeros((n, TOKENS), np.uint32)
            full = np.flatnonzero(count)
            if len(full):
                mixed, held = mix64(plain), np.empty(len(plain), np.uint64)
                for i in range(TOKENS):
                    np.multiply(mixed, _A[i], out=held)
                    np.add(held, _B[i], out=held)
                    tokens[full, i] = np.minimum.reduceat(held, starts[:-1][full]) >> np.uint64(32)
            raw = tokens.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(count, pa.int64()), pa.array([raw[i * 4 * TOKENS : (i + 1) * 4 * TOKENS] if c else None for i, c in enumerate(count)], pa.binary())],
                ["doc_id", "set_id", "n_shingles", "tokens"],
            )

    return run


def _sketch(tokens: np.ndarray) -> list[np.ndarray]:
    low = (tokens & 15).astype(np.uint64)
    return [np.bitwise_or.reduce(low[:, 16 * k : 16 * k + 16] << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64) for k in range(4)]


def branch(tokens: np.ndarray, node: np.ndarray, row: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, row) after so many levels. A node picks its token position from its own hash,
    and a second one a quarter of the time: 1/0.8 positions on average."""
    with np.errstate(over="ignore"):
        for _ in range(levels):
            u = mix64(node ^ np.uint64(0x5851F42D4C957F2D))
            first, second = u % np.uint64(TOKENS), (u >> np.uint64(20)) % np.uint64(TOKENS)
            more = np.flatnonzero(((u >> np.uint64(40)) % np.uint64(4) == 0) & (first != second))
            at, keep = np.concatenate([first, second[more]]), np.concatenate([np.arange(len(node)), more])
            node, row = node[keep], row[keep]
            node = mix64(node * _C + mix64(tokens[row, at.astype(np.int64)].astype(np.uint64) << np.uint64(8) | at))
    return node, row


def _paths(levels: float, trees: int):
    """Rows of the nodes that each set reaches, from its own node if it has one, else from the roots."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(n, TOKENS)
            ids, size, sketch = batch.column("id").to_numpy(), batch.column("size").to_numpy(), _sketch(tokens)
            if "node" in batch.schema.names:
                top = batch.column("node").to_numpy().view(np.uint64)
                tree = mix64(np.arange(1, trees + 1, dtype=np.uint64) * _C)
                node, row = branch(tokens, mix64(np.repeat(top, trees) ^ np.tile(tree, n)), np.repeat(np.arange(n), trees), levels)
            else:
                # The part of a level goes to so many of the trees.
                roots, deep = mix64(np.arange(1, trees + 1, dtype=np.uint64)), round(trees * (levels % 1))
                cut = [branch(tokens, np.repeat(r, n), np.tile(np.arange(n), len(r)), int(levels) + more) for r, more in ((roots[:deep], 1), (roots[deep:], 0)) if len(r)]
                node, row = (np.concatenate(x) for x in zip(*cut))
            for at in range(0, len(node), 1 << 17):
                r = row[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(node[at : at + (1 << 17)].view(np.int64)), pa.array(ids[r]), pa.array(size[r]), *[pa.array(s[r]) for s in sketch]], ["node", "id", "size", *SKETCH])

    return run


ROW = "node long, id long, size long, " + ", ".join(f"{s} long" for s in SKETCH)


def _compare(batches):
    """Pairs of likely similar rows of one node, from rows sorted by node; ``best`` marks, for each row,
    its nearest among the rows before it."""
    held = None

    def pairs(t: pa.RecordBatch):
        node, ids = t.column("node").to_numpy(), t.column("id").to_numpy()
        s = [t.column(c).to_numpy().view(np.uint64) for c in SKETCH]
        a, b, far = [], [], []
        at, k = np.arange(len(node)), 0
        while True:
            k += 1
            at = at[at + k < len(node)]
            at = at[node[at] == node[at + k]]
            if not len(at):
                break
            d = sum(np.bitwise_count(x[at] ^ x[at + k]).astype(np.int64) for x in s)
            near = at[d <= FAR]
            a.append(near)
            b.append(near + k)
            far.append(d[d <= FAR])
        if not a:
            return None
        a, b, far = map(np.concatenate, (a, b, far))
        order = np.lexsort((a, far, b))
        a, b = a[order], b[order]
        best = np.ones(len(b), bool)
        best[1:] = b[1:] != b[:-1]
        x, y = ids[a], ids[b]
        keep = x != y
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(best[keep])], ["a", "b", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        node = t.column("node").to_numpy()
        cut = int(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))[-1])  # the last node may go on
        if cut and (found := pairs(t.slice(0, cut))) is not None:
            yield found
        held = t.slice(cut)
    if held is not None and (found := pairs(held)) is not None:
        yield found


def _sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Each text's sorted shingle hashes."""
    out = []
    for p in _parts([part], "text"):
        keys = shingle_keys(p.column("text"), size)
        cuts = np.searchsorted(keys, np.arange(p.num_rows + 1, dtype=np.uint64) << np.uint64(52))
        plain = keys & np.uint64((1 << 52) - 1)
        out += [plain[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    both = np.zeros((len(left), len(right)), np.float32)
    words_, n = np.unique(np.concatenate([*left, *right]), return_counts=True)
    words_ = words_[n > 1]

    def grid(sets, lo, hi):
        out = np.zeros((len(sets), hi - lo), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(words_, s)
            at = at[words_[at.clip(max=len(words_) - 1)] == s] if len(words_) else at[:0]
            out[k, at[(at >= lo) & (at < hi)] - lo] = 1
        return out

    for lo in range(0, len(words_), 1 << 13):
        hi = min(lo + (1 << 13), len(words_))
        both += grid(left, lo, hi) @ grid(right, lo, hi).T
    return both


def _chunks(size: int, percent: int):
    """Links over component borders, one for each two components, between the rows outside the node's main
    component (role 1) and the others (role 0), chunk by chunk of both, from rows sorted by (node, block, chunk)."""

    def links(t: pa.RecordBatch):
        role, ids, label = (t.column(c).to_numpy() for c in ("role", "id", "label"))
        sets = _sets(t, size)
        count = np.array([len(x) for x in sets])
        ask, data = np.flatnonzero((role == 1) & (count > 0)), np.flatnonzero((role == 0) & (count > 0))
        out = []
        for lo in range(0, len(ask), 256):
            l = ask[lo : lo + 256]
            for at in range(0, len(data), 256):
                r = data[at : at + 256]
                both = _shared([sets[k] for k in l], [sets[k] for k in r])
                near = 100 * both >= percent * (count[l][:, None] + count[r][None, :] - both)
                x, y = np.nonzero(near & (label[l][:, None] != label[r][None, :]))
                out.append(np.stack([ids[l[x]], ids[r[y]], label[l[x]], label[r[y]]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        _, first = np.unique(np.sort(found[2:], axis=0), axis=1, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(found[0, first], pa.int64()), pa.array(found[1, first], pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for batch in slices(batches, "text"):
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            new = np.append(True, np.zeros(t.num_rows - 1, bool))
            for x in (t.column(c).to_numpy() for c in ("node", "block", "chunk")):
                new[1:] |= x[1:] != x[:-1]
            edge = np.append(np.flatnonzero(new), t.num_rows)
            for lo, hi in zip(edge[:-2], edge[1:-1]):
                yield links(t.slice(lo, hi - lo))
            held = t.slice(edge[-2])
        if held is not None and held.num_rows:
            yield links(held)

    return run


def _with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the text of their id. Where the ids are few enough, only those documents are shuffled."""
    ids = rows.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    if ids.count() <= NEEDED:
        texts = texts.join(F.broadcast(ids), "id", "left_semi")  # at most NEEDED ids
    return rows.join(texts, "id")


def _confirm(size: int, percent: int):
    """Of rows (a, b, side, text) sorted by a and b, the pairs whose sets are similar enough."""

    def run(batches):
        held = None

        def check(t: pa.RecordBatch):
            a, b, side = (t.column(c).to_numpy() for c in ("a", "b", "side"))
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            pair = np.cumsum(new) - 1
            # The text of a is worked out once for the pairs in a row that share it.
            texts = t.column("text")
            again = np.zeros(len(a), bool)
            again[1:] = (side[1:] == 0) & (a[1:] == a[:-1])
            sets = _sets(pa.RecordBatch.from_arrays([pc.if_else(pa.array(again), "", texts)], ["text"]), size)
            known: dict = {}
            for k in np.flatnonzero(side == 0):
                if again[k]:
                    text = texts[k].as_py()
                    sets[k] = known[text] if text in known else _sets(t.slice(k, 1), size)[0]
                else:
                    known = {} if not k or a[k] != a[k - 1] else known
                    known[texts[k].as_py()] = sets[k]
            edges = np.append(np.flatnonzero(new), len(a))
            found = np.zeros(pair[-1] + 1, bool)
            for p in range(len(found)):
                lo, hi = edges[p], edges[p + 1]
                for x in range(lo, hi):
                    for y in range(x + 1, hi):
                        if side[x] != side[y] and len(sets[x]) and len(sets[y]):
                            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                            found[p] |= 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)
            first = np.flatnonzero(new)[found]
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])

        for batch in slices(batches, "text"):
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            cut = int(np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))[-1])
            if cut:
                yield check(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield check(held)

    return run


def confirm(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids that are similar enough on the full sets of their texts."""
    pairs = scratch.save(pairs.distinct(), f"{name}-pairs")
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("id")).union(pairs.select("a", "b", F.lit(1).alias("side"), F.col("b").alias("id")))
    texts = _with_texts(sides, docs).select("a", "b", "side", "text")
    return scratch.save(texts.repartition("a", F.pmod(F.xxhash64("b"), F.lit(16))).sortWithinPartitions("a", "b", "side").mapInArrow(_confirm(size, percent), "a long, b long"), f"{name}-links")


def depth(n: int) -> float:
    """Levels after which a node holds a few unrelated classes: each level leaves about one in 40."""
    return max(2.0, np.log(max(n, 2) / 4) / np.log(40))


def near_duplicates(docs: DataFrame, scratch: Scratch, *, shingle: int = 5, percent: int = 80, trees: int = TREES, wide: int = 1 << 14, deeper: int = 2) -> DataFrame:
    """(doc_id, set_id, n_shingles, component_id, kept) for every row of docs (doc_id long, text).

    component_id is the smallest doc_id that links reach, kept whether it is the row's own. Texts without
    words have no shingles and no links. Rows of one doc_id are one document: their sets belong together.
    A row without a doc_id takes part by its text, is kept only if no row with an id is in its component,
    and has a null component_id if there is none. Extra columns are not read; an empty table gives an
    empty table. A pair at the threshold is met in one of the trees with probability over 0.995 (up to a
    billion classes); classes of equal sets are always one. A large node is searched exactly, by blocks, if
    that takes wide * wide pairs at most or it has branched on deeper times; before, it branches on in four
    trees of two levels, each time losing such a pair in 0.006 of cases.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.save(docs.mapInArrow(_signatures(shingle), "doc_id long, set_id binary, n_shingles long, tokens binary"), "sets")
    named = sets.where("set_id is not null and doc_id is not null")
    classes = scratch.save(named.groupBy("set_id").agg(F.min("doc_id").alias("id")), "classes")
    n = classes.count()
    one = scratch.save(classes.join(named.select("set_id", F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "tokens"), ["set_id", "id"]).select("id", "size", "tokens"), "tokens")
    rows = one.mapInArrow(_paths(depth(n), trees), ROW)

    sizes = rows.groupBy("node").count()
    large = scratch.save(sizes.where(F.col("count") > SMALL), "large")
    small = rows.join(large, "node", "left_anti")
    pairs = scratch.save(small.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_compare, "a long, b long, best boolean"), "pairs")
    crowd = scratch.save(rows.join(large, "node"), "crowd")
    pick = F.pmod(F.xxhash64("id"), F.lit(PIVOTS))
    pivots = crowd.groupBy("node", pick.alias("slot")).agg(F.min_by(F.struct("id", *SKETCH), F.xxhash64("id", F.lit(1))).alias("p"))
    pivots = scratch.save(pivots.groupBy("node").agg(F.collect_list("p").alias("ps")), "pivots")  # PIVOTS of a node
    bits = " + ".join(f"bit_count(p.{s} ^ {s})" for s in SKETCH)
    nearest = F.expr(f"array_min(transform(filter(ps, p -> p.id != id), p -> struct({bits} as far, p.id as pivot)))")
    stars = crowd.join(pivots, "node").select("id", nearest.alias("x")).where(F.col("x.far") <= FAR)
    stars = stars.select(F.least("id", "x.pivot").alias("a"), F.greatest("id", "x.pivot").alias("b"))
    links = confirm(pairs.where("best").select("a", "b").union(stars), docs, scratch, "first", shingle, percent)

    labels = components(links, scratch, "first-cc")
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    named_pairs = pairs.where("not best").select("a", "b").distinct().join(la, "a", "left").join(lb, "b", "left")
    open_pairs = named_pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    crowd = scratch.save(crowd.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).drop("count"), "crowd-0")
    more = confirm(open_pairs, docs, scratch, "second", shingle, percent)
    for i in range(deeper + 1):
        parts = crowd.groupBy("node", "label").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("sum"))
        mixed = parts.groupBy("node").agg(F.sum("count").alias("n"), F.sum("sum").alias("size_n"), F.max_by(F.struct("label", "count", "sum"), F.struct("count", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        mixed = mixed.select("node", "n", "size_n", F.col("m.label").alias("main"), (F.col("n") - F.col("m.count")).alias("n_ask"), (F.col("size_n") - F.col("m.sum")).alias("size_ask"))
        mixed = scratch.save(mixed, f"mixed-{i}")
        few = F.col("n_ask").cast("double") * F.col("n") <= float(wide) ** 2
        here = mixed.where(few) if i < deeper else mixed
        chunks = lambda n, size: F.ceil(F.greatest(F.col(n) / CHUNK, F.col(size) / CHUNK_SHINGLES)).cast("int")
        cut = crowd.join(here, "node").withColumn("k", chunks("n", "size_n")).withColumn("ka", chunks("n_ask", "size_ask"))
        part = lambda seed, k: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(k)).cast("int")
        data = cut.select("node", F.explode(F.expr("sequence(0, ka - 1)")).alias("block"), part(2, "k").alias("chunk"), "id", "label", F.lit(0).alias("role"))
        ask = cut.where("label != main").select("node", part(3, "ka").alias("block"), F.explode(F.expr("sequence(0, k - 1)")).alias("chunk"), "id", "label", F.lit(1).alias("role"))
        meet = _with_texts(scratch.save(data.union(ask), f"meet-{i}"), docs).repartition("node", "block", "chunk").sortWithinPartitions("node", "block", "chunk")
        found = meet.select("node", "block", "chunk", "id", "label", "role", "text").mapInArrow(_chunks(shingle, percent), "a long, b long")
        more = more.union(scratch.save(found, f"meet-links-{i}"))
        if i == deeper or mixed.where(~few).isEmpty():
            break
        below = crowd.join(mixed.where(~few), "node").select("node", "id").join(one, "id").mapInArrow(_paths(2, WIDE_TREES), ROW)
        crowd = scratch.save(below.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), f"crowd-{i + 1}")
    every = labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more)
    final = components(every, scratch, "final-cc").withColumnRenamed("label", "component_id")

    joined = scratch.save(classes.join(final, "id", "left").select("set_id", F.coalesce("component_id", "id").alias("component_id")), "joined")
    out = sets.select("doc_id", "set_id", "n_shingles").join(joined, "set_id", "left")
    own = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.withColumn("component_id", own).select("doc_id", "set_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """docs with one row of each group of near duplicates: its smallest id, and of several rows with that
    id the one with the smallest text hash (of rows equal in id and text, any one).

    Rows without words have no duplicates and stay; so do rows without an id, which nothing can name.
    All columns come back as they were.
    """
    found = near_duplicates(docs, scratch, **how)
    named = found.where("kept and doc_id is not null and set_id is not null")
    kept = scratch.save(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_near_rows")), "kept")
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.where(worded).join(kept.where("_near_rows = 1").select("doc_id"), "doc_id", "left_semi")
    out = docs.where(~worded).select(*columns).union(once.select(*columns))
    several = kept.where("_near_rows > 1").select("doc_id")
    if several.isEmpty():
        return out
    more = docs.where(worded).join(several, "doc_id", "left_semi").withColumn("_near_text", F.xxhash64("text"))
    first = more.groupBy("doc_id").agg(F.min("_near_text").alias("_near_text"))
    one = more.join(first, ["doc_id", "_near_text"], "left_semi").select(*columns).dropDuplicates(["doc_id"])
    return out.union(one)
