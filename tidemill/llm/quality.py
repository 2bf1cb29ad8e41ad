"""Host-level quality rules.

Rules fail documents one by one; failures are counted by host, each host's rate is shrunk toward the
corpus by a beta prior fitted to the hosts' own rates, and the host's verdict is joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, without, words

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
GRAM = 3


def _repeats(starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each text, the words inside a run of three words that the text holds twice or more."""
    n = len(ids)
    covered = np.zeros(n, bool)
    if n >= GRAM:
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        whole = text[: n - 2] == text[2:]
        at = np.flatnonzero(whole)
        # Pairs are numbered first, so that the key of a run of three stays exact.
        _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
        _, run = np.unique(pair[at] * (ids.max() + 1) + ids[at + 2], return_inverse=True)
        _, back, count = np.unique(text[at] * (int(run.max()) + 1 if len(run) else 1) + run, return_inverse=True, return_counts=True)
        hit = at[count[back] > 1]
        for k in range(GRAM):
            covered[hit + k] = True
    return np.add.reduceat(np.concatenate([covered, [False]]).astype(np.int64), starts[:-1]) * (np.diff(starts) > 0) if len(starts) > 1 else np.zeros(0, np.int64)


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def _measure(batches):
    for part in slices(batches, "_text"):
        texts = pc.fill_null(part.column("_text"), "")
        starts, ids, _ = words(texts)
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        count = lambda c: pc.count_substring(texts, c).to_numpy(zero_copy_only=False).astype(np.int64)
        found = {
            "n_words": np.diff(starts),
            "word_chars": chars - sum(count(c) for c in SPACE),
            "n_symbols": sum(count(c) for c in SYMBOLS),
            "n_dup_lines": np.fromiter((_dup_lines(t) for t in texts.to_pylist()), np.int64, len(texts)),
            "n_repeat_words": _repeats(starts, ids),
        }
        kept = [part.column(c) for c in part.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(found[m], pa.int64()) for m in METRICS]], [*[c for c in part.schema.names if c != "_text"], *METRICS])


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and the five counts of every row's whole text (null: no words)."""
    given = docs.select(*keys, F.col("text").alias("_text"))
    schema = given.drop("_text").schema
    for m in METRICS:
        schema = schema.add(m, "long")
    return given.mapInArrow(_measure, schema)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, and whether the host is kept.

    The prior is Beta(m*k, (1-m)*k) with the mean m and the variance v of the hosts' rates and
    k = m(1-m)/v - 1, between 1 and 1000 (1000 if the rates don't vary). A null host is a host.
    """
    hosts = measured.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    prior = hosts.agg(F.avg(F.col("host_failed") / F.col("host_docs")).alias("_m"), F.var_pop(F.col("host_failed") / F.col("host_docs")).alias("_v"))
    strength = F.when(F.col("_v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1))).otherwise(F.lit(1000.0))
    shrunk = (F.col("host_failed") + F.col("_m") * F.col("_k")) / (F.col("host_docs") + F.col("_k"))
    return (
        hosts.join(F.broadcast(prior.withColumn("_k", strength)), F.lit(True))  # one row
        .withColumn("host_rate", shrunk)
        .withColumn("host_kept", F.col("host_rate") <= max_rate)
        .select("_host", "host_docs", "host_failed", "host_rate", "host_kept")
    )


def filter_hosts(measured: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Every measured row with its host's columns and ``kept``: it passed, and so did its host."""
    return measured.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host").withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))


def quality(docs: DataFrame, scratch, host: str = "source", **limits) -> DataFrame:
    """doc_id, host, the five counts, base_failed, the host's columns and kept, for every row of docs.

    A null or empty text has no words and fails; rows of one doc_id are judged one by one; a null host
    is a host of its own; extra columns are not read; an empty table gives an empty table.
    The counts are written once, since hosts and verdicts both read them.
    """
    counted = scratch.save(measure(docs, ["doc_id", host]).withColumn("base_failed", base_failed(**limits)), "measured")
    return filter_hosts(counted, scratch.save(host_verdicts(counted, host), "hosts"), host)
