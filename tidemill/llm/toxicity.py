"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Text is folded first: lower case, homoglyphs and digit substitutions to the letters they stand for, all
that is no letter to a space. Lexicon terms are words and word beginnings with weights; exception
phrases (a term with its neighbour, or a longer word) take a term's weight back. The weights found are
summed, set against the length of the text, and put on the scale of a probability.

``fit`` learns terms, weights, exceptions and the scale from labelled rows, on a sample of at most
``max_rows`` rows of each label (a documented bound); ``score`` scores any text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that look like a Latin letter, and digits and signs that stand for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ο": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l",
}
FULL_WIDTH = {0xFF41 + k: chr(97 + k) for k in range(26)}
FOLD = str.maketrans(HOMOGLYPHS) | FULL_WIDTH
#: A sign between letters stands for a letter; at a word's end it is punctuation.
EDGE_SIGNS = re.compile(r"[!|$@]+(?=[\s.,;:]|$)|(?<!\S)[!|$@]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
PREFIXES = range(3, 10)


def fold(text: str | None) -> str:
    """' word word ' of a text; ' ' of one without letters."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii() or not text.isalpha():
        if "!" in text or "|" in text or "$" in text or "@" in text:
            text = EDGE_SIGNS.sub(" ", text)
        text = text.translate(FOLD)
    inner = " ".join(NOT_LETTERS.sub(" ", text).split())
    return f" {inner} " if inner else " "


@dataclass
class Lexicon:
    """Terms start with a space (a word's beginning) and may end with one (a whole word)."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    intercept: float = -4.0
    slopes: tuple[float, float] = (1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in [*self.terms.items(), *((t, -w) for t, w in self.exceptions.items())]:
            found.add_word(term, found.get(term, 0.0) + weight)
        if len(found):
            found.make_automaton()
        return found


def _features(folded: str, automaton) -> tuple[float, float]:
    """The summed weights and their share by length, both damped."""
    total = max(0.0, sum(w for _, w in automaton.iter(folded))) if len(automaton) else 0.0
    n = folded.count(" ") - 1
    return math.log1p(total), math.log1p(100.0 * total / (n + 20.0))


def scored(texts: pd.Series, lexicon: Lexicon, automaton) -> pd.DataFrame:
    x = np.array([_features(fold(t), automaton) for t in texts]).reshape(-1, 2)
    z = lexicon.intercept + x @ np.array(lexicon.slopes)
    return pd.DataFrame({"score": 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))), "f0": x[:, 0], "f1": x[:, 1]})


def score_column(lexicon: Lexicon, text="text"):
    """struct(score, f0, f1) of a text column. A null or empty text gets the score of no match."""

    @F.pandas_udf("score double, f0 double, f1 double")
    def run(batches: pd.Series) -> pd.DataFrame:
        return scored(batches, lexicon, _automaton(lexicon))

    return run(F.col(text) if isinstance(text, str) else text)


_built: dict = {}


def _automaton(lexicon: Lexicon):
    key = hash((tuple(lexicon.terms.items()), tuple(lexicon.exceptions.items())))
    if key not in _built:
        _built.clear()
        _built[key] = lexicon.automaton()
    return _built[key]


def _terms(text: str) -> list[str]:
    """The distinct words and word beginnings of a text."""
    found = set()
    for w in set(fold(text).split()):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
    return list(found)


def _candidates(text: str):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_terms)

    return run(text)


def _phrases(lexicon: Lexicon):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        automaton = _automaton(lexicon)

        def of(text):
            folded, found = fold(text), set()
            for end, _ in automaton.iter(folded) if len(automaton) else ():
                stop = folded.find(" ", end) if folded[end] != " " else end
                start = folded.rfind(" ", 0, stop)
                after = folded.find(" ", stop + 1)
                found.add(folded[start : stop + 1])
                if after > 0:
                    found.add(folded[start : after + 1])
            return list(found)

        return texts.map(of)

    return run


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    a, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * b)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, scratch, *, max_rows: int = 5000, max_terms: int = 2000, z: float = 1.64, least: float = 0.5, seed: int = 7) -> Lexicon:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic).

    At most about max_rows rows of each label are drawn by a hash of doc_id, half for terms, half for the
    scale. Labels without an id or a value are left out; of several labels of one id the highest counts.
    Without rows of both labels the lexicon is empty and every score is that of no match.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    n_all = sum(counts.values())
    if not counts.get(1) or not counts.get(0):
        return Lexicon(intercept=8.0 if counts.get(1) else -8.0)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_rows / counts[1]))).otherwise(F.lit(min(1.0, max_rows / counts[0])))
    wanted = scratch.save(known.where(drawn < share).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2))), "drawn")
    sample = scratch.save(docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "toxic", "half"), "sample")
    n = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}  # four rows
    n_toxic, n_clean = n.get((0, 1), 0), n.get((0, 0), 0)

    counted = (
        sample.where("half = 0")
        .select("toxic", F.explode(_candidates("text")).alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where("t >= 3")
    )
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    sure = odds - z * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counted.withColumn("w", odds).withColumn("sure", sure).where(F.col("sure") > least)
    rows = best.orderBy(F.desc(F.col("sure") * F.sqrt("t")), "term").limit(max_terms).collect()  # max_terms rows
    lexicon = Lexicon()
    for r in sorted(rows, key=lambda r: (len(r.term), r.term)):
        shorter = [r.term[:k] for k in range(4, len(r.term)) if r.term[:k] in lexicon.terms]
        if not any(lexicon.terms[s] >= r.w - 0.7 for s in shorter):
            lexicon.terms[r.term] = float(r.w)

    phrases = (
        sample.where("half = 0")
        .select("toxic", F.explode(_phrases(lexicon)("text")).alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where("c >= 5")
        .withColumn("w", odds)
        .where(F.col("w") + z * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)) < 0)
    )
    for r in phrases.orderBy("w", "term").limit(max_terms).collect():  # max_terms rows
        held = sum(w for term, w in lexicon.terms.items() if term in r.term and term != r.term)
        if held > 0:
            lexicon.exceptions[r.term] = float(held)

    seen = sample.select("toxic", "half", score_column(lexicon).alias("s")).select("toxic", "half", "s.f0", "s.f1").toPandas()  # 2 * max_rows rows
    fitted = seen[seen.half == 1] if seen[seen.half == 1].toxic.nunique() == 2 else seen
    y = fitted.toxic.to_numpy(float)
    rate = counts[1] / n_all
    w = np.where(y == 1, rate / max(1, y.sum()), (1 - rate) / max(1, (1 - y).sum())) * len(y)
    b = _logistic(fitted[["f0", "f1"]].to_numpy(), y, w)
    if b[1] < 0 or b[2] < 0:  # more hits never make a text less toxic: keep the better of the two alone
        best_f = max((0, 1), key=lambda k: abs(np.corrcoef(fitted[f"f{k}"], y)[0, 1]) if fitted[f"f{k}"].std() > 0 else 0)
        one = _logistic(fitted[[f"f{best_f}"]].to_numpy(), y, w)
        b = np.array([one[0], *(max(0.0, one[1]) if k == best_f else 0.0 for k in (0, 1))])
    lexicon.intercept, lexicon.slopes = float(b[0]), (float(b[1]), float(b[2]))
    return lexicon


def held_out():
    """True on the rows whose labels nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def reject_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; every other row and column as it was."""
    return docs.where(score_column(lexicon)["score"] < threshold)
