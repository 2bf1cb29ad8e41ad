"""Secret scans with a random forest against false positives (DataFrame functions only).

Candidates are runs of 16 or more key characters, and shorter values (of six characters at least) assigned
to a name that speaks for a secret. Every place of a candidate is scored by itself. Each gets features: its length and kinds of
characters, transitions between kinds, the part of its letters that a dictionary of the corpus covers,
whether it stands in a path, and the words beside it. A random forest trained from labelled findings
tells secrets from long words, numbers and hashes.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LONG = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])"
BESIDE = 40  # characters of text kept on each side

# Words beside a candidate that speak for a secret, and for something else.
SECRET_WORDS = r"(?i)(passw(or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
OTHER_WORDS = r"(?i)(sha1|sha256|md5|checksum|commit|digest|uuid|guid|isbn|example|placeholder|dummy|version|integrity)"
# A value of at least six characters assigned to such a name; the first looks back are the cheap ones.
ASSIGNED = r"(?<=[=:\s\"'])(?<=[=:]\s{0,3}[\"']?)(?<=(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"'`<>,;(){}\[\]]{6,}"
CANDIDATE = f"{LONG}|{ASSIGNED}"
# Prefixes that issuers give their keys.
KNOWN_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|sk_test_|xox[abprs]-|AIza|eyJ)"

FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_marks", "f_transitions", "f_distinct", "f_hex", "f_dictionary",
    "f_in_path", "f_secret_word", "f_other_word", "f_assigned", "f_quoted",
]


def dictionary(docs: DataFrame, most: int = 5000, least_docs: int = 5) -> list[str]:
    """Up to ``most`` of the words (three letters or more) that most documents have. A bounded list."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w"))
    counted = words.groupBy("w").count().where(F.col("count") >= least_docs)
    return sorted(r.w for r in counted.orderBy(F.desc("count"), "w").limit(most).collect())


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, value, before, after, start) of every place of a candidate, each with its own context.

    The texts between the candidates and the candidates take turns in one array; a place is the sum of the
    lengths before it.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_values")).where("size(_values) > 0")
    found = found.select("doc_id", "_values", F.split("text", CANDIDATE, -1).alias("_gaps"))
    turns = found.select("doc_id", F.expr("flatten(transform(_gaps, (g, i) -> if(i < size(_values), array(g, _values[i]), array(g))))").alias("_turns"))
    lengths = F.expr("transform(_turns, t -> cast(length(t) as bigint))")
    starts = F.expr("aggregate(_lengths, struct(0L as at, array(0L) as ats), (a, n) -> struct(a.at + n as at, concat(a.ats, array(a.at + n)) as ats), a -> a.ats)")
    placed = turns.withColumn("_lengths", lengths).withColumn("_starts", starts)
    near = 2 * BESIDE // 6 + 1  # turns that BESIDE characters can reach over: a value has six and a gap one at least
    each = placed.select("doc_id", F.explode(F.expr(f"""transform(sequence(1, size(_turns) - 2, 2), i -> struct(
        _turns[i] as value,
        right(array_join(slice(_turns, greatest(1, i - {near} + 1), least(i, {near})), ''), {BESIDE}) as before,
        left(array_join(slice(_turns, i + 2, {near}), ''), {BESIDE}) as after,
        _starts[i] as start))""")).alias("c"))  # fmt: skip
    return each.select("doc_id", "c.*")


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """found with the feature columns; the dictionary goes along as one literal."""
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    runs = F.filter(F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.array_contains(F.col("_known"), w))
    kinds = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[_+/=-])(?=[^_+/=-])"
    return (
        found.withColumn("_known", known)
        .withColumn("f_length", n.cast("double"))
        .withColumn("f_digits", share("[0-9]"))
        .withColumn("f_upper", share("[A-Z]"))
        .withColumn("f_lower", share("[a-z]"))
        .withColumn("f_marks", share("[_+/=-]"))
        .withColumn("f_transitions", F.regexp_count(v, F.lit(kinds)) / n)
        .withColumn("f_distinct", F.size(F.array_distinct(F.split(v, ""))) / n)
        .withColumn("f_hex", v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"))
        .withColumn("f_dictionary", F.aggregate(runs, F.lit(0.0), lambda a, w: a + F.length(w)) / n)
        .withColumn("f_in_path", (F.col("before").rlike(r"[/\\.]$") | F.col("after").rlike(r"^[/\\]|^\.[a-z]{1,5}\b")).cast("double"))
        .withColumn("f_secret_word", F.regexp_extract("before", r"(\S+\s*)$|(\S+\s+\S+\s*)$", 0).rlike(SECRET_WORDS).cast("double"))
        .withColumn("f_other_word", F.concat("before", F.lit(" "), "after").rlike(OTHER_WORDS).cast("double"))
        .withColumn("f_assigned", F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"))
        .withColumn("f_quoted", F.col("before").rlike("[\"'`]$").cast("double"))
        .drop("_known")
    )


def label_findings(found: DataFrame) -> DataFrame:
    """Findings labelled by rule, for a corpus without reviewed ones: a value with an issuer's prefix, or
    assigned to a name that speaks for a secret, is one; a value without digits, of digits only, or beside
    words for hashes and identifiers is none; the rest has no label."""
    named = F.col("before").rlike(SECRET_WORDS + r"\s*[=:]\s*[\"']?$")
    secret = F.col("value").rlike(KNOWN_PREFIX) & F.col("value").rlike("[0-9]") | named & F.col("value").rlike("[0-9]")
    other = ~F.col("value").rlike("[0-9]") | F.col("value").rlike("^[0-9]+$") | F.col("before").rlike(OTHER_WORDS)
    return found.withColumn("label", F.when(secret, 1.0).when(other, 0.0)).where("label is not null")


def train(labelled: DataFrame, words: list[str], *, max_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 5):
    """A forest from labelled findings (value, before, after, label), on at most about max_rows of each label,
    drawn by a hash (a documented bound). None without findings of both labels."""
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    if not counts.get(1.0) or not counts.get(0.0):
        return None
    drawn = F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("label") == 1, F.lit(min(1.0, max_rows / counts[1.0]))).otherwise(F.lit(min(1.0, max_rows / counts[0.0])))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(labelled.where(drawn < share), words))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(rows.select("features", "label"))


def scan(docs: DataFrame, scratch: Scratch, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, value, start, score, secret) of every place of a candidate; secret: score >= threshold.

    labelled: reviewed findings (value, before, after, label); by default findings labelled by rule.
    docs needs doc_id and text; other columns are not read. Null and empty texts have no candidates; rows
    of one id are scanned one by one, with equal rows giving equal findings; without labels of both kinds
    no candidate is a secret and scores are 0; an empty table gives an empty table.
    """
    found = scratch.save(candidates(docs), "candidates")
    words = dictionary(docs)
    model = train(label_findings(found) if labelled is None else labelled, words)
    if model is None:
        return found.select("doc_id", "value", "start", F.lit(0.0).alias("score"), F.lit(False).alias("secret"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(found, words))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "value", "start", "score", (F.col("score") >= threshold).alias("secret"))
