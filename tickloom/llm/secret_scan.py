"""Secret scan with a random forest that removes false positives.

Candidates are runs of 16 or more key-like characters. Each has numeric features: its length and letter
classes, the mean logarithm of its letter transitions under the transitions of the whole corpus, the share of
it covered by the corpus's dictionary of short words, the neighbouring words and marks, and the path it was
found in. A forest learns from labelled findings to tell secrets from the rest, and findings that it calls
false are dropped.

Labels may be given as (doc_id, start, is_secret). Without them, findings are labelled by rule where a rule is
sure: an issuer's fixed format or a key name with a hexadecimal value is a secret, a run of letters without
digits after no key name is none; all others are unlabelled. The rules' own evidence (prefixes and formats)
is no feature.

Transitions and the dictionary come from all documents: counts per task, summed by key. The dictionary holds
the words of 3 to 6 letters in at least one document in 1,000, so it has at most 1,000 times as many words as
a mean document. The forest is fitted on at most ``TRAIN_ROWS`` labelled findings, the first by a seeded hash,
and applied to all.

Defined cases: a null or empty text has no findings; without findings of both labels nothing is dropped and
the probability is null; every repeated row is scanned; an empty table gives an empty result; other columns
are not read, but for ``path_column`` (null: empty).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
SHORT_WORD = re.compile(r"\b[a-z]{3,6}\b")
#: Key names and formats of issued credentials.
KEY_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "key", "auth", "credential")
ISSUED = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[0-9A-Za-z-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_\-]{35}")
CONFIG_PATH = re.compile(r"\.(env|cfg|conf|ini|ya?ml|json|properties|pem|key)\b|config|secret|credential", re.I)
FEATURES = ["length", "digits", "uppers", "lowers", "marks", "distinct", "entropy", "transition", "worst_transition", "dictionary", "named", "assigned", "quoted", "before_words", "after_words", "path_config", "path_depth"]
SCHEMA = "doc_id long, start int, stop int, value string, path string, label int, " + ", ".join(f"{f} double" for f in FEATURES)


def _kind(c: str) -> int:
    """Class of a character for transitions: its letter without case, digit, mark or other."""
    o = ord(c)
    if 97 <= o <= 122:
        return o - 97
    if 65 <= o <= 90:
        return 26 + o - 65
    if 48 <= o <= 57:
        return 52
    return 53 if o < 128 else 54


_KINDS = np.array([_kind(chr(b)) for b in range(128)] + [54] * 128)
N_KINDS = 55


def corpus_tables(docs: DataFrame) -> tuple[np.ndarray, set[str]]:
    """(log probabilities of transitions between character classes, dictionary of short words) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words, total = np.zeros(N_KINDS * N_KINDS, np.int64), Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                total += 1
                text = text.as_py()
                if not text:
                    continue
                kinds = _KINDS[np.frombuffer(text.encode(), np.uint8)]
                if len(kinds) > 1:
                    pairs += np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS)
                words.update(set(SHORT_WORD.findall(text)))
        used = np.flatnonzero(pairs)
        keys = ["", *(f"\t{i}" for i in used.tolist()), *words]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total, *pairs[used].tolist(), *words.values()], pa.int64())], ["k", "n"])

    summed = docs.select(F.col("text").cast("string")).mapInArrow(count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("k") == "", F.col("n"))).alias("t")
    least = (summed.agg(total).first()["t"] or 0) / 1000
    kept = summed.where((F.col("n") >= max(2, least)) & (F.col("k") != "") | F.col("k").startswith("\t")).collect()
    pairs = np.ones(N_KINDS * N_KINDS)
    dictionary = set()
    for row in kept:
        if row["k"].startswith("\t"):
            pairs[int(row["k"][1:])] += row["n"]
        else:
            dictionary.add(row["k"])
    table = pairs.reshape(N_KINDS, N_KINDS)
    return np.log(table / table.sum(axis=1, keepdims=True)), dictionary


def _covered(value: str, dictionary: set[str]) -> float:
    """Share of the characters that dictionary words can tile, at best."""
    text, n = value.lower(), len(value)
    best = [0] * (n + 1)
    for end in range(1, n + 1):
        top = best[end - 1]
        for size in range(3, min(6, end) + 1):
            if best[end - size] + size > top and text[end - size : end] in dictionary:
                top = best[end - size] + size
        best[end] = top
    return best[n] / n


def features(value: str, before: str, after: str, path: str, transitions: np.ndarray, dictionary: set[str]) -> list[float]:
    n, counts = len(value), Counter(value)
    kinds = _KINDS[np.frombuffer(value.encode(), np.uint8)]
    steps = transitions[kinds[:-1], kinds[1:]]
    near = before.lower()
    words = re.findall(r"[a-z_]+", near)
    return [
        float(n), sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, sum(c.islower() for c in value) / n, sum(not c.isalnum() for c in value) / n,
        len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), float(steps.mean()), float(steps.min()), _covered(value, dictionary),
        float(any(w in KEY_NAMES for w in words[-3:])), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        sum(w in dictionary for w in words[-3:]) / 3, sum(w in dictionary for w in re.findall(r"[a-z_]+", after.lower())[:3]) / 3,
        float(bool(CONFIG_PATH.search(path))), float(path.count("/")),
    ]


def rule_label(value: str, before: str) -> int | None:
    """1 for a sure secret, 0 for surely none, None for neither."""
    named = re.search(r"(?i)(password|passwd|pwd|secret|token|api_?key|access_?key)\s*[=:]\s*[\"']?$", before)
    if ISSUED.fullmatch(value) or named and re.fullmatch(r"[0-9a-f]{16,}", value):
        return 1
    if not named and not any(c.isdigit() for c in value):
        return 0
    return None


def candidates(docs: DataFrame, path_column: str, transitions: np.ndarray, dictionary: set[str]) -> DataFrame:
    """Every candidate with its features and rule label."""
    shared = docs.sparkSession.sparkContext.broadcast((transitions, dictionary))  # bounded: 55 x 55 and the dictionary

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = shared.value
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * len(FEATURES)]
        for batch in batches:
            rows = []
            for doc_id, text, path in zip(batch["doc_id"].to_pylist(), batch["text"], batch["path"].to_pylist()):
                text = text.as_py() or ""
                for m in CANDIDATE.finditer(text):
                    a, b = m.span()
                    before, after = text[max(0, a - 40) : a], text[b : b + 40]
                    rows.append((doc_id, a, b, m.group(), path, rule_label(m.group(), before), *features(m.group(), before, after, path, table, words)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col(path_column).cast("string"), F.lit("")).alias("path"))
    return slim.mapInArrow(scan, SCHEMA)


def _training(found: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled findings, half of each label where there are enough, first by a hash of the value."""
    order = F.xxhash64("value", "doc_id", "start")
    halves = [found.where(F.col("label") == k).orderBy(order).limit(rows // 2) for k in (0, 1)]
    return halves[0].unionByName(halves[1])


def scan_secrets(docs: DataFrame, path_column: str = "source", labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, start, stop, value, path and probability of the findings that stay."""
    found = candidates(docs, path_column, *corpus_tables(docs))
    if labels is not None:
        given = labels.select(F.col("doc_id").cast("long"), F.col("start").cast("int"), F.col("is_secret").cast("int").alias("label")).distinct()
        found = found.drop("label").join(given, ["doc_id", "start"], "left")
    vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    sample = vector.transform(_training(found, train_rows)).select("vector", F.col("label").cast("double").alias("label"))
    sample = sample.sparkSession.createDataFrame(sample.collect(), sample.schema)  # at most ``train_rows`` rows
    if sample.select("label").distinct().count() < 2:
        return found.select("doc_id", "start", "stop", "value", "path", F.lit(None).cast("double").alias("probability"))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=30, maxDepth=6, subsamplingRate=0.7, seed=11).fit(sample)
    judged = forest.transform(vector.transform(found.drop("label"))).withColumn("secret", vector_to_array("probability")[1])
    return judged.where("secret >= 0.5").select("doc_id", "start", "stop", "value", "path", F.col("secret").alias("probability"))
