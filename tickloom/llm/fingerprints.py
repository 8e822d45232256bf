"""Homomorphic multiset hashes of documents.

A document is the multiset of its paragraphs (lines that aren't blank). A paragraph hashes to a wide sparse
vector: 4 of 128 lanes with 32-bit values. A document's fingerprint is the sum of the vectors, lane by lane
modulo 2^32: the order of paragraphs doesn't matter, and inserting or deleting a paragraph adds or subtracts
its vector without the rest of the text. One paragraph carries 156 hashed bits. As a paragraph touches few
lanes, fingerprints of documents that share paragraphs agree in lanes: the likeness is the share of equal
lanes among those that are not zero in both.

``edit_report`` deals documents by ranges of doc_id, so that a document and the next lie together; only the
first document of each range goes to the range before. The ranges come from quantiles of the ids and hold
about ``RANGE_BYTES`` of text each.

Defined cases: a null text is empty; an empty text has the fingerprint zero; two zero fingerprints are alike
(1.0); null ids come before all others; rows with equal ids are ordered by text; the document after the last
is the first, so one lone document follows itself; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANES = 128
HITS = 4
RANGE_BYTES = 8 << 20
_MASK = (1 << 32) - 1
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraphs(text: str | None) -> list[str]:
    return [p for p in (text or "").split("\n") if p.strip()]


def _add(lanes: list[int], parts: Iterable[str], sign: int) -> None:
    for part in parts:
        digest = hashlib.blake2b(part.encode(), digest_size=8 * HITS).digest()
        for lane, value in struct.iter_unpack("<II", digest):
            lane %= LANES
            lanes[lane] = (lanes[lane] + sign * value) & _MASK


def fingerprint(text: str | None) -> list[int]:
    """The lanes of a text."""
    lanes = [0] * LANES
    _add(lanes, paragraphs(text), 1)
    return lanes


def insert(lanes: list[int], parts: Iterable[str]) -> list[int]:
    """The fingerprint after paragraphs were added."""
    out = list(lanes)
    _add(out, parts, 1)
    return out


def delete(lanes: list[int], parts: Iterable[str]) -> list[int]:
    """The fingerprint after paragraphs were taken out."""
    out = list(lanes)
    _add(out, parts, -1)
    return out


def likeness(a: list[int], b: list[int]) -> float:
    """Share of equal lanes among those that are not zero in both."""
    if a == b:
        return 1.0
    used = [x == y for x, y in zip(a, b) if x or y]
    return sum(used) / len(used)


def to_hex(lanes: list[int]) -> str:
    return struct.pack(f">{LANES}I", *lanes).hex()


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([to_hex(fingerprint(t.as_py())) for t in batch["text"]], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ordered(table: pa.Table) -> list[tuple[int | None, str]]:
    rows = zip(table["doc_id"].to_pylist(), table["text"].to_pylist())
    return sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _ranged(docs: DataFrame) -> DataFrame:
    """docs with a range number that rises with doc_id."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    count = max(1, int(size // RANGE_BYTES))
    cuts: list[float] = []
    if count > 1:
        shares = [i / count for i in range(1, count)]
        found = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), shares, max(10_000, 20 * count)).alias("q")).first()["q"]
        cuts = sorted(set(found or []))
    if not cuts:
        return docs.withColumn("part", F.lit(0.0))
    at = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="part", handleInvalid="keep")
    ranged = at.transform(docs.withColumn("at", F.col("doc_id").cast("double")))
    return ranged.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1.0)).otherwise(F.col("part"))).drop("at")


def edit_report(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, that of the edited text, and the likeness to it and to the next document."""
    ranged = _ranged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))

    def head(table: pa.Table) -> pa.Table:
        text = _ordered(table)[0][1]
        return pa.table({"part": table["part"][:1], "head": pa.array([text], pa.string())})

    def report(table: pa.Table, heads: pa.Table) -> pa.Table:
        rows = _ordered(table)
        texts = [t for _, t in rows] + [heads["head"][0].as_py()]
        prints = [fingerprint(t) for t in texts]
        out: list[tuple] = []
        for i, (doc_id, text) in enumerate(rows):
            new = edited(text, texts[i + 1])
            before, after = paragraphs(text), paragraphs(new)
            same = 0
            while same < min(len(before), len(after)) and before[same] == after[same]:
                same += 1
            lanes = insert(delete(prints[i], before[same:]), after[same:])
            digest = hashlib.sha256(new.encode()).hexdigest()
            out.append((doc_id, len(text), digest, to_hex(prints[i]), to_hex(lanes), likeness(prints[i], lanes), likeness(prints[i], prints[i + 1])))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    heads = ranged.groupBy("part").applyInArrow(head, "part double, head string")
    order = Window.orderBy("part")  # one number per range, not documents
    parts = heads.select("part").withColumn("after", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    following = parts.join(heads.withColumnRenamed("part", "after"), "after").select("part", "head")
    return ranged.groupBy("part").cogroup(following.groupBy("part")).applyInArrow(report, SCHEMA)
