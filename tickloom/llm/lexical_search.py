"""The best documents for each item by summed term weights, in exact integers.

Documents are dealt into segments of about ``SEGMENT_BYTES`` of text. A segment is an inverted index of its own: its
documents with their lengths, and for each of the items' terms found there a list of (place, occurrences). Document
frequencies, N and L are sums over all segments. The segments are written once; every later pass reads them.

In a segment, an item's **short lists** (at most ``SHORT`` of the documents) are worked off term at a time: their scores
are summed into one list of accumulators, sorted by document. This list then takes part like any other in a
**document-at-a-time** pass over the long lists: all lists stand in the order of their largest scores, and documents
come only from the first few, as the largest scores of the rest together stay below the item's tenth best score so
far; in the others a document is looked up (by bisection, which skips what lies between) only while its sum and the
largest scores still to come reach that score. The best scores go with the task from segment to segment, so that later
segments skip more. A list of which no document can enter is never read.

A task returns at most k rows an item; these are ranked at last. Items are worked off in blocks of about
``ITEM_BLOCK_BYTES`` of text (by a hash of item_id, broadcast with their term numbers), each in a pass of its own.
Terms are compared by 64-bit hashes of their bytes together with their lengths.

Defined cases: a null or empty text has no terms; a document without terms is not counted and never found; rows that
repeat an item_id are one item with the terms of all its rows, and a null item_id is one item too; documents with
equal ids are ranked each; at equal scores a null doc_id comes last; an item without terms, or whose terms no document
has, gives no rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import repeats as R
from tickloom.llm.common import _cut, stored

K = 10
SEGMENT_BYTES = 4 << 20
ITEM_BLOCK_BYTES = 8 << 20
SHORT = 1 / 16
#: ASCII bytes that are neither letters nor digits end a term; A-Z count as a-z.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = R.SYMBOLS.copy()
LOWER[65:91] = LOWER[97:123]
_DOWN = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEGMENT_SCHEMA = "n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms binary, sizes binary, places binary, counts binary"


def term_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each term of the bytes starts, and its key."""
    inside = ~SEPARATORS[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    return starts, R.word_ids(data, SEPARATORS, LOWER) ^ R.mix((stops - starts).astype(np.uint64), 0x1B873593)


def terms_of(text: str | None) -> list[bytes]:
    data = (text or "").encode().translate(_DOWN)
    return data.translate(bytes(32 if SEPARATORS[b] else b for b in range(256))).split(b" ") if data else []


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms, and the block the item is in."""
    slim = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t for t in terms_of(text.as_py()) if t}) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BLOCK_BYTES) or 1
    rows = slim.mapInArrow(split, "item_id long, terms array<binary>").select("item_id", F.explode("terms").alias("term")).distinct()
    one = rows.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    return one.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))


def _segment(piece: pa.Table, keys: np.ndarray) -> dict:
    """The index of one segment; ``keys`` are the sorted keys of the terms that are asked for."""
    texts = [(t or "").encode() for t in piece["text"].to_pylist()]
    starts, found = term_keys(b"\n".join(texts))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    lengths = np.bincount(owner, minlength=len(texts))
    at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
    hit = keys[at] == found if len(keys) else np.zeros(len(found), bool)
    postings, counts = np.unique(at[hit] * len(texts) + owner[hit], return_counts=True)
    terms, sizes = np.unique(postings // len(texts), return_counts=True)
    as_bytes = lambda a, kind: [np.ascontiguousarray(a.astype(kind)).tobytes()]
    return {
        "n_docs": [int((lengths > 0).sum())], "n_terms": [int(lengths.sum())], "doc_ids": pa.array([piece["doc_id"].to_pylist()], pa.list_(pa.int64())),
        "lengths": as_bytes(lengths, "<i8"), "terms": as_bytes(terms, "<i4"), "sizes": as_bytes(sizes, "<i4"),
        "places": as_bytes(postings % len(texts), "<i4"), "counts": as_bytes(counts, "<i4"),
    }


def build_index(docs: DataFrame, keys: np.ndarray, segment_bytes: int | None = None) -> DataFrame:
    """One row for each segment of ``docs``, for the terms with these keys (sorted)."""
    limit = segment_bytes or SEGMENT_BYTES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for piece in _cut(pa.Table.from_batches([batch]), limit):
                    yield pa.RecordBatch.from_pydict(_segment(piece, keys))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, SEGMENT_SCHEMA)


def _frequencies(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, sizes in zip(batch["terms"], batch["sizes"]):
                yield pa.RecordBatch.from_pydict({"term": np.frombuffer(terms.as_py(), "<i4"), "df": np.frombuffer(sizes.as_py(), "<i4").astype(np.int64)})

    return index.select("terms", "sizes").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def hybrid(lists: list[tuple[np.ndarray, np.ndarray, int]], short: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and whole scores of the documents that score at least ``least``, from (places, scores, largest score) lists.

    Lists of at most ``short`` places become one list of accumulators; the rest is done document at a time.
    """
    small = [x for x in lists if len(x[0]) <= short]
    if len(small) > 1:
        places, back = np.unique(np.concatenate([p for p, _, _ in small]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, back, np.concatenate([s for _, s, _ in small]))
        lists = [(places, sums, int(sums.max())), *[x for x in lists if len(x[0]) > short]]
    lists = sorted(lists, key=lambda x: -x[2])
    bounds = np.cumsum([0, *[b for _, _, b in reversed(lists)]])[::-1].tolist()  # of a list and all after it
    first = next((i for i, bound in enumerate(bounds) if bound < least), len(lists))
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.unique(np.concatenate([p for p, _, _ in lists[:first]])) if first > 1 else lists[0][0]
    sums = np.zeros(len(places), np.int64)
    for p, s, _ in lists[:first]:
        sums[np.searchsorted(places, p)] += s
    for (p, s, _), bound in zip(lists[first:], bounds[first:]):
        open_ = sums + bound >= least
        places, sums = places[open_], sums[open_]
        at = np.searchsorted(p, places)
        at[at == len(p)] = 0
        sums += np.where(p[at] == places, s[at], 0)
    good = sums >= least
    return places[good], sums[good]


def _best(scores: np.ndarray, ids: list[int | None], k: int) -> list[tuple[int, int | None]]:
    return sorted(zip(scores.tolist(), ids), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def _score(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k documents of its segments; ``items`` holds term numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int | None]]] = [[] for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch["doc_ids"][row].as_py()
                column = lambda name, kind="<i4": np.frombuffer(batch[name][row].as_py(), kind).astype(np.int64)
                terms, sizes, places, counts = (column(c) for c in ("terms", "sizes", "places", "counts"))
                if not len(terms):
                    continue
                m = 100 - 90 + (90 * column("lengths", "<i8") * n_docs) // n_terms
                scores = np.repeat(weights[terms], sizes) * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[places]))
                begins = np.r_[0, np.cumsum(sizes)]
                largest = np.maximum.reduceat(scores, begins[:-1]).tolist()
                slot = np.full(len(weights), -1, np.int64)
                slot[terms] = np.arange(len(terms))
                begins, short = begins.tolist(), max(1, int(len(ids) * SHORT))
                for item, wanted in enumerate(items):
                    here = [s for s in slot[wanted].tolist() if s >= 0 and largest[s] > 0]
                    least = best[item][-1][0] if len(best[item]) == k else 1
                    if sum(largest[s] for s in here) < least:
                        continue
                    lists = [(places[begins[s] : begins[s + 1]], scores[begins[s] : begins[s + 1]], largest[s]) for s in here]
                    found, sums = hybrid(lists, short, least)
                    if len(found) > k:  # a few more than k only where scores are equal
                        top = sums >= np.partition(sums, -k)[-k]
                        found, sums = found[top], sums[top]
                    if len(found):
                        old = best[item]
                        best[item] = _best(np.r_[np.array([s for s, _ in old], np.int64), sums], [*(d for _, d in old), *(ids[p] for p in found.tolist())], k)
        rows = [(item, doc_id, score) for item, found in enumerate(best) for score, doc_id in found]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate((("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())))})

    return index.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, segment_bytes: int | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    wanted = stored(_item_terms(items), "item-terms")
    parts: list[DataFrame] = []
    for block in [r["block"] for r in wanted.select("block").distinct().orderBy("block").collect()]:
        rows = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in wanted.where(F.col("block") == block).collect()]  # about ITEM_BLOCK_BYTES
        vocabulary = sorted({t for _, terms in rows for t in terms})
        keys = term_keys(b"\n".join(vocabulary))[1]
        order = np.argsort(keys)
        number = dict(zip((vocabulary[i] for i in order.tolist()), range(len(order))))
        index = stored(build_index(docs, keys[order], segment_bytes), "segments")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        weights = np.zeros(len(order), np.int64)
        for r in _frequencies(index).collect():  # a row for each term of the block
            weights[r["term"]] = weight(n_docs, r["df"])
        lists = [np.array(sorted(number[t] for t in terms), np.int64) for _, terms in rows]
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(rows)], "item int, item_id long")
        found = _score(index, lists, weights, n_docs, n_terms, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        top = found.withColumn("rank", rank).where(F.col("rank") <= k)
        parts.append(top.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts) if parts else empty
