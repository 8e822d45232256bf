"""Hard negatives of embedding anchors by an inverted multi-index, exact.

Components are floored to whole numbers at 256 to one; a score is the inner product of two rows. The dimensions are cut
into two halves, each with a codebook of ``CODES`` centres (k-means over ``SAMPLE_ROWS`` rows with the smallest hashes
of their ids, a bounded sample; every row is indexed). Rows are dealt into shards of about ``SHARD_ROWS`` by a hash. In
a shard the rows lie by cell, a pair of codes, and each code knows its radius: how far its farthest row is.

A half of an anchor scores at most ``anchor . centre + |anchor| radius`` with a row of a code, so a cell is bounded by
the sum of two such bounds. The multi-sequence heap visits cells by falling sums, in rounds of twice as many cells, and
stops when what is still wanted is certified: nothing unvisited reaches it.

Two passes hold blocks of anchors against all shards, one task for each (shard, block):

1. an anchor's best five rows of its label; the best five of all shards are its positives;
2. for each score p of a positive the best three rows of other labels with 50 p <= 100 s <= 95 p. A window is certified
   when its third score lies above all unvisited bounds, or its lower edge does.

A task holds one shard and one block (about ``ANCHOR_BLOCK`` anchors, by a hash). The shards travel once for each block;
with more memory raise both sizes (a million rows and 64 thousand anchors), which lowers what travels.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; rows with equal ids
are rows of their own, none of them is its own positive; shorter vectors count zeros for what they lack; a label
alone has no positive; windows below score zero are empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stored

CODES = 16
SAMPLE_ROWS = 16_384
SHARD_ROWS = 8_192
ANCHOR_BLOCK = 512
ROUNDS = 8  # of k-means
FIRST_CELLS = 8
EXACT = 1 << 20  # sums of products of whole numbers up to this size are exact in doubles
INDEX_SCHEMA = "shard int, ids binary, labels binary, vectors binary, starts binary, used binary, radii binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector (whole numbers) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    return rows.select(
        vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("vector"),
    )


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == dims for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), dims)
    return np.array([[*r, *[0] * (dims - len(r))] for r in rows], np.int64).reshape(len(rows), dims)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


def _centres(points: np.ndarray, codes: int) -> np.ndarray:
    centres = np.unique(points[: 64 * codes], axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(codes, len(centres))).astype(int)]
    for _ in range(ROUNDS):
        code = nearest(points, centres)
        for c in np.unique(code):
            centres[c] = points[code == c].mean(0)
    return centres


def train_codebooks(rows: DataFrame, dims: int, codes: int) -> list[np.ndarray]:
    """The centres of both halves, from the bounded sample in one task."""
    sample = rows.orderBy(F.xxhash64("vec_id", "vector"), "label").limit(SAMPLE_ROWS).select("vector").coalesce(1)
    half = (dims + 1) // 2

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.concatenate([_matrix(b["vector"], dims) for b in batches if b.num_rows]).astype(float)
        books = [_centres(np.ascontiguousarray(p), codes) for p in (points[:, :half], points[:, half:])]
        yield pa.RecordBatch.from_pydict({"half": [0, 1], "book": [b.tobytes() for b in books], "size": [len(b) for b in books]})

    found = sorted(sample.mapInArrow(train, "half long, book binary, size long").collect())
    return [np.frombuffer(r["book"]).reshape(r["size"], -1) for r in found]


def build_index(rows: DataFrame, books: list[np.ndarray], dims: int, shards: int) -> DataFrame:
    """One row for each shard, its rows by cell."""
    half = (dims + 1) // 2

    def build(table: pa.Table) -> pa.Table:
        ids, labels, values = table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(table["vector"], dims)
        halves = [values[:, :half].astype(float), values[:, half:].astype(float)]
        codes = [nearest(p, b) for p, b in zip(halves, books)]
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((labels, ids, cell))
        starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        used, radii = [], []
        for p, b, code in zip(halves, books, codes):
            far, seen = np.zeros(len(b)), np.zeros(len(b), bool)
            np.maximum.at(far, code, np.sqrt(((p - b[code]) ** 2).sum(1)))
            seen[code] = True
            used.append(seen)
            radii.append(far)
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({
            "shard": table["shard"][:1], "ids": blob(ids[order].astype("<i8")), "labels": blob(labels[order].astype("<i8")), "vectors": blob(values[order].astype("<i8")),
            "starts": blob(starts.astype("<i8")), "used": blob(np.concatenate(used)), "radii": blob(np.concatenate(radii)),
        })

    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")
    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(build, INDEX_SCHEMA)


class Shard:
    """One shard of the index in a task."""

    def __init__(self, row: dict, books: list[np.ndarray], dims: int):
        read = lambda name, kind="<i8": np.frombuffer(row[name], kind)
        self.ids, self.labels, self.starts = read("ids"), read("labels"), read("starts")
        self.uids = (np.int64(row["shard"]) << 32) + np.arange(len(self.ids))
        whole = read("vectors").reshape(-1, dims)
        self.exact = dims <= 4096 and (not whole.size or np.abs(whole).max() <= EXACT)
        self.vectors = whole.astype(float) if self.exact else whole
        self.half = (dims + 1) // 2
        used, radii = read("used", "?"), read("radii", "<f8")
        cut = len(books[0])
        self.codes = [np.flatnonzero(used[:cut]), np.flatnonzero(used[cut:])]
        self.books = [b[c] for b, c in zip(books, self.codes)]
        self.radii = [r[c] for r, c in zip((radii[:cut], radii[cut:]), self.codes)]
        self.width = len(books[1])

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        exact = self.exact and np.abs(anchor).max(initial=0) <= EXACT
        return (self.vectors[rows] @ anchor.astype(float)).astype(np.int64) if exact else self.vectors[rows].astype(np.int64) @ anchor

    def bounds(self, anchor: np.ndarray) -> list[np.ndarray]:
        """The most that a half of the anchor scores with a row of each code, with room for rounding."""
        out = []
        for part, book, radius in zip((anchor[: self.half].astype(float), anchor[self.half :].astype(float)), self.books, self.radii):
            length = np.sqrt((part**2).sum())
            out.append(book @ part + length * radius + 1e-9 * length * (np.sqrt((book**2).sum(1)) + radius) + 1e-6)
        return out

    def visit(self, anchor: np.ndarray, done: Callable[[np.ndarray, float], bool]) -> None:
        """Hands the rows of cells by falling bound to ``done(rows, bound of all that is left)`` until it returns true."""
        first, second = self.bounds(anchor)
        orders = [np.argsort(-b, kind="stable") for b in (first, second)]
        a, b = first[orders[0]].tolist(), second[orders[1]].tolist()
        code_a, code_b = (c[o].tolist() for c, o in zip(self.codes, orders))
        heap, step = [(-(a[0] + b[0]), 0, 0)], FIRST_CELLS
        while heap:
            ranges: list[np.ndarray] = []
            while heap and len(ranges) < step:
                _, i, j = heappop(heap)
                if j + 1 < len(b):
                    heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
                cell = code_a[i] * self.width + code_b[j]
                if self.starts[cell] < self.starts[cell + 1]:
                    ranges.append(np.arange(self.starts[cell], self.starts[cell + 1]))
            if ranges and done(np.concatenate(ranges), -heap[0][0] if heap else float("-inf")):
                return
            step *= 2


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > k:  # what ties with the k-th stays for the ids to decide
        high = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[high], ids[high]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def best_of_label(shard: Shard, uid: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the shard's best ``k`` other rows of the label."""
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def done(rows: np.ndarray, ahead: float) -> bool:
        nonlocal best
        rows = rows[(shard.labels[rows] == label) & (shard.uids[rows] != uid)]
        if len(rows):
            best = _top(np.r_[best[0], shard.scores(rows, anchor)], np.r_[best[1], shard.ids[rows]], k)
        return len(best[0]) == k and best[0][-1] > ahead

    shard.visit(anchor, done)
    return best


def best_in_windows(shard: Shard, label: int, anchor: np.ndarray, positives: list[int], k: int) -> Iterator[tuple[int, int, int]]:
    """(positive score, negative id, negative score) of the shard's best ``k`` rows of other labels in each window."""
    windows = {p: (-(-p // 2), 95 * p // 100) for p in sorted(positives, reverse=True) if p >= 0}  # whole scores from and to
    if not windows:
        return
    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = min(a for a, _ in windows.values()), max(z for _, z in windows.values())
    found, certified = {}, set()

    def done(rows: np.ndarray, ahead: float) -> bool:
        nonlocal scores, ids
        rows = rows[shard.labels[rows] != label]
        new = shard.scores(rows, anchor)
        keep = (new >= low) & (new <= high)
        scores, ids = np.r_[scores, new[keep]], np.r_[ids, shard.ids[rows][keep]]
        for p, (a, z) in windows.items():
            if p not in certified:
                inside = (scores >= a) & (scores <= z)
                found[p] = _top(scores[inside], ids[inside], k)
                if ahead < a or (len(found[p][0]) == k and found[p][0][-1] > ahead):
                    certified.add(p)
        return len(certified) == len(windows)

    shard.visit(anchor, done)
    for p, (s, i) in found.items():
        for score, name in zip(s.tolist(), i.tolist()):
            yield p, name, score


def _anchors(index: DataFrame, dims: int, every: int, blocks: int) -> DataFrame:
    """uid, block, vec_id, label and vector of the anchors."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                at = np.flatnonzero(ids % every == 0)
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(-1, dims)[at]
                yield pa.RecordBatch.from_pydict({"uid": (np.int64(row["shard"]) << 32) + at, "vec_id": ids[at], "label": labels[at], "vector": pa.array([v.tobytes() for v in vectors], pa.binary())})

    found = index.select("shard", "ids", "labels", "vectors").mapInArrow(pick, "uid long, vec_id long, label long, vector binary")
    return found.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))


def _against_all(index: DataFrame, anchors: DataFrame, shards: int, blocks: int, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(shard, block of anchors)`` over every pair of a shard and a block."""
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(fn, schema)


def mine(embeddings: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, codes: int = CODES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; anchors are ids divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings), "vectors")
    count, n_anchors, dims = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("vector"))).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    shards, blocks = -(-count // SHARD_ROWS), -(-n_anchors // ANCHOR_BLOCK)
    books = train_codebooks(rows, dims, codes)
    index = stored(build_index(rows, books, dims, shards), "multi-index")
    anchors = stored(_anchors(index, dims, every, blocks), "anchors")

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows:
            shard = Shard(left.to_pylist()[0], books, dims)
            for uid, label, vector in zip(*(right[c].to_pylist() for c in ("uid", "label", "vector"))):
                scores, ids = best_of_label(shard, uid, label, np.frombuffer(vector, "<i8"), n_positives)
                out += [(uid, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("uid", "positive_id", "positive_score"))})

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows:
            shard = Shard(left.to_pylist()[0], books, dims)
            for uid, label, vector, scores in zip(*(right[c].to_pylist() for c in ("uid", "label", "vector", "scores"))):
                out += [(uid, *found) for found in best_in_windows(shard, label, np.frombuffer(vector, "<i8"), scores, n_negatives)]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("uid", "positive_score", "negative_id", "negative_score"))})

    near = _against_all(index, anchors, shards, blocks, positives, "uid long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("positive_score").desc(), "positive_id"))
    near = stored(near.withColumn("place", place).where(F.col("place") <= n_positives), "positives")
    wanted = anchors.join(near.groupBy("uid").agg(F.collect_set("positive_score").alias("scores")), "uid")
    found = _against_all(index, wanted, shards, blocks, negatives, "uid long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("uid", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id"))
    found = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n_negatives)
    pairs = near.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return pairs.join(found, ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
