"""Benchmark passages in documents, found by latent semantic retrieval and checked word by word.

Words are weighted by their inverse document frequency over all documents (hashed to 2^18 features, counted in each
task and summed by feature). The benchmark's TF-IDF passages, in hashed blocks of about 200, each get a randomised
singular value decomposition in a task of its own. The right singular vectors of the largest values, with ``KEPT`` of the
passages' squared mass, are the index: words that go together in passages fall together, and what tells near-equal passages
apart is left to the words. A passage of which they keep less than ``FAITHFUL`` adds a direction of its own, so that none is lost. Every document
is cut into overlapping windows of a few lengths, so that a passage lies whole in one that it fills to half
at least. The words that a window shares with a passage bound their longest common subsequence from above; pairs
that reach 0.8 of the passage by this count, or half where its answer may be in the document, are looked at. The subsequence decides: 0.8 of the passage is a leak,
whatever the cosine; 0.5 is a paraphrase if the passage's answer, its last sentence, stands in the window unchanged
and the cosine of window and passage, both projected, reaches the limit. A window's length counts the words of the
index only, so that rare words around a passage don't hide it.

The index of a block is about 200 passages x their words x 200 floats; ``BLOCKS_PER_SCAN`` of them
go to the executors at once, and a larger benchmark takes more scans. Documents are never shuffled.

Defined cases: null or empty texts and items match nothing; a null doc_id is reported like any other; every
repeated row is reported; repeated items are reported each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import repeats as R
from tickloom.llm.common import plain_columns

FEATURES = 1 << 18
BLOCK_ITEMS = 224
BLOCKS_PER_SCAN = 8
COSINE = 0.4
COPIED = 0.8
PARAPHRASED = 0.5
KEPT = 0.9
FAITHFUL = 0.5
WORDS_AT_ONCE = 8192  # words whose vectors are added up together
RANKS = 4  # repetitions of a word in a passage that are told apart when shared words are counted
SCHEMA = "doc_id long, key long, item_id long, start int, stop int, cosine double, lcs_ratio double, answer_found boolean"


#: Words are what lies between white space and outer punctuation, without ASCII case.
_BREAKS = R.WHITE.copy()
_BREAKS[list(b".,;:!?\"'()[]*|")] = True
_CASELESS = R.SYMBOLS.copy()
_CASELESS[65:91] = R.SYMBOLS[97:123]


def word_ids(text: str | None) -> np.ndarray:
    return R.word_ids((text or "").encode(), _BREAKS, _CASELESS)


def _features(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint64(FEATURES - 1)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weights of all features: log((1 + documents) / (1 + documents with it)) + 0.05."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                total += 1
                if text.as_py():
                    counts[R.sorted_distinct(_features(word_ids(text.as_py())))] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used].astype(np.int32)), pa.array(np.r_[total, counts[used]])], ["feature", "n"])

    summed = docs.select(F.col("text").cast("string")).mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # one row per feature at most
    feature, n = found["feature"].to_numpy(), found["n"].to_numpy()
    total = int(n[feature < 0].sum())
    counts = np.zeros(FEATURES)
    counts[feature[feature >= 0]] = n[feature >= 0]
    return (np.log((1 + total) / (1 + counts)) + 0.05).astype(np.float32)


@dataclass
class Index:
    """A block's passages in the space of their right singular vectors."""

    place: np.ndarray  # feature -> row of ``vectors``, -1 outside
    vectors: np.ndarray
    latent: np.ndarray  # passages projected, of unit length
    items: list[tuple[int, list[int], list[int]]]  # id, words, words of the answer


def randomised_svd(rows: np.ndarray, rank: int, seed: int = 7, rounds: int = 2, share: float = 1.0) -> np.ndarray:
    """The right singular vectors of the ``rank`` largest values, or of as many as hold the share of the squared mass, as columns."""
    width = min(rank + 8, *rows.shape)
    sketch = rows @ np.random.default_rng(seed).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        sketch = rows @ (rows.T @ np.linalg.qr(sketch)[0])
    base = np.linalg.qr(sketch)[0]
    _, values, right = np.linalg.svd(base.T @ rows, full_matrices=False)
    enough = int(np.searchsorted(np.cumsum(values.astype(float) ** 2), share * float((rows.astype(float) ** 2).sum()) - 1e-6)) + 1
    return right[: min(rank, enough, int((values > 1e-6).sum()))].T.astype(np.float32)


def directions(rows: np.ndarray) -> np.ndarray:
    """Orthonormal columns: the leading right singular vectors of passages of unit length, and what they miss of a passage that they render badly."""
    vectors = randomised_svd(rows, len(rows), share=KEPT)
    latent = rows @ vectors
    poor = np.flatnonzero((latent * latent).sum(axis=1) < FAITHFUL)
    if len(poor):
        vectors = np.linalg.qr(np.hstack([vectors, (rows[poor] - latent[poor] @ vectors.T).T]))[0]
    return vectors.astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _answer(text: str, ids: list[int]) -> list[int]:
    last = word_ids(re.split(r"[.!?]\s+", text.strip())[-1])
    return ids[-max(3, len(last)) :] if len(last) < len(ids) else ids[-3:]


def fit(items: DataFrame, idf: np.ndarray) -> DataFrame:
    """(block, blob) with the index of every block of (item_id, text)."""

    def one(table: pa.Table) -> pa.Table:
        kept = []
        for item, text in sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist()), key=str):
            ids = word_ids(text)
            if len(ids):
                kept.append((item, ids, _answer(text, ids.tolist())))
        place = np.full(FEATURES, -1, np.int32)
        if not kept:
            return pa.table({"block": table["block"][:1], "blob": pa.array([b""], pa.binary())})
        used = np.unique(np.concatenate([_features(ids) for _, ids, _ in kept]))
        place[used] = np.arange(len(used))
        rows = np.zeros((len(kept), len(used)), np.float32)
        for i, (_, ids, _) in enumerate(kept):
            np.add.at(rows[i], place[_features(ids)], idf[_features(ids)])
        rows = _unit(rows)
        vectors = directions(rows)
        index = Index(place, vectors, _unit(rows @ vectors), [(item, ids.tolist(), answer) for item, ids, answer in kept])
        return pa.table({"block": table["block"][:1], "blob": pa.array([pickle.dumps(index)], pa.binary())})

    return items.groupBy("block").applyInArrow(one, "block long, blob binary")


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine operation on all of ``a`` per word of ``b``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    open_ = whole
    for x in b:
        hit = open_ & masks.get(x, 0)
        if hit:
            open_ = (open_ + hit | open_ - hit) & whole
    return len(a) - open_.bit_count()


def _contains(words: list[int], part: list[int]) -> bool:
    return any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1) if words[i] == part[0])


def _window_of(length: int) -> int:
    """The window for a passage: a power of two, of which it fills three quarters at most."""
    return max(16, 1 << (-(-4 * length // 3) - 1).bit_length())


def _threes(ids: np.ndarray) -> np.ndarray:
    """A value of every three words in a row, equal for equal words."""
    return (ids[:-2] * np.uint64(3) + ids[1:-1]) * np.uint64(5) + ids[2:]


class Searcher:
    """One worker's search with a list of indexes."""

    def __init__(self, indexes: list[Index], idf: np.ndarray, cosine: float = COSINE):
        self.indexes, self.idf, self.cosine = indexes, idf.astype(np.float32), cosine
        self.classes = []
        self.counts = [[Counter(words) for _, words, _ in index.items] for index in indexes]
        self.lengths = [np.array([len(words) for _, words, _ in index.items]) for index in indexes]
        self.answers = [np.array([_threes(np.array((a + [0, 0])[:3], np.uint64))[0] for _, _, a in index.items]) for index in indexes]
        self.asked = [(np.sort(a), np.argsort(a, kind="stable")) for a in self.answers]
        self.short = [np.array([len(a) < 3 for _, _, a in index.items]) for index in indexes]
        for index in indexes:
            sizes = np.array([_window_of(len(w)) for _, w, _ in index.items])
            own = [(int(s), np.flatnonzero(sizes == s)) for s in np.unique(sizes)]
            self.classes.append([(s, which, self._repetitions(index, which), self._rarest(index, which)) for s, which in own])

    def _rarest(self, index: Index, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the index (a row), whether it is among the words of which a leak of a passage (columns) has one.

        A text with at least t of a passage's L words has one of any L - t + 1 of them; the rarest are asked for. The
        first table is for paraphrases, the second for copies.
        """
        out = np.zeros((2, len(index.vectors), len(which)), bool)
        for column, item in enumerate(which.tolist()):
            used = _features(np.array(index.items[item][1], np.uint64))
            used = used[np.argsort(-self.idf[used], kind="stable")]
            for table, share in zip(out, (PARAPHRASED, COPIED)):
                table[index.place[used[: len(used) - math.ceil(share * len(used) - 1e-9) + 1]], column] = True
        return out[0], out[1]

    @staticmethod
    def _repetitions(index: Index, which: np.ndarray) -> np.ndarray:
        """For each rank and word of the index (a row), whether the passages (columns) have the word more often than the rank; the last rank stands for all above."""
        out = np.zeros((RANKS, len(index.vectors), len(which)), np.uint16)
        for column, item in enumerate(which.tolist()):
            used, n = np.unique(index.place[_features(np.array(index.items[item][1], np.uint64))], return_counts=True)
            for rank in range(RANKS):
                out[rank, used[n > rank], column] = 1
        return out.reshape(-1, len(which))

    @staticmethod
    def _shared(repetitions: np.ndarray, columns: np.ndarray, place: np.ndarray, step: int, windows: int) -> np.ndarray:
        """At least the common words of every passage in ``columns`` and every window of four steps with a step on either side."""
        known = np.flatnonzero(place >= 0)
        width = len(repetitions) // RANKS
        blocks = -(-len(place) // step)
        out = np.zeros((max(blocks, windows) + 7, len(columns)), np.int32)
        if len(known):
            key = known // step * width + place[known]
            key.sort()
            at = np.arange(len(key))
            first = R.changes(key)
            rank = np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)), RANKS - 1)
            block = key // width
            begins = np.flatnonzero(R.changes(block))
            out[block[begins] + 2] = np.add.reduceat(repetitions[(rank * width + key % width)[:, None], columns], begins)
        sums = np.cumsum(out, axis=0, out=out)  # row i: blocks up to i - 2
        start = np.arange(windows)
        return sums[np.minimum(start + 6, len(sums) - 1)] - sums[start]

    @staticmethod
    def _cosines(index: Index, which: np.ndarray, place: np.ndarray, weight: np.ndarray, starts: np.ndarray, step: int) -> np.ndarray:
        """Cosines of the projections of windows of four steps and those of the passages ``which``."""
        known = np.flatnonzero(place >= 0)
        own = (starts // step)[:, None] + np.arange(4)  # steps that overlapping windows share are added up once
        steps = R.sorted_distinct(own.ravel())
        a = np.searchsorted(known, steps * step)
        n = np.searchsorted(known, (steps + 1) * step) - a
        sums = np.zeros((len(steps), index.vectors.shape[1]), np.float32)
        some = max(1, WORDS_AT_ONCE // step)
        for at in range(0, len(steps), some):
            first, lengths = a[at : at + some], n[at : at + some]
            filled = np.flatnonzero(lengths)
            if len(filled):
                first, lengths = first[filled], lengths[filled]
                begins = np.cumsum(lengths) - lengths
                words = known[np.repeat(first - begins, lengths) + np.arange(int(lengths.sum()))]
                rows = index.vectors[place[words]]
                rows *= weight[words, None]
                sums[at + filled] = np.add.reduceat(rows, begins)
        windows = _unit(sums[np.searchsorted(steps, own)].sum(axis=1))
        return np.einsum("wd,pd->wp", windows, index.latent[which])  # ``@`` would wake a thread for every core

    def _check(self, best: dict, key: tuple[int, int], ids: np.ndarray, a: int, b: int, cosine: float, held: Counter) -> None:
        """Keeps the window if it holds the passage or a near paraphrase with its answer, and is the best so far."""
        item, words, answer = self.indexes[key[0]].items[key[1]]
        most = sum(min(n, held[w]) for w, n in self.counts[key[0]][key[1]].items() if w in held)
        if most < PARAPHRASED * len(words):
            return
        window = ids[max(0, a - len(words) // 4) : b + len(words) // 4].tolist()
        answered = answer[0] in held and _contains(window, answer)
        least = PARAPHRASED if answered and cosine >= self.cosine else COPIED
        if most < least * len(words):
            return
        ratio = common_words(words, window) / len(words)
        if ratio < least:
            return
        found = (item, a, b, min(1.0, cosine), ratio, answered)
        if key not in best or (ratio, found[3], -a) > (best[key][4], best[key][3], -best[key][1]):
            best[key] = found

    def search(self, text: str | None) -> list[tuple]:
        """(item, start, stop, cosine, ratio, answer) of the best window for every item found."""
        ids = word_ids(text)
        if not len(ids):
            return []
        features = _features(ids)
        weight = self.idf[features]
        threes = R.sorted_distinct(_threes(ids))
        best: dict[tuple[int, int], tuple] = {}
        for number, index in enumerate(self.indexes):
            place = index.place[features]
            answered = self.short[number].copy()  # False: the answer is surely not in the document
            if len(threes):
                values, which = self.asked[number]
                answered[which] |= threes[np.minimum(np.searchsorted(threes, values), len(threes) - 1)] == values
            present = np.zeros(len(index.vectors) + 1, bool)
            present[place] = True  # -1 is the last
            present = np.flatnonzero(present[:-1])
            for size, passages, repetitions, (loose, strict) in self.classes[number]:
                columns = np.flatnonzero(np.where(answered[passages], loose[present].any(axis=0), strict[present].any(axis=0)))
                if not len(columns):
                    continue
                which = passages[columns]
                starts = np.arange(0, max(1, len(ids) - size + size // 4), size // 4)
                shared = self._shared(repetitions, columns, place, size // 4, len(starts))
                lengths = self.lengths[number][which]
                least = np.where(answered[which], PARAPHRASED, COPIED) * lengths
                live = np.flatnonzero((shared >= least).any(axis=1))
                if not len(live):
                    continue
                starts, shared = starts[live], shared[live]
                stops = np.minimum(starts + size, len(ids))
                near = self._cosines(index, which, place, weight, starts, size // 4)
                last, held = -1, Counter()
                for w, c in zip(*(x.tolist() for x in np.nonzero((shared >= COPIED * lengths) | (shared >= least) & (near >= self.cosine)))):
                    a, b = int(starts[w]), int(stops[w])
                    if w != last:  # the words of the window with a step on either side, as much as any passage's check takes
                        last, held = w, Counter(ids[max(0, a - size // 4) : b + size // 4].tolist())
                    self._check(best, (number, int(which[c])), ids, a, b, float(near[w, c]), held)
        return list(best.values())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, start, stop, cosine, lcs_ratio, answer_found) for every document and passage in it.

    ``key`` is the XXH64 of the text, to tell rows of one doc_id apart.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string"))
    idf = inverse_frequencies(docs)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = -(-items.count() // (BLOCK_ITEMS * 7 // 8))  # hashed blocks are not quite even
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    fitted = fit(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), idf)
    found = spark.createDataFrame([], SCHEMA)
    for group in _grouped(fitted):
        if group:
            found = found.unionByName(_scan(slim, group, idf))
    return found


def _grouped(fitted: DataFrame) -> Iterator[list[Index]]:
    group: list[Index] = []
    for row in fitted.toLocalIterator():
        if row["blob"]:
            group.append(pickle.loads(row["blob"]))
        if len(group) == BLOCKS_PER_SCAN:
            yield group
            group = []
    yield group


def _scan(slim: DataFrame, group: list[Index], idf: np.ndarray) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast((group, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value)
        for batch in batches:
            out = [(d, k, *hit) for d, k, t in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["text"]) for hit in searcher.search(t.as_py())]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())
            names = ("doc_id", "key", "item_id", "start", "stop", "cosine", "lcs_ratio", "answer_found")
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return slim.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which a passage was found."""
    return plain_columns(docs, lambda plain: _keep_clean(plain, benchmark))


def _keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    hit = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_key"))
    return docs.join(bad, hit, "left_anti")
