"""Rank correlations and top shares of many weightings of the same rows, each ranked exactly.

A weighting gives every row a score, and a rank is the place of a score among those of all
rows: each weighting is a sort of its own. Rows never travel for it. A task takes some
hundred thousand rows at a time, works out the scores of a weighting, sorts them and cuts
them at the edges of buckets, which hold about ``BUCKET_ROWS`` rows of the table. What
travels are the distinct scores of a bucket as differences from one to the next with the sum
of the target's ranks beside them, some eight bytes a row; a task merges what belongs to a
bucket, to which a frequent score adds one entry for each chunk, and only sums leave it. As many weightings are done at once as ``ROWS_AT_ONCE`` allows, and what
travelled is dropped before the next ones start, so the disk doesn't hold them all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, shuffles_dropped

CHUNK_ROWS, SAMPLES = 131_072, 512  # rows sorted at once, and how many of them stand for the others where edges are chosen
BUCKET_ROWS = 262_144
ROWS_AT_ONCE = 100_000_000  # rows times weightings that travel together, at some eight bytes
EXACT = 2.0**53
Weights = Sequence[tuple[int, float, float, float]]  # number, then the weights of return, probability and penalty
INPUTS = ("norm_return", "up_probability", "uncertainty_score")


def blended(inputs: Sequence, w_ret, w_prob, w_pen):
    """The score of a row before it is rounded, of columns or of arrays."""
    return inputs[0] * w_ret + inputs[1] * w_prob - inputs[2] * w_pen


def _scores(inputs: Sequence[np.ndarray], weights: Sequence[float]) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.rint(blended(inputs, *weights) * 1e12) + 0.0  # no negative zero


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[np.ndarray], np.ndarray, int]]:
    """By part: the three inputs of the rows that have a score, their target ranks (0: unknown), the number of rows without one."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flushed() -> Iterator[tuple[str, list[np.ndarray], np.ndarray, int]]:
        table = pa.Table.from_batches(held).combine_chunks()
        inputs = [table.column(c).to_numpy() for c in INPUTS]
        scored = np.logical_and.reduce([table.column(c).is_valid().to_numpy() for c in INPUTS])
        rank = table.column("target_rank").fill_null(0.0).to_numpy()
        part = pa.concat_arrays(table.column("part").chunks).dictionary_encode()
        codes = part.indices.to_numpy()
        for code, name in enumerate(part.dictionary.to_pylist()):
            own, some = codes == code, (codes == code) & scored
            yield name, [x[some] for x in inputs], rank[some], int(own.sum() - some.sum())

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield from flushed()
            held, rows = [], 0
    if rows:
        yield from flushed()


def _pack(values: np.ndarray, code: str) -> bytes:
    """Whole numbers in four bytes each, or in eight if one needs them."""
    small = not len(values) or values.max() < 1 << 32
    return (b"4" if small else b"8") + np.ascontiguousarray(values, "<u4" if small else "<u8").tobytes() if code == "u" else b"f" + np.ascontiguousarray(values, "<f8").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    kind = {b"4": "<u4", b"8": "<u8", b"f": "<f8"}[packed[:1]]
    out = np.frombuffer(packed, kind, offset=1)
    return out if kind == "<f8" else out.astype(np.int64)


def pack_scores(scores: np.ndarray) -> bytes:
    """Sorted scores: the first one, and the differences of each to the next where these are exact."""
    if not len(scores) or not (np.abs(scores[[0, -1]]) < EXACT).all():
        return _pack(scores, "f")
    whole = scores.astype(np.int64)
    return b"i" + whole[:1].astype("<i8").tobytes() + _pack(np.diff(whole), "u")


def unpack_scores(packed: bytes) -> np.ndarray:
    if packed[:1] == b"f":
        return _unpack(packed)
    first = np.frombuffer(packed[1:9], "<i8")
    return np.concatenate([first, first + np.cumsum(_unpack(packed[9:]))]).astype(np.float64)


def _sampled(base: DataFrame, weights: Weights) -> DataFrame:
    """(candidate, part, rows, unscored, samples): every so manyth score of sorted chunks."""
    size = CHUNK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, inputs, _, unscored in _chunks(batches, size):
            n = len(inputs[0])
            step = max(1, n // SAMPLES)
            picked = [np.sort(_scores(inputs, w))[step // 2 :: step] for _, *w in weights]
            k = len(weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, *_ in weights], pa.int32()), pa.array([part] * k), pa.array([n + unscored] * k, pa.int64()), pa.array([unscored] * k, pa.int64()), pa.array([_pack(x, "f") for x in picked], pa.binary()), pa.array([step] * k, pa.int32())],
                names=["candidate", "part", "rows", "unscored", "samples", "step"],
            )

    return base.mapInArrow(run, "candidate int, part string, rows long, unscored long, samples binary, step int")


def _edged(bucket_rows: int):
    """The edges of a candidate's buckets in a part: scores that cut the samples into equal weights."""

    def run(table: pa.Table) -> pa.Table:
        rows, unscored = (sum(table.column(c).to_pylist()) for c in ("rows", "unscored"))
        samples = [_unpack(x) for x in table.column("samples").to_pylist()]
        stand = np.concatenate([np.full(len(x), step) for x, step in zip(samples, table.column("step").to_pylist())])
        values = np.concatenate(samples)
        order = np.argsort(values)
        values, upto = values[order], np.cumsum(stand[order])
        buckets = max(1, -(-(rows - unscored) // bucket_rows))
        at = np.searchsorted(upto, np.arange(1, buckets) * (upto[-1] / buckets)) if len(values) else np.zeros(0, int)
        edges = np.unique(values[at])  # a frequent score makes one edge
        edges = edges[~np.isnan(edges)]
        fields = [table.column("candidate").slice(0, 1), table.column("part").slice(0, 1), pa.array([rows], pa.int64()), pa.array([unscored], pa.int64()), pa.array([edges.tolist()], pa.list_(pa.float64()))]
        return pa.table(fields, names=["candidate", "part", "rows", "unscored", "edges"])

    return run


def _cut(scores: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where sorted scores are cut: bucket b holds those from edge b - 1 up to, but without, edge b."""
    return np.concatenate([[0], np.searchsorted(scores, edges, "left"), [len(scores)]])


def _counted(base: DataFrame, weights: Weights, edges: dict[tuple[int, str], np.ndarray]) -> DataFrame:
    """(candidate, part, counts): the rows of each bucket, a row for each task."""
    size = CHUNK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], np.ndarray] = {}
        for part, inputs, _, _ in _chunks(batches, size):
            for i, *w in weights:
                found = np.bincount(_bucket(_scores(inputs, w), edges[i, part]), minlength=len(edges[i, part]) + 1)
                total[i, part] = total.get((i, part), 0) + found
        for (i, part), found in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part]), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["candidate", "part", "counts"])

    cells = base.mapInArrow(run, "candidate int, part string, counts array<long>").select("candidate", "part", F.posexplode("counts").alias("bucket", "rows"))
    return cells.groupBy("candidate", "part", "bucket").agg(F.sum("rows").alias("rows"))


def _bucket(scores: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, scores, "right")  # not-a-number lies behind all edges


def _firsts(scores: np.ndarray) -> np.ndarray:
    """Where each distinct one of sorted scores begins."""
    if not len(scores):
        return np.zeros(0, np.int64)
    new = (scores[1:] != scores[:-1]) & ~(np.isnan(scores[1:]) & np.isnan(scores[:-1]))
    return np.flatnonzero(np.concatenate([[True], new]))


PACKED = "candidate int, part string, bucket int, scores binary, counts binary, known binary, ranks binary, tt double"


def _packed(base: DataFrame, weights: Weights, edges: dict[tuple[int, str], np.ndarray], sizes: dict[tuple[int, str], tuple[int, int, int]]) -> DataFrame:
    """What a chunk has for each bucket: distinct scores with their rows, the rows with a target among them and the sum of
    twice these targets' ranks; the first two are empty where every score is one row."""
    size = CHUNK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, inputs, rank, _ in _chunks(batches, size):
            for i, *w in weights:
                if not len(rank):
                    continue
                scores = _scores(inputs, w)
                order = np.argsort(scores)
                scores, own = scores[order], rank[order]
                first = _firsts(scores)
                scores, count = scores[first], np.diff(np.append(first, len(scores)))
                squares = np.add.reduceat(np.where(own > 0, (own - (sizes[i, part][0] + 1) / 2.0) ** 2, 0.0), first)
                known, twice = np.add.reduceat((own > 0).astype(np.int64), first), np.add.reduceat(np.rint(own * 2.0), first)  # ranks are whole or half
                ends = _cut(scores, edges[i, part])
                cells = [(b, slice(ends[b], ends[b + 1])) for b in np.flatnonzero(np.diff(ends))]
                single = [bool((count[at] == 1).all()) for _, at in cells]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i] * len(cells), pa.int32()), pa.array([part] * len(cells)), pa.array([b for b, _ in cells], pa.int32()),
                        pa.array([pack_scores(scores[at]) for _, at in cells], pa.binary()),
                        *[pa.array([b"" if one else _pack(x[at], "u") for (_, at), one in zip(cells, single)], pa.binary()) for x in (count, known)],
                        pa.array([_pack(twice[at], "u") for _, at in cells], pa.binary()), pa.array([squares[at].sum() for _, at in cells], pa.float64()),
                    ],
                    names=[c.split()[0] for c in PACKED.split(", ")],
                )

    return base.mapInArrow(run, PACKED)


MERGED = "candidate int, part string, k double, r double, rr double, t double, tt double, rt double, cut double, need long"


def _merged(before: dict[tuple[int, str], np.ndarray], sizes: dict[tuple[int, str], tuple[int, int, int]]):
    """Ranks the scores of a bucket; sums around the middle rank keep their digits."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, part, bucket = (k.as_py() for k in key)
        rows, unscored, top = sizes[i, part]
        lower = int(before[i, part][bucket])
        columns = {c: table.column(c).to_pylist() for c in ("scores", "counts", "known", "ranks")}
        twice = [_unpack(x) for x in columns["ranks"]]
        values = [np.concatenate(x) for x in (
            [unpack_scores(x) for x in columns["scores"]], [_unpack(x) if x else np.ones(len(t), np.int64) for x, t in zip(columns["counts"], twice)],
            [_unpack(x) if x else (t > 0).astype(np.int64) for x, t in zip(columns["known"], twice)], twice,
        )]
        order = np.argsort(values[0])
        scores, *values = (x[order] for x in values)
        first = _firsts(scores)
        scores, (count, known, twice) = scores[first], (np.add.reduceat(x, first) for x in values)
        start, held, middle = np.cumsum(count) - count, int(count.sum()), (rows + 1) / 2.0
        r = lower + start + (count + 1) / 2.0 - middle
        t = twice / 2.0 - known * middle
        cut, need = None, None
        higher = rows - unscored - lower - held  # rows of the buckets above
        if higher < top <= higher + held:
            at = int(np.searchsorted(start, held - (top - higher), "right")) - 1
            cut, need = float(scores[at]), top - higher - int(held - start[at] - count[at])
        sums = [float(known.sum()), (known * r).sum(), (known * r * r).sum(), t.sum(), sum(table.column("tt").to_pylist()), (r * t).sum()]
        fields = [pa.array([i], pa.int32()), pa.array([part]), *[pa.array([x], pa.float64()) for x in sums], pa.array([cut], pa.float64(), from_pandas=False), pa.array([need], pa.int64())]
        return pa.table(fields, names=[c.split()[0] for c in MERGED.split(", ")])

    return run


def rank_sums(base: DataFrame, weights: Weights, share: float) -> DataFrame:
    """A row per candidate and part: ``_n`` rows, ``_top`` rows of the top, sums of the ranks of score (r) and target (t)
    over the ``k`` rows that have both, the lowest score of the top ``cut`` (missing: no score) and how many of its rows are ``need``ed.

    ``base`` is stored: part, the inputs of the scores, target_rank.
    """
    slim = base.select("part", *[F.col(c).cast("double").alias(c) for c in INPUTS], "target_rank")
    with shuffles_dropped(base.sparkSession):
        schema = "candidate int, part string, rows long, unscored long, edges array<double>"
        found = _sampled(slim, weights).groupBy("candidate", "part").applyInArrow(_edged(BUCKET_ROWS), schema).collect()  # a row per candidate and part
        edges = {(r["candidate"], r["part"]): np.array(r["edges"], float) for r in found}
        rows = {(r["candidate"], r["part"]): (r["rows"], r["unscored"]) for r in found}
        counts = {k: np.zeros(len(x) + 1, np.int64) for k, x in edges.items()}
        for r in _counted(slim, weights, edges).collect():  # a row per bucket
            counts[r["candidate"], r["part"]][r["bucket"]] = r["rows"]
    before = {k: np.cumsum(x) - x for k, x in counts.items()}
    sizes = {k: (n, unscored, max(1, int(np.floor(n * share)))) for k, (n, unscored) in rows.items()}
    names = [c.split()[0] for c in MERGED.split(", ")][2:]
    each = max(1, ROWS_AT_ONCE // max(1, sum(n for (i, _), (n, _) in rows.items() if i == weights[0][0])))
    sums: dict[tuple[int, str], dict] = {}
    for at in range(0, len(weights), each):
        with shuffles_dropped(base.sparkSession):
            some = _packed(slim, weights[at : at + each], edges, sizes).groupBy("candidate", "part", "bucket").applyInArrow(_merged(before, sizes), MERGED)
            total = some.groupBy("candidate", "part").agg(*[F.sum(c).alias(c) for c in names[:6]], F.max("cut").alias("cut"), F.max("need").alias("need"))
            sums.update({(r["candidate"], r["part"]): r.asDict() for r in total.collect()})  # a row per candidate and part
    out = []
    for (i, *w), (part, (n, unscored, top)) in ((x, (k[1], v)) for x in weights for k, v in sizes.items() if k[0] == x[0]):
        own = sums.get((i, part), dict.fromkeys(names) | {"k": 0.0})
        need = own["need"] if top <= n - unscored else top - (n - unscored)
        out.append((i, part, *map(float, w), n, top, *[own[c] for c in names[:7]], need))
    schema = "candidate int, part string, w_ret double, w_prob double, w_pen double, _n long, _top long, k double, r double, rr double, t double, tt double, rt double, _cut double, _need long"
    return cut_lineage(base.sparkSession.createDataFrame(out, schema))
