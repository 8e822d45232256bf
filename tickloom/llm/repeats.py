"""Windows that repeat across documents: rolling hashes, anchors, and the exchange that finds repeated ones.

A document is an array of 64-bit symbols (words or bytes). Every window of ``window`` symbols holds one
anchor: its leftmost smallest gram of ``gram`` symbols. Equal windows hold equal anchors at equal offsets, so
only windows whose anchor occurs in two documents can repeat. Fingerprints travel as sorted runs, one per
chunk and bucket, each value once per run: a passage that a third of all documents share costs one value per
chunk, whatever its frequency. Buckets are equal ranges of a uniform hash, so none of them is hot.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEGMENT = 1 << 20  # anchors are chosen in segments of so many windows, which leaves 20 bits for the place
BUCKET_BYTES = 24 << 20  # text bytes for each bucket of the exchange
RUN_SCHEMA = "bucket int, chunk long, run binary, flags binary"
MARK_SCHEMA = "chunk long, kind int, bucket int, marks binary, extra binary"


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.multiply.accumulate(np.r_[one, np.full(n - 1, base, np.uint64)])
    down = np.multiply.accumulate(np.r_[one, np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)])
    return up, down


def rolling(symbols: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``length`` consecutive symbols."""
    n = len(symbols)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(BASES[base], 1 << max(12, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=total[1:])
    return mix((total[length:] - total[: n - length + 1]) * down[: n - length + 1], base)


#: One 64-bit symbol for each byte value.
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def word_ids(data: bytes, separators: np.ndarray = WHITE, symbols: np.ndarray = SYMBOLS) -> np.ndarray:
    """A 64-bit id of every word: the hash of its bytes' symbols. ``separators`` says for each byte value whether it ends a word."""
    raw = np.frombuffer(data, np.uint8)
    outside = np.ones(len(raw) + 2, bool)
    outside[1:-1] = separators[raw]
    ends = np.flatnonzero(outside[1:] != outside[:-1])
    starts, stops = ends[::2], ends[1::2]
    up, down = _powers(BASES[0], 1 << max(12, len(raw).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(symbols[raw] * up[: len(raw)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts], 0x2545F491)


def span_ids(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = _powers(BASES[0], 1 << max(12, len(raw).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(SYMBOLS[raw] * up[: len(raw)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts], 0x2545F491)


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first window, last window) for the windows of ``width`` consecutive grams."""
    count = len(grams) - width + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    found = []
    for start in range(0, count, SEGMENT - width):
        stop = min(count, start + SEGMENT - width)
        part = grams[start : stop + width - 1]
        keys = (part & ~np.uint64(SEGMENT - 1)) | np.arange(len(part), dtype=np.uint64)
        padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
        padded[: len(keys)] = keys
        table = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        n = stop - start
        found.append((np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(SEGMENT - 1)).astype(np.int64) + start)
    place = np.concatenate(found)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[first], first, np.r_[first[1:], count] - 1


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values as steps of the smallest width."""
    steps = np.r_[values[:1], np.diff(values)]
    width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(steps) > 1 else 1
    return bytes([width]) + steps[:1].tobytes() + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width] = body
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """By sorting: many times faster on millions of values than the hash table behind ``np.unique``."""
    values = np.sort(values)
    return values[changes(values)]


def bits_to(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def bits_from(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class Plan:
    """Bits of a fingerprint and number of buckets, from the bytes of all texts.

    With 14 bits beyond the number of anchors one fingerprint in 16,384 passes by chance; it costs work in the
    next level and changes no result.
    """

    def __init__(self, total_bytes: int):
        self.bits = int(min(63, max(40, total_bytes.bit_length() + 10)))
        self.buckets = max(1, total_bytes // BUCKET_BYTES)

    def edges(self, bits: int) -> np.ndarray:
        """Where each bucket but the first begins in the range of ``bits`` bits."""
        return np.array([-(-(b << bits) // self.buckets) for b in range(1, self.buckets)], np.uint64)

    def bucket_slices(self, values: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
        cuts = np.r_[0, np.searchsorted(values, self.edges(bits)), len(values)].astype(np.int64)
        return [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(self.buckets) if cuts[b] < cuts[b + 1]]

    def prints(self, grams: np.ndarray) -> np.ndarray:
        """Fingerprints of grams, independent of the order that chose the anchors."""
        return mix(grams, 0x5BF03635) >> np.uint64(64 - self.bits)


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether each occurs in two rows."""
    if not len(values):
        return values, np.zeros(0, bool)
    order = np.lexsort((rows, values))
    v, r = values[order], rows[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    last = np.r_[first[1:], len(v)] - 1
    return v[first], r[first] != r[last]


def runs(chunk: int, values: np.ndarray, many: np.ndarray, plan: Plan) -> pa.Table:
    """A chunk's sorted distinct fingerprints, cut by bucket."""
    rows = [(b, chunk, pack_sorted(values[i:j]), bits_to(many[i:j])) for b, i, j in plan.bucket_slices(values, plan.bits)]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("bucket", pa.int32()), ("chunk", pa.int64()), ("run", pa.binary()), ("flags", pa.binary())))})


def mark_rows(rows: list[tuple]) -> pa.Table:
    kinds = (("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("marks", pa.binary()), ("extra", pa.binary()))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})


def mark_repeated(level: DataFrame, hot_chunks: int) -> DataFrame:
    """For each run, which of its fingerprints occur in two documents (marks) and which in at least ``hot_chunks`` chunks (extra)."""

    def mark(table: pa.Table) -> pa.Table:
        chunks, flags = table["chunk"].to_pylist(), table["flags"].to_pylist()
        parts = [unpack_sorted(b) for b in table["run"].to_pylist()]
        many = np.concatenate([bits_from(f, len(p)) for f, p in zip(flags, parts)])
        every = np.concatenate(parts)
        values, back, counts = np.unique(every, return_inverse=True, return_counts=True)
        repeated = counts > 1
        repeated[back[many]] = True
        repeated, hot = repeated[back], (counts >= hot_chunks)[back]
        rows, at, bucket = [], 0, table["bucket"][0].as_py()
        for chunk, part in zip(chunks, parts):
            piece = slice(at, at + len(part))
            at += len(part)
            if repeated[piece].any():
                rows.append((chunk, 0, bucket, bits_to(repeated[piece]), bits_to(hot[piece])))
        return mark_rows(rows)

    return level.groupBy("bucket").applyInArrow(mark, MARK_SCHEMA).repartition("chunk")


def marks_of(notes: pa.Table, kind: int, column: str, values: np.ndarray, plan: Plan, bits: int) -> np.ndarray:
    """The marks for a chunk's sorted values, put together from its buckets."""
    out = np.zeros(len(values), bool)
    got = {b: m for k, b, m in zip(notes["kind"].to_pylist(), notes["bucket"].to_pylist(), notes[column].to_pylist()) if k == kind}
    for b, i, j in plan.bucket_slices(values, bits):
        if b in got:
            out[i:j] = bits_from(got[b], j - i)
    return out


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0
