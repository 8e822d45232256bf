"""Word windows that repeat across documents, found by one doubling, and removed.

The first level looks at windows of half the length, one chosen (anchor) in every full window; the second
extends the anchors that repeat, and only those, to the full window. There are these two levels whatever the
window: shorter ones that ``levels`` lists for windows above 50 words are not looked at, and a first level without
candidates leaves the second without rows. The last level keeps, for every window, the smallest document that holds it.

Shuffles: the chunks once (both levels reuse that exchange), sorted runs of fingerprints for the first level,
sorted runs of 96-bit hashes with the smallest document for the last, and marks back to the chunks. A run has
every window once, so hot passages and groups of copies cost one entry per chunk.

Defined cases: a null text has no words; documents with fewer words than the window keep everything; a null
doc_id is neither smaller nor larger than another, so such a row keeps everything and causes no removal;
repeated rows have the same doc_id and so don't remove each other; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import repeats as R
from tickloom.llm.common import pack_chunks, scan_chunks, scan_with_notes, text_bytes

WINDOW = 50
LAST_BITS = 64
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:int,stop:int>>"


def levels(window: int) -> list[int]:
    """Window lengths of a full doubling, each twice the one before at most; ``repeated_windows`` uses the last two."""
    out = [window]
    while out[0] > 25:
        out.insert(0, -(-out[0] // 2))
    return out


class _Documents:
    """The windows of a chunk's documents at each level."""

    def __init__(self, table: pa.Table, window: int):
        self.texts = table["text"].to_pylist()
        self.ids = table["doc_id"].to_pylist()
        self.window = window
        self.symbols = {}
        for row, text in enumerate(self.texts):
            if text is None or self.ids[row] is None or len(text) < 2 * window - 1:
                continue
            symbols = R.word_ids(text.encode())
            if len(symbols) >= window:
                self.symbols[row] = symbols

    def first(self, length: int, plan: R.Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """fingerprint, row, first and last window of every anchor."""
        parts = []
        for row, symbols in self.symbols.items():
            grams = R.rolling(symbols, length)
            place, low, high = R.anchors(grams, self.window - length + 1)
            parts.append((plan.prints(grams[place]), np.full(len(place), row, np.int32), low, high))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def candidates(self, length: int, plan: R.Plan, notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Row and start of the full windows whose anchor repeats."""
        prints, rows, low, high = self.first(length, plan)
        values, _ = R.distinct(prints, rows)
        marks = R.marks_of(notes, 0, "marks", values, plan, plan.bits)
        keep = marks[np.searchsorted(values, prints)] if len(values) else np.zeros(0, bool)
        rows, low, sizes = rows[keep], low[keep], (high - low + 1)[keep]
        starts = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(rows, sizes), starts

    def entries(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct windows sorted by hash: (hash, check, smallest doc, entry of every candidate)."""
        h, g = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint32)
        edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
        for a, b in zip(edges, np.r_[edges[1:], len(rows)]):
            symbols = self.symbols[int(rows[a])]
            h[a:b] = R.rolling(symbols, self.window)[starts[a:b]]
            g[a:b] = (R.rolling(symbols, self.window, 1)[starts[a:b]] >> np.uint64(32)).astype(np.uint32)
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)[rows] if len(rows) else np.zeros(0, np.int64)
        order = np.lexsort((ids, g, h))
        sh, sg = h[order], g[order]
        new = np.r_[True, (sh[1:] != sh[:-1]) | (sg[1:] != sg[:-1])] if len(sh) else np.zeros(0, bool)
        entry = np.zeros(len(rows), np.int64)
        entry[order] = np.cumsum(new) - 1
        return sh[new], sg[new], ids[order][new], entry


def _run_blob(h: np.ndarray, g: np.ndarray, docs: np.ndarray) -> bytes:
    return h.tobytes() + g.tobytes() + docs.tobytes()


def _run_arrays(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 20
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n), np.frombuffer(blob, np.int64, n, 12 * n)


def _smallest(table: pa.Table) -> pa.Table:
    """Marks the windows of each run that a smaller document of another run holds."""
    chunks = table["chunk"].to_pylist()
    parts = [_run_arrays(b) for b in table["run"].to_pylist()]
    h, g, docs = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((docs, g, h))
    sh, sg, sd = h[order], g[order], docs[order]
    first = np.flatnonzero(np.r_[True, (sh[1:] != sh[:-1]) | (sg[1:] != sg[:-1])])
    least = np.repeat(sd[first], np.diff(np.r_[first, len(sd)]))
    later = np.zeros(len(h), bool)
    later[order] = sd > least
    rows, at, bucket = [], 0, table["bucket"][0].as_py()
    for chunk, part in zip(chunks, parts):
        piece = later[at : at + len(part[0])]
        at += len(part[0])
        if piece.any():
            rows.append((chunk, 1, bucket, R.bits_to(piece), b""))
    return R.mark_rows(rows)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256, kept_text and the removed word spans.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input.
    """
    plan, lengths = R.Plan(text_bytes(docs)), levels(window)
    half = lengths[-2] if len(lengths) > 1 else window
    chunks = pack_chunks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ["doc_id", "text"])

    def first_level(chunk: int, table: pa.Table) -> pa.Table:
        prints, rows, _, _ = _Documents(table, window).first(half, plan)
        return R.runs(chunk, *R.distinct(prints, rows), plan)

    def next_level(chunk: int, table: pa.Table, notes: pa.Table) -> pa.Table:
        found = _Documents(table, window)
        h, g, ids, _ = found.entries(*found.candidates(half, plan, notes)) if notes.num_rows else (np.zeros(0, np.uint64),) * 4
        rows = [(b, chunk, _run_blob(h[i:j], g[i:j], ids[i:j]), b"") for b, i, j in plan.bucket_slices(h, LAST_BITS)]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("bucket", pa.int32()), ("chunk", pa.int64()), ("run", pa.binary()), ("flags", pa.binary())))})

    def remove(chunk: int, table: pa.Table, notes: pa.Table) -> pa.Table:
        found = _Documents(table, window)
        gone: dict[int, np.ndarray] = {}
        if notes.num_rows:
            rows, starts = found.candidates(half, plan, notes)
            h, _, ids, entry = found.entries(rows, starts)
            mine = np.array([0 if x is None else x for x in found.ids], np.int64)[rows]
            out = R.marks_of(notes, 1, "marks", h, plan, LAST_BITS)[entry] | (mine > ids[entry])
            rows, starts = rows[out], starts[out]
            edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
            for a, b in zip(edges, np.r_[edges[1:], len(rows)]):
                gone[int(rows[a])] = starts[a:b]
        result: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans")}
        for row, (doc_id, text) in enumerate(zip(found.ids, found.texts)):
            split = (text or "").encode().split()  # bytes.split() cuts at \x20 and \x09-\x0D alone
            spans, removed = [], 0
            if row in gone:
                mask = R.covered(len(split), gone[row], window)
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                removed = int(mask.sum())
                kept = [w for w, m in zip(split, mask.tolist()) if not m]
            else:
                kept = split
            joined = b" ".join(kept)
            for key, value in zip(result, (doc_id, len(split), removed, hashlib.sha256(joined).hexdigest(), joined.decode(), spans)):
                result[key].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(result.items(), kinds)})

    marks = R.mark_repeated(scan_chunks(chunks, first_level, R.RUN_SCHEMA), 1 << 62)
    last = scan_with_notes(chunks, marks, next_level, R.RUN_SCHEMA).groupBy("bucket").applyInArrow(_smallest, R.MARK_SCHEMA)
    return scan_with_notes(chunks, marks.unionByName(last), remove, SCHEMA)
