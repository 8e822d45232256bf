"""Byte strings that repeat across documents, found by a distributed merge sort of suffixes, and removed.

Suffixes start at anchors (see ``repeats``): one byte position in about sixteen, the same in equal windows.
Anchors whose gram occurs in one document alone are dropped first. The other suffixes are sorted within their
chunk, front-coded (the length shared with the suffix before, then the rest) and exchanged by range. Each
range combines its runs with a loser tree that carries the length every head shares with the last winner:
two heads with different lengths are decided by those alone, two with equal lengths are compared beyond them,
so no known prefix is read again. A sort key begins with a uniform hash of the gram, which makes the ranges
even without sampling and keeps suffixes that share the gram in one range.

In the merged order, the windows that hold an anchor at offset o are equal if the suffixes share window - o
bytes and the o bytes before the anchor are equal; the smallest document of such a class keeps its window.

A gram found in ``hot_chunks`` chunks or more is not sorted by anchor: each of its windows is a suffix of its
own, keyed by the hash of the whole window, so one passage in a third of all documents spreads over all
ranges and costs one entry per chunk and window.

Defined cases: a null text is empty; a null doc_id keeps everything and causes no removal; repeated rows
share a doc_id and don't remove each other; texts shorter than the window keep everything; an empty table
gives an empty result; other columns are not read.
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
GRAM = 20
HOT_CHUNKS = 20_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,stop:int>>"


class _Items:
    """The suffixes of a chunk in sorted order, and the windows each stands for."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        self.ids = table["doc_id"].to_pylist()
        self.data = [(t or "").encode() for t in table["text"].to_pylist()]
        self.window, self.gram = window, gram
        self.rows = [r for r, d in enumerate(self.data) if len(d) >= window and self.ids[r] is not None]

    def bytes_of(self, row: int) -> np.ndarray:
        return np.frombuffer(self.data[row], np.uint8)

    def grams(self, plan: R.Plan) -> tuple[np.ndarray, ...]:
        """fingerprint, row, anchor, first and last window."""
        parts = []
        for row in self.rows:
            hashed = R.rolling(R.SYMBOLS[self.bytes_of(row)], self.gram)
            place, low, high = R.anchors(hashed, self.window - self.gram + 1)
            parts.append((plan.prints(hashed[place]), np.full(len(place), row, np.int32), place, low, high))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), *(np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*parts))

    def suffixes(self, plan: R.Plan, notes: pa.Table) -> dict[str, np.ndarray]:
        """Suffixes of repeated anchors, in sort order: key bytes, left bytes, offsets, doc, row, place."""
        prints, rows, place, low, high = self.grams(plan)
        values, _ = R.distinct(prints, rows)
        at = np.searchsorted(values, prints)
        keep = R.marks_of(notes, 0, "marks", values, plan, plan.bits)[at] if len(values) else np.zeros(0, bool)
        hot = R.marks_of(notes, 0, "extra", values, plan, plan.bits)[at] & keep if len(values) else np.zeros(0, bool)
        cold = keep & ~hot
        sizes = (high - low + 1)[hot]
        starts = np.repeat(low[hot], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hot_rows = np.repeat(rows[hot], sizes)
        row = np.r_[rows[cold], hot_rows]
        pos = np.r_[place[cold], starts]
        near = np.r_[(place - high)[cold], np.zeros(len(starts), np.int64)]
        far = np.r_[(place - low)[cold], np.zeros(len(starts), np.int64)]
        head = np.r_[prints[cold] << np.uint64(64 - plan.bits), np.zeros(len(starts), np.uint64)]
        order = np.argsort(row, kind="stable")
        row, pos, near, far, head = (x[order] for x in (row, pos, near, far, head))
        left_width = self.window - self.gram
        right = np.zeros((len(row), self.window), np.uint8)
        left = np.zeros((len(row), left_width), np.uint8)
        edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for a, b in zip(edges, np.r_[edges[1:], len(row)]):
            text = np.pad(self.bytes_of(int(row[a])), (left_width, self.window))
            right[a:b] = text[(pos[a:b] + left_width)[:, None] + np.arange(self.window)]
            left[a:b] = text[(pos[a:b] + left_width)[:, None] - 1 - np.arange(left_width)]
            whole = far[a:b] == 0
            if whole.any() and hot.any():
                mine = a + np.flatnonzero(whole & (head[a:b] == 0))
                head[mine] = R.rolling(R.SYMBOLS[self.bytes_of(int(row[a]))], self.window)[pos[mine]]
        # bytes beyond what the windows need don't matter, so that equal needs give equal suffixes
        right[np.arange(self.window) >= (self.window - near)[:, None]] = 0
        left[np.arange(left_width) >= far[:, None]] = 0
        keys = np.hstack([head.astype(">u8").view(np.uint8).reshape(-1, 8), right])
        wide = np.zeros((len(row), 64), np.uint8)
        wide[:, : keys.shape[1]] = keys[:, :64]
        docs = np.array([-1 if x is None else x for x in self.ids], np.int64)[row] if len(row) else np.zeros(0, np.int64)
        lefts = np.zeros((len(row), -(-left_width // 8) * 8), np.uint8)
        lefts[:, :left_width] = left
        columns = [*wide.view(">u8").T, *lefts.view(">u8").T, near, far]
        order, new = _sorted_rows(columns, docs)
        return {"keys": keys[order], "left": left[order], "near": near[order], "far": far[order], "doc": docs[order], "row": row[order], "pos": pos[order], "new": new}


def _sorted_rows(columns: list[np.ndarray], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by ``columns``, then ``last``, and where the columns change. Only rows that tie in the first column are compared in the others."""
    order = np.argsort(columns[0], kind="stable")
    new = np.ones(len(order), bool)
    first = columns[0][order]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    if len(tied):
        rows = order[tied]
        rows = rows[np.lexsort((last[rows], *[c[rows] for c in columns[::-1]]))]
        order[tied] = rows
        new[tied] = np.r_[True, np.any([c[rows][1:] != c[rows][:-1] for c in columns], axis=0)]
    return order, new


def _shared(keys: np.ndarray) -> np.ndarray:
    """Bytes each key shares with the one before."""
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    differs = keys[1:] != keys[:-1]
    return np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), keys.shape[1])]


def _front_code(part: dict[str, np.ndarray]) -> bytes:
    """A run: shared lengths, offsets, docs, then the rests of the keys and the left bytes in use."""
    keys, n = part["keys"], len(part["keys"])
    shared = _shared(keys)
    rests = keys[np.arange(keys.shape[1]) >= shared[:, None]].tobytes()
    lefts = part["left"][np.arange(part["left"].shape[1]) < part["far"][:, None]].tobytes()
    return n.to_bytes(4, "little") + shared.astype(np.uint8).tobytes() + part["near"].astype(np.uint8).tobytes() + part["far"].astype(np.uint8).tobytes() + part["doc"].tobytes() + lefts + rests


def _decode(blob: bytes, window: int, gram: int) -> dict:
    n = int.from_bytes(blob[:4], "little")
    shared, near, far = (np.frombuffer(blob, np.uint8, n, 4 + i * n).astype(np.int64) for i in range(3))
    docs = np.frombuffer(blob, np.int64, n, 4 + 3 * n)
    at = 4 + 11 * n
    left = np.zeros((n, window - gram), np.uint8)
    fill = np.arange(window - gram) < far[:, None]
    left[fill] = np.frombuffer(blob, np.uint8, int(far.sum()), at)
    at += int(far.sum())
    keys, last, length = [], b"", 8 + window
    for s in shared.tolist():
        last = last[:s] + blob[at : at + length - s]
        at += length - s
        keys.append(last)
    return {"keys": keys, "shared": shared.tolist(), "near": near, "far": far, "doc": docs, "left": left}


class LoserTree:
    """Merges sorted runs of byte keys. Each head knows how many bytes it shares with the last key given out.

    ``merge`` yields (run, bytes shared with the key before). Keys have one length. Equal keys come in the
    order of their runs.
    """

    def __init__(self, runs: list[list[bytes]], shared: list[list[int]]):
        self.runs, self.shared = runs, shared
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2

    def merge(self):
        runs, shared, size = self.runs, self.shared, self.size
        at = [0] * size
        head = [runs[r][0] if r < len(runs) and runs[r] else None for r in range(size)]
        lcp = [0] * size

        def play(a: int, b: int) -> tuple[int, int]:
            """(winner, loser); the loser's length is then its share with the winner."""
            x, y = head[a], head[b]
            if y is None:
                return a, b
            if x is None:
                return b, a
            la, lb = lcp[a], lcp[b]
            if la > lb:
                return a, b
            if lb > la:
                return b, a
            if x[la:] == y[la:]:
                a, b = (a, b) if a < b else (b, a)
                lcp[b] = len(x)
                return a, b
            rest = len(x) - la
            first = int.from_bytes(x[la:], "big")
            second = int.from_bytes(y[la:], "big")
            same = la + rest - ((first ^ second).bit_length() + 7) // 8
            if first < second:
                lcp[b] = same
                return a, b
            lcp[a] = same
            return b, a

        losers = [0] * size
        level = list(range(size))
        base = size
        while base > 1:  # the first round of matches, from the leaves up
            base //= 2
            winners = []
            for i in range(base):
                w, l = play(level[2 * i], level[2 * i + 1])
                losers[base + i] = l
                winners.append(w)
            level = winners
        winner = level[0]
        while head[winner] is not None:
            yield winner, lcp[winner]
            at[winner] += 1
            run = runs[winner]
            if at[winner] < len(run):
                head[winner] = run[at[winner]]
                lcp[winner] = shared[winner][at[winner]]
            else:
                head[winner] = None
            node = (size + winner) // 2
            while node:
                winner, losers[node] = play(winner, losers[node])
                node //= 2


def _merge_range(window: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        chunks = table["chunk"].to_pylist()
        parts = [_decode(b, window, gram) for b in table["run"].to_pylist()]
        steps = list(LoserTree([p["keys"] for p in parts], [p["shared"] for p in parts]).merge())
        which, shared = (np.array(x, np.int64) for x in zip(*steps))
        first = np.cumsum([0, *(len(p["keys"]) for p in parts)])
        order = np.zeros(len(which), np.int64)  # merged place -> place in the joined runs
        for r in range(len(parts)):
            order[which == r] = np.arange(first[r], first[r + 1])
        near, far, doc = (np.concatenate([p[k] for p in parts])[order] for k in ("near", "far", "doc"))
        left = np.vstack([p["left"] for p in parts])[order]
        mask = np.zeros(len(order), np.uint64)
        before = np.zeros(len(order), np.uint64)
        close = shared >= 8 + gram
        paired = close | np.r_[close[1:], False]
        for o in range(window - gram + 1):
            if o:
                before = R.mix(before + R.SYMBOLS[left[:, o - 1]], o)
            live = np.flatnonzero(paired & (near <= o) & (o <= far))
            if len(live) < 2:
                continue
            group = np.cumsum(shared < 8 + window - o)[live]
            place = np.lexsort((doc[live], before[live], group))
            g, b, d = group[place], before[live][place], doc[live][place]
            start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (b[1:] != b[:-1])])
            least = np.repeat(d[start], np.diff(np.r_[start, len(d)]))
            mask[live[place[d > least]]] |= np.uint64(1 << o)
        out = np.zeros(len(order), np.uint64)
        out[order] = mask
        bucket = table["bucket"][0].as_py()
        rows = [(c, 1, bucket, out[first[r] : first[r + 1]].tobytes(), b"") for r, c in enumerate(chunks) if out[first[r] : first[r + 1]].any()]
        return R.mark_rows(rows)

    return run


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256, the kept bytes and the removed spans.

    A byte goes if a string of ``window`` bytes that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input. ``gram`` is the length of an anchor, 8 to ``window``.
    """
    if not 8 <= gram <= window or window - gram > 62 or window > 56:
        raise ValueError("gram must be 8 to window, window at most 56 bytes and gram + 62")
    plan = R.Plan(text_bytes(docs))
    chunks = pack_chunks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ["doc_id", "text"])

    def grams(chunk: int, table: pa.Table) -> pa.Table:
        prints, rows, *_ = _Items(table, window, gram).grams(plan)
        return R.runs(chunk, *R.distinct(prints, rows), plan)

    def sorted_run(chunk: int, table: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        if notes.num_rows:
            s = _Items(table, window, gram).suffixes(plan, notes)
            s = {k: v[s["new"]] for k, v in s.items()}
            heads = s["keys"][:, :8].copy().view(">u8").ravel().astype(np.uint64)
            for b, i, j in plan.bucket_slices(heads, 64):
                rows.append((b, chunk, _front_code({k: v[i:j] for k, v in s.items()}), b""))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("bucket", pa.int32()), ("chunk", pa.int64()), ("run", pa.binary()), ("flags", pa.binary())))})

    def remove(chunk: int, table: pa.Table, notes: pa.Table) -> pa.Table:
        items = _Items(table, window, gram)
        gone: dict[int, np.ndarray] = {}
        if notes.num_rows:
            s = items.suffixes(plan, notes)
            entry = np.cumsum(s["new"]) - 1
            fresh = {k: v[s["new"]] for k, v in s.items()}
            heads = fresh["keys"][:, :8].copy().view(">u8").ravel().astype(np.uint64)
            answers = np.zeros(len(heads), np.uint64)
            got = {b: m for k, b, m in zip(notes["kind"].to_pylist(), notes["bucket"].to_pylist(), notes["marks"].to_pylist()) if k == 1}
            for b, i, j in plan.bucket_slices(heads, 64):
                if b in got:
                    answers[i:j] = np.frombuffer(got[b], np.uint64)
            mask = answers[entry]
            local = s["doc"] > fresh["doc"][entry] if len(entry) else np.zeros(0, bool)
            found_rows, found_starts = [], []
            for o in range(window - gram + 1):
                use = (s["near"] <= o) & (o <= s["far"]) & (local | ((mask >> np.uint64(o)) & np.uint64(1)).astype(bool))
                found_rows.append(s["row"][use])
                found_starts.append(s["pos"][use] - o)
            rows, starts = np.concatenate(found_rows), np.concatenate(found_starts)
            order = np.argsort(rows, kind="stable")
            rows, starts = rows[order], starts[order]
            edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
            for a, b in zip(edges, np.r_[edges[1:], len(rows)]):
                gone[int(rows[a])] = starts[a:b]
        result: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for row, (doc_id, data) in enumerate(zip(items.ids, items.data)):
            spans, removed, kept = [], 0, data
            if row in gone:
                taken = R.covered(len(data), gone[row], window)
                edge = np.flatnonzero(np.diff(np.r_[False, taken, False].astype(np.int8)))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                removed = int(taken.sum())
                kept = np.frombuffer(data, np.uint8)[~taken].tobytes()
            for key, value in zip(result, (doc_id, len(data), removed, len(spans), hashlib.sha256(kept).hexdigest(), kept, spans)):
                result[key].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(result.items(), kinds)})

    marks = R.mark_repeated(scan_chunks(chunks, grams, R.RUN_SCHEMA), hot_chunks)
    last = scan_with_notes(chunks, marks, sorted_run, R.RUN_SCHEMA).groupBy("bucket").applyInArrow(_merge_range(window, gram), R.MARK_SCHEMA)
    return scan_with_notes(chunks, marks.unionByName(last), remove, SCHEMA)
