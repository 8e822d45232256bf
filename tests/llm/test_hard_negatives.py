"""Hard negatives against brute force: ties, repeated rows, bad vectors, one common vector, and what the index skips."""

import math
import random

import numpy as np
import pytest

from tickloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, shard string"


def make(seed, n=400, dims=9):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(12)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(60)]  # one common vector, an anchor among them
    rows += [(100, rows[7][1], 1), (100, rows[100][1], rows[100][2]), (-50, rows[3][1], 0), (150_000, [2.0] * dims, 3), (3, rows[3][1], 9)]
    rows += [(None, rows[1][1], 1), (50_000, rows[1][1], None), (50_050, None, 1), (50_100, [float("nan")] * dims, 1), (50_150, [float("inf")] * dims, 1), (50_200, [1.0, None], 1)]
    rows += [(50_250, [0.5, 0.25], 1), (50_300, [], 2), (50_350, [-0.001] * dims, 0)]
    return rows


def brute(rows):
    kept = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (anchor, label, v) in enumerate(kept):
        if anchor % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for b, (i, other, w) in enumerate(kept) if b != a]
        for ps, positive, _ in sorted(x for x in scored if x[2] == label)[:5]:
            inside = sorted((s, i) for s, i, other in scored if other != label and -50 * ps <= -100 * s <= -95 * ps)
            out += [(anchor, positive, rank, i, -ps, -s) for rank, (s, i) in enumerate(inside[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,block,codes", [(8192, 512, 16), (60, 3, 4), (200, 512, 1)])
def test_equals_brute_force(spark, monkeypatch, shard, block, codes):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    rows = make(3)
    found = hard_negatives.mine(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), codes=codes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows) and len(got) > 50


def test_large_components(spark):
    rows = [(i * 50, [float(np.float32(1e6 * math.sin(i * j + 1))) for j in range(4)], i % 2) for i in range(12)]
    found = hard_negatives.mine(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_nothing_to_mine(spark):
    table = spark.createDataFrame([(*r, 1, "x") for r in make(4)], SCHEMA)
    assert hard_negatives.mine(table.where("false")).count() == 0
    assert hard_negatives.mine(table.where("vec_id = 50")).count() == 0
    assert hard_negatives.mine(table.where("vec_id % 50 <> 0")).count() == 0


def test_cells_come_by_falling_bounds_and_the_visit_ends_early():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (2, 6, 4))
    code = rng.integers(0, 6, (3000, 2))
    values = np.concatenate([centres[h, code[:, h]] + rng.normal(0, 4, (3000, 4)) for h in (0, 1)], axis=1).astype(np.int64)
    books = [hard_negatives._centres(values[:, s].astype(float), 16) for s in (slice(0, 4), slice(4, 8))]
    cell = hard_negatives.nearest(values[:, :4].astype(float), books[0]) * len(books[1]) + hard_negatives.nearest(values[:, 4:].astype(float), books[1])
    order = np.argsort(cell, kind="stable")
    codes = [cell[order] // len(books[1]), cell[order] % len(books[1])]
    halves = [values[order][:, :4], values[order][:, 4:]]
    radii = [np.array([max(np.sqrt(((h[c == k] - b[k]) ** 2).sum(1)), default=0.0) for k in range(len(b))]) for h, b, c in zip(halves, books, codes)]
    used = [np.isin(np.arange(len(b)), c) for b, c in zip(books, codes)]
    row = {"shard": 0, "ids": np.arange(3000).tobytes(), "labels": np.zeros(3000, np.int64).tobytes(), "vectors": values[order].tobytes(),
           "starts": np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1)).tobytes(), "used": np.concatenate(used).tobytes(), "radii": np.concatenate(radii).tobytes()}
    shard = hard_negatives.Shard(row, books, 8)
    seen, bounds = [], []

    def done(rows, ahead):
        seen.append(rows)
        bounds.append(ahead)
        return False

    anchor = values[0]
    shard.visit(anchor, done)
    assert sorted(np.concatenate(seen).tolist()) == list(range(3000))
    scores = [shard.scores(rows, anchor) for rows in seen]
    assert bounds == sorted(bounds, reverse=True) and all(s.max() <= b for s, b in zip(scores[1:], bounds))
    read = []
    exact = hard_negatives.best_of_label(shard, -1, 0, anchor, 5)
    shard.visit(anchor, lambda rows, ahead: (read.append(len(rows)), np.sort(np.concatenate([shard.scores(r, anchor) for r in seen[: len(read)]]))[-5] > ahead)[1])
    assert sum(read) < 1500  # most cells are never read
    assert exact[0].tolist() == np.sort(values @ anchor)[::-1][:5].tolist()
