"""Ranked search against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from tickloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, rank int, score string, block int"
ITEMS = "item_id long, text string, doc_id string, term int"


def make(seed):
    rng = random.Random(seed)
    words = ["the", "of", *(f"w{i}" for i in range(60)), "ÉTÉ", "été", "日本", "x1y"]
    draw = lambda n: " ".join(rng.choices(words, weights=[40, 30, *(60 / (i + 1) for i in range(60)), 1, 1, 1, 1], k=n))
    docs = [(i, draw(rng.randrange(1, 80))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " ,.;\x00\t"), (203, "The-THE_the"), (None, "the w59 w58"), (7, "a repeated id w59"), (204, draw(9000))]
    docs += [(300 + i, "w57 same copy of ties") for i in range(25)]
    items = [(i, draw(rng.randrange(1, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w57 the"), (53, "copy TIES"), (3, "w59 a second row of an item")]
    return docs, items


def terms(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    found = [(d, terms(t)) for d, t in docs]
    found = [(d, t) for d, t in found if t]
    n_docs, total = len(found), sum(len(t) for _, t in found)
    out = []
    for item in {i for i, _ in items}:
        scores = {i: 0 for i in range(len(found))}
        for term in {t for i, text in items if i == item for t in terms(text)}:
            df = sum(term in t for _, t in found)
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for i, (_, t) in enumerate(found):
                if tf := t.count(term):
                    scores[i] += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * n_docs) // total)))
        best = sorted((-s, found[i][0] is None, found[i][0] or 0) for i, s in scores.items() if s > 0)[:k]
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("segment,block,short", [(400, 60, 0.2), (4 << 20, 8 << 20, 1 / 16), (3000, 200, 0.0)])
def test_search_matches_brute_force(spark, monkeypatch, segment, block, short):
    monkeypatch.setattr(lexical_search, "ITEM_BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "SHORT", short)
    docs, items = make(5)
    found = lexical_search.search(spark.createDataFrame([(*r, 1, 2, "s", 3) for r in docs], DOCS), spark.createDataFrame([(*r, "d", 4) for r in items], ITEMS), segment_bytes=segment)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(docs.where("false"), items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0


def test_hybrid_skips_but_loses_nothing():
    rng = np.random.default_rng(3)
    for _, short in itertools.product(range(60), (1, 8, 40)):
        lists = []
        for _ in range(rng.integers(1, 9)):
            places = np.flatnonzero(rng.random(60) < rng.choice([0.05, 0.3, 0.9])).astype(np.int64)
            if len(places):
                scores = rng.integers(1, 50, len(places))
                lists.append((places, scores, int(scores.max())))
        whole = np.zeros(60, np.int64)
        for p, s, _ in lists:
            whole[p] += s
        least = int(rng.integers(1, 160))
        places, sums = lexical_search.hybrid(lists, short, least)
        want = np.flatnonzero(whole >= least)
        assert places.tolist() == want.tolist() and sums.tolist() == whole[want].tolist()
