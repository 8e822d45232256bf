"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within half the radius of both. Every distinct
fingerprint stands for all of its variants within half the radius (2,081 at radius 4); the shuffle goes by
the leading bits of the variant, and a task spells out the variants of its own bits only, so that a
fingerprint travels once per leading word and not once per variant. Fingerprints that meet in a variant are
checked bit by bit and linked to the smallest of the group: all in a group lie within the radius of each
other, so these links have the same components as all pairs, and no pairs of a group are listed.

Documents with one fingerprint are one node, so copies never meet. A group of one variant has at most 2,081
fingerprints. Tasks split their bits further while they have too many variants for their memory.

Defined cases: a null, empty or blank text has the fingerprint zero, linked like any other; a text with fewer
words than a shingle is one shingle; a null doc_id gets a fingerprint and the component of its fingerprint,
but is never the id of a component (null where no other document is in it); every row gives one row, repeated
rows too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import plain_columns, sixty_four, stored
from tickloom.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
VARIANTS_PER_TASK = 4_000_000


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of the ASCII-lower-cased words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only \x20 and \x09-\x0D separate
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(size, len(words)) - 1 :].tolist())]


def simhash(text: str | None, size: int = SHINGLE) -> int:
    hashes = np.array(shingle_hashes(text, size), np.uint64)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def document_simhashes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, key (hash of the text) and fp (signed 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [sixty_four(simhash(t.as_py(), size)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(prints, pa.int64())], ["doc_id", "key", "fp"])

    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, key long, fp long")


def _ball(bits: int, most: int) -> int:
    return sum(math.comb(bits, i) for i in range(most + 1))


def _masks(bits: int, most: int) -> list[int]:
    """All words of ``bits`` bits with at most ``most`` ones."""
    out = [0]
    level = [(0, 0)]
    for _ in range(most):
        level = [(m | 1 << b, b + 1) for m, low in level for b in range(low, bits)]
        out += [m for m, _ in level]
    return out


def _collide(low: np.ndarray, which: np.ndarray, radius: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprint, smallest of its group) for all that meet in a variant of the lowest ``bits`` bits."""
    if len(low) < 2:
        return
    sizes = np.array([_ball(bits, r) for r in range(int(radius.max()) + 1)])
    if bits and sizes[radius].sum() > VARIANTS_PER_TASK and len(low) > 64:
        top = (low >> np.uint64(bits - 1)) & np.uint64(1)
        rest = low & np.uint64((1 << (bits - 1)) - 1)
        for side in (0, 1):
            left = radius - (top != side)
            keep = left >= 0
            yield from _collide(rest[keep], which[keep], left[keep], bits - 1)
        return
    variants, owners = [], []
    for r in range(int(radius.max()) + 1):
        mine = radius == r
        masks = np.array(_masks(bits, r), np.uint64)
        variants.append((low[mine][:, None] ^ masks).ravel())
        owners.append(np.repeat(which[mine], len(masks)))
    value, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    same = np.r_[False, value[1:] == value[:-1]]
    grouped = same | np.r_[same[1:], False]
    value, owner, same = value[grouped], owner[grouped], same[grouped]
    if not len(value):
        return
    first = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.r_[first, len(owner)]))
    pair = np.unique((owner.astype(np.uint64) << np.uint64(32) | least.astype(np.uint64))[owner != least])
    yield (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) for nodes (node, fp) with distinct fp: enough links for the components of all pairs within ``radius``, which is even."""
    half = radius // 2
    count = nodes.count()
    lead = 0
    while lead < 40 and count * _ball(64, half) > VARIANTS_PER_TASK << lead:
        lead += 1
    moves = F.array(*[F.lit(m).cast("long") for m in _masks(lead, half)])
    top = F.shiftrightunsigned("fp", 64 - lead) if lead else F.lit(0).cast("long")
    spread = nodes.select("node", "fp", F.explode(F.transform(moves, lambda m: top.bitwiseXOR(m))).alias("lead"))
    bits = 64 - lead

    def meet(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        order = np.argsort(node)
        node, fp = node[order], table["fp"].to_numpy()[order].view(np.uint64)
        own = np.uint64(table["lead"][0].as_py())
        moved = np.bitwise_count((fp >> np.uint64(bits)) ^ own).astype(np.int64) if lead else np.zeros(len(fp), np.int64)
        low = fp & np.uint64((1 << bits) - 1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in _collide(low, np.arange(len(fp), dtype=np.int64), half - moved, bits):
            near = np.bitwise_count(fp[x] ^ fp[y]) <= radius
            a.append(node[x[near]])
            b.append(node[y[near]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return spread.groupBy("lead").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id and key (hash of the text) of every row."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is searched from either side")
    prints = stored(document_simhashes(docs, size), "simhashes")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    named = nodes.where("node IS NOT NULL")
    # a document that carries several fingerprints (a repeated doc_id) joins them: its rows are one node
    roots = components(links(named, radius).union(_same_id(prints, nodes)))
    found = named.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    found = stored(found, "simhash-components")
    return prints.join(found, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "key")


def _same_id(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of fingerprints that rows of one doc_id have."""
    many = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    rows = prints.join(many, "doc_id").join(nodes, "fp")
    return rows.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, and of several such rows one with the smallest text hash.

    Rows without a doc_id are never that document and go where their class has one; a class of such rows alone
    keeps them all, as nothing tells which is first.
    """
    return plain_columns(docs, _keep_first)


def _keep_first(docs: DataFrame) -> DataFrame:
    classes = stored(near_duplicates(docs), "near-duplicates")
    first = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    chosen = first.select("doc_id", "key").unionByName(classes.where("doc_id IS NULL AND component_id IS NULL").select("doc_id", "key").distinct())
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    hit = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_key"))
    kept = docs.join(chosen, hit, "left_semi")
    if first.where("n > 1").isEmpty():
        return kept
    repeated = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return repeated.unionByName(kept.where("doc_id IS NULL"))
