"""Token ids of documents in compressed files, one frame for each document.

**Format.** A folder with two Parquet tables, so that any store Spark writes to will do and its committer hides the
files of a lost task. ``dictionary``: one row with the shared zstandard dictionary, its SHA-256 and the width of an
id. ``packs``: rows of about ``PACK_IDS`` ids, sorted by doc_id, with

* ``part``, ``pack``: the range of ids the pack belongs to and its place there; ``part_start``: ids before it in the range,
* ``first_id``, ``last_id``: for skipping, ``doc_ids`` and ``lengths`` (ids, the end id included) of its documents,
* ``offsets``: where each document's frame ends, ``frames``: the frames, one after another,
* ``dictionary_sha256``: the dictionary the frames need. Reading refuses any other.

A frame holds the ids as little-endian integers of two bytes, or four if the vocabulary is larger, and is read on its
own: a short document costs one index row and its frame. What the frames of short documents lack in length the
dictionary gives them; it is trained on the serialized ids of ``SAMPLE_DOCS`` documents of at most
``SAMPLE_TEXT_BYTES`` of text, those with the smallest hashes (a bounded sample, the same at any partitioning).

Texts are dealt by ranges of doc_id, sorted (spilling if need be), encoded and packed in one pass. Where a
tokenizer cuts at spaces, lone line ends and punctuation after letters, the pieces between are looked up in a
worker's bounded memo first; any other tokenizer encodes whole texts. Both give the same ids.

Defined cases: a null text is empty and has the end id alone; null ids come first; rows with equal ids are written
each, in the order of a hash of their text; an empty table gives no packs; without sample documents, or with too few
to train on, the dictionary is empty and frames stand alone; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import repeats as R
from tickloom.llm.common import MEMO_WORDS

END_ID = 2
PACK_IDS = 1 << 19
SAMPLE_DOCS, SAMPLE_TEXT_BYTES = 1000, 8192
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
MEMO_LENGTH = 64  # longer pieces are encoded each time
BLOCK_BYTES = 4 << 20
PIECES_AT_ONCE = 300
_PLAIN = re.compile(r" ?[!-~\w](?:[^\n]*[!-~\w])?")  # at most one space, then a letter, digit or visible ASCII; such a character ends it
DICTIONARY_SCHEMA = "dictionary binary, dictionary_sha256 string, id_bytes int"
PACK_SCHEMA = (
    "part int, pack int, part_start long, n_ids long, first_id long, last_id long, "
    "doc_ids array<long>, lengths array<int>, offsets array<long>, frames binary, dictionary_sha256 string"
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_MARKS = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])
_LETTERS = np.array([c < 128 and chr(c).isalpha() for c in range(256)])


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of joined UTF-8 texts start; ``texts`` has the start of each text that isn't empty.

    A piece starts before a space, and on both sides of a line end, that stands alone after a character that surely
    isn't white space (and, for a line end, before one); and before ASCII punctuation after a Latin letter.
    """
    b = np.r_[np.full(4, 32, np.uint8), data, np.full(1, 32, np.uint8)]  # b[i + 4] is data[i]
    at = np.flatnonzero((data == 32) | (data == 10)) + 4
    one, two, three, four = (b[at - k] for k in (1, 2, 3, 4))
    inner = lambda x: (x & 0xC0) == 0x80
    solid = (one > 32) & (one < 127)  # ASCII; then characters of two, three and four bytes, but for those ranges that have white space
    solid |= inner(one) & ((two >= 0xC3) & (two <= 0xDF) | inner(two) & ((three >= 0xE4) & (three <= 0xEF) | inner(three) & (four >= 0xF0)))
    first = np.zeros(len(b), bool)
    first[texts + 4] = True
    solid &= ~first[at]
    following = b[at + 1]
    line = solid & (b[at] == 10) & ((following > 32) & (following < 127) | (following >= 0xC3) & ((following < 0xE1) | (following > 0xE3))) & ~first[at + 1]
    marks = np.flatnonzero(_MARKS[data]) + 4
    one, two = b[marks - 1], b[marks - 2]
    letter = _LETTERS[one] | inner(one) & ((two == 0xC3) & (one != 0x97) & (one != 0xB7) | (two == 0xC4) | (two == 0xC5))
    starts = np.sort(np.concatenate([texts, at[solid & (b[at] == 32)] - 4, at[line] - 4, at[line] - 3, marks[letter & ~first[marks]] - 4]))
    return starts[np.r_[True, starts[1:] != starts[:-1]]]


class Encoder:
    """Text to ids, through the tokenizers library, in one worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        line, two = self._encode("\n"), self._encode("a\n b")
        spec = json.loads(self.tokenizer.to_str())
        self.cuts = _cuts_at_spaces(spec) and len(line) == 1 and two == self._encode("a") + line + self._encode(" b")
        self.line = line[0] if self.cuts else None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        return np.array(self._encode(text), self.kind).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """The serialized ids of each text."""
        whole = [not self.cuts or any(s in t for s in self.special) for t in texts]
        coded = [t.encode() for t, alone in zip(texts, whole) if not alone]
        rest = iter([ids for block in _blocks(coded) for ids in self._block(block)])
        return [self.whole(t) if alone else next(rest) for t, alone in zip(texts, whole)]

    def _block(self, coded: list[bytes]) -> list[bytes]:
        """Texts of about ``BLOCK_BYTES``: each distinct piece is looked up or encoded once."""
        raw, sizes = b"".join(coded), np.array([len(c) for c in coded])
        data, ends = np.frombuffer(raw, np.uint8), np.cumsum(sizes)
        if not len(data):
            return [b""] * len(coded)
        starts = piece_starts(data, (ends - sizes)[sizes > 0])
        stops = np.r_[starts[1:], len(data)]
        names = R.span_ids(data, starts, stops) ^ (stops - starts).astype(np.uint64)
        _, where, back = np.unique(names, return_index=True, return_inverse=True)
        distinct = [raw[a:z] for a, z in zip(starts[where].tolist(), stops[where].tolist())]
        if not np.array_equal(_gather(np.frombuffer(b"".join(distinct), np.uint8), np.array([len(d) for d in distinct]), back), data):
            return [self.whole(c.decode()) for c in coded]  # two pieces with one hash
        found = self._look_up(distinct)
        width = self.kind.itemsize
        counts = np.array([len(f) // width for f in found])
        ids = _gather(np.frombuffer(b"".join(found), self.kind), counts, back)
        cuts = np.r_[0, np.cumsum(counts[back])][np.searchsorted(starts, np.r_[0, ends])].tolist()
        return [ids[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])]

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces. Those in use move to the young half of the memo; when it is full, the old half goes."""
        found = list(map(self.young.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = {p: ids for p in (pieces[i] for i in missing) if (ids := self.old.get(p)) is not None}
        rest = {p: p.decode() for p in (pieces[i] for i in missing) if p not in fresh}
        plain = [p for p, text in rest.items() if _PLAIN.fullmatch(text)]
        if plain:  # in lines, as a line end after a piece is a token of its own and changes nothing before or after it
            lines = ["".join([rest[p] + "\n" for p in plain[i : i + PIECES_AT_ONCE]]) for i in range(0, len(plain), PIECES_AT_ONCE)]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.line).tolist()
            raw, width = ids.tobytes(), self.kind.itemsize
            fresh.update(zip(plain, [raw[a * width : z * width] for a, z in zip([0, *(e + 1 for e in ends)], ends)]))
        fresh.update((p, self.whole(text)) for p, text in rest.items() if p not in fresh)
        for i in missing:
            found[i] = fresh[pieces[i]]
        if len(self.young) > MEMO_WORDS // 4:
            self.old, self.young = self.young, {}
        self.young.update(fresh if max(map(len, fresh), default=0) <= MEMO_LENGTH else {p: ids for p, ids in fresh.items() if len(p) <= MEMO_LENGTH})
        return found


def _blocks(coded: list[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in coded:
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def _gather(values: np.ndarray, sizes: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (of these sizes) in the order ``back``."""
    sizes = sizes.astype(np.int32)
    begins = np.cumsum(sizes, dtype=np.int32) - sizes
    took = sizes[back]
    ends = np.cumsum(took, dtype=np.int32)
    at = np.repeat(begins[back] - (ends - took), took)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether the ids of a text are those of its pieces cut there."""
    before = spec["pre_tokenizer"] or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return bool(plain and spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["model"].get("dropout"))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _ordered(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.withColumn("place", F.xxhash64("text"))


def train_dictionary(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """One row: dictionary, dictionary_sha256, id_bytes."""
    sample = _ordered(docs).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).orderBy("place", "doc_id").limit(SAMPLE_DOCS)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = _encoder(path)
        end = np.array([end_id], encoder.kind).tobytes()
        texts = sorted(t for batch in batches for t in batch["text"].to_pylist())
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, [ids + end for ids in encoder.many(texts)]).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little to learn from
            found = b""
        yield pa.RecordBatch.from_pydict({"dictionary": [found], "dictionary_sha256": [hashlib.sha256(found).hexdigest()], "id_bytes": pa.array([encoder.kind.itemsize], pa.int32())})

    return sample.select("text").coalesce(1).mapInArrow(train, DICTIONARY_SCHEMA)


def _dictionary(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def encode_packs(docs: DataFrame, path: str, dictionary: bytes, end_id: int = END_ID, pack_ids: int = PACK_IDS) -> DataFrame:
    """The rows of ``packs``, ranges of doc_id in ascending order."""
    digest = hashlib.sha256(dictionary).hexdigest()
    ranged = _ordered(docs).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, part, number, before = _encoder(path), TaskContext.get().partitionId(), 0, 0
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        end, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        doc_ids: list[int | None] = []
        frames: list[bytes] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, before
            total, known = sum(lengths), [d for d in doc_ids if d is not None]
            row = {
                "part": pa.array([part], pa.int32()), "pack": pa.array([number], pa.int32()), "part_start": [before], "n_ids": [total],
                "first_id": pa.array([min(known, default=None)], pa.int64()), "last_id": pa.array([max(known, default=None)], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "offsets": pa.array([np.cumsum([len(f) for f in frames])], pa.list_(pa.int64())), "frames": [b"".join(frames)], "dictionary_sha256": [digest],
            }
            number, before = number + 1, before + total
            doc_ids.clear(), frames.clear(), lengths.clear()
            return pa.RecordBatch.from_pydict(row)

        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.many(batch["text"].to_pylist())):
                doc_ids.append(doc_id)
                frames.append(compressor.compress(ids + end))
                lengths.append(len(ids) // width + 1)
                size += lengths[-1]
                if size >= pack_ids:
                    yield flush()
                    size = 0
        if doc_ids:
            yield flush()

    return ranged.mapInArrow(encode, PACK_SCHEMA)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, pack_ids: int = PACK_IDS) -> None:
    """Write every document's ids to ``folder``; ``path`` names a file of the tokenizers library."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    train_dictionary(docs, path, end_id).write.parquet(f"{folder}/dictionary")
    held = spark.read.parquet(f"{folder}/dictionary").first()
    if held is None:  # no row was there to train on
        none = [(b"", hashlib.sha256(b"").hexdigest(), _encoder(path).kind.itemsize)]
        spark.createDataFrame(none, DICTIONARY_SCHEMA).write.mode("append").parquet(f"{folder}/dictionary")
    encode_packs(docs, path, held["dictionary"] if held else b"", end_id, pack_ids).write.parquet(f"{folder}/packs")


class Reader:
    """Frames to ids, in one worker; refuses packs of another dictionary."""

    def __init__(self, dictionary: bytes, id_bytes: int):
        import zstandard

        self.digest = hashlib.sha256(dictionary).hexdigest()
        self.kind = np.dtype(f"<u{id_bytes}")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def check(self, digest: str) -> None:
        if digest != self.digest:
            raise ValueError(f"the pack needs dictionary {digest}, given is {self.digest}")

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.decompressor.decompress(frame), self.kind).astype("<u4")


def _packs(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple[bytes, int]]:
    """The packs with the ids before each (start), and the dictionary."""
    packs = spark.read.schema(PACK_SCHEMA).parquet(f"{folder}/packs")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    parts = packs.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    held = spark.read.parquet(f"{folder}/dictionary").first()
    return packs.join(parts, "part").withColumn("start", F.col("before") + F.col("part_start")), (held["dictionary"], held["id_bytes"])


def _rows(packs: DataFrame, held: tuple[bytes, int], wanted: frozenset[int] | None, whole: bool) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*held)
        for batch in batches:
            for row in range(batch.num_rows):
                pack = {name: batch[name][row] for name in batch.schema.names}
                reader.check(pack["dictionary_sha256"].as_py())
                doc_ids, lengths, ends = (pack[c].as_py() for c in ("doc_ids", "lengths", "offsets"))
                frames = memoryview(pack["frames"].as_buffer())
                starts = pack["start"].as_py() + np.cumsum([0, *lengths])
                out: list[tuple] = []
                for i, doc_id in enumerate(doc_ids):
                    if wanted is None or doc_id in wanted:
                        ids = reader.ids(frames[ends[i - 1] if i else 0 : ends[i]])
                        if len(ids) != lengths[i]:
                            raise ValueError(f"document {doc_id} has {len(ids)} ids, its index says {lengths[i]}")
                        out.append((doc_id, int(starts[i]), lengths[i], ids if whole else zlib.crc32(ids.tobytes())))
                last = pa.list_(pa.int64()) if whole else pa.int64()
                kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids" if whole else "ids_crc32", last))
                yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], kind) for k, (n, kind) in enumerate(kinds)})

    columns = ("doc_ids", "lengths", "offsets", "frames", "dictionary_sha256", "start")
    return packs.select(*columns).mapInArrow(read, f"doc_id long, start long, n_tokens long, {'ids array<long>' if whole else 'ids_crc32 long'}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document."""
    return _rows(*_packs(spark, folder), None, True)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The rows of ``read_tokens`` for a few documents; only their frames are decompressed."""
    packs, held = _packs(spark, folder)
    if not doc_ids:
        return _rows(packs.where("false"), held, frozenset(), True)
    near = packs.where((F.col("first_id") <= max(doc_ids)) & (F.col("last_id") >= min(doc_ids)) & F.exists("doc_ids", lambda d: d.isin(doc_ids)))
    return _rows(near, held, frozenset(doc_ids), True)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (over the ids as little-endian integers of four bytes) of every document."""
    return _rows(*_packs(spark, folder), None, False)
