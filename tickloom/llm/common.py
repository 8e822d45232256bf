"""Chunks of documents: the unit that the text operators scan, shuffle once and scan again.

A chunk holds whole rows, about ``CHUNK_BYTES`` of text, as one compressed Arrow stream. Chunk ids come from
the partition and the place in it, so a lost task rebuilds the same chunks from a stored table. All passes of
an operator read the same exchange of chunks, which Spark reuses, and notes to a chunk (marks of repeated
windows, probabilities of n-grams) are cogrouped with it. A chunk and its notes are all that a task holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
MEMO_WORDS = 1_000_000  # a worker's cache of words is emptied above this size; results don't depend on it


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes the buckets of an operator."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _cut(table: pa.Table, limit: int) -> Iterator[pa.Table]:
    sizes = pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy().astype(np.int64) + 64
    place = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], table.num_rows]):
        yield table.slice(a, b - a)


def _packed(docs: DataFrame, columns: list[str], chunk_bytes: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))
        for batch in batches:
            if not batch.num_rows:
                continue
            for piece in _cut(pa.Table.from_batches([batch]), chunk_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                    out.write_table(piece)
                yield pa.RecordBatch.from_pydict({"chunk": [(part << 32) + number], "blob": [sink.getvalue().to_pybytes()]})
                number += 1

    return docs.select(*columns).mapInArrow(pack, "chunk long, blob binary")


def pack_chunks(docs: DataFrame, columns: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, blob) rows that hold ``columns`` of every document, dealt by chunk. ``text`` is one of them."""
    return _packed(docs, columns, chunk_bytes).repartition("chunk")


def chunk_table(docs: DataFrame, columns: list[str], total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``pack_chunks``, written once in the shared folder and bucketed by chunk.

    Jobs of their own may read it, each cogroups notes with it without moving a text again. The table's name is
    dropped at once; the files stay where ``spark.checkpoint.dir`` says.
    """
    from tickloom.session import scratch_path

    spark = docs.sparkSession
    name, buckets = f"chunks_{uuid.uuid4().hex}", max(12, total_bytes // (2 * chunk_bytes))
    writer = _packed(docs, columns, chunk_bytes).write.bucketBy(buckets, "chunk").option("path", scratch_path(spark, "chunks"))
    writer.saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def plain_columns(docs: DataFrame, fn: Callable[[DataFrame], DataFrame], used: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> DataFrame:
    """``fn`` on ``docs`` whose columns but ``used`` travel as one struct: whatever they are called, they can't meet a name of the operator's own.

    Returns the columns of ``docs``, then those that ``fn`` added.
    """
    packed, others = [c for c in docs.columns if c in used], [c for c in docs.columns if c not in used]
    held = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    out = fn(docs.select(*packed, held.alias("__others")))
    back = [F.col(c) if c in used else F.col(f"__others.`{c}`").alias(c) for c in docs.columns]
    return out.select(*back, *[F.col(f"`{c}`") for c in out.columns if c not in (*packed, "__others")])


def open_chunk(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def scan_chunks(chunks: DataFrame, fn: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(chunk id, its rows)`` over every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                yield from fn(chunk, open_chunk(blob.as_py())).to_batches()

    return chunks.mapInArrow(run, schema)


def scan_with_notes(chunks: DataFrame, notes: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(chunk id, its rows, its notes)``; ``notes`` has a column chunk. A chunk without notes gets an empty table."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("notes to a chunk that does not exist")
        return pa.concat_tables([fn(c, open_chunk(b), right) for c, b in zip(left["chunk"].to_pylist(), left["blob"].to_pylist())])

    return chunks.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(run, schema)


def sixty_four(value: int) -> int:
    """An unsigned 64-bit value as Spark's signed long."""
    return value - (1 << 64) if value >> 63 else value


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs don't repeat its work, and joins with it are shuffle joins that Spark can split."""
    from tickloom.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
