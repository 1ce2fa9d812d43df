"""Sequence packing by concatenate-and-cut, with two passes of prefix sums over partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.llm.common import arrow_batches, saved, slices
from reelgraph.llm.libraries import byte_pairs, vocabulary

SEQUENCE = 2048
END = 1
ROWS, TEXT_BYTES = 1000, 2 << 20  # what a task tokenizes at once
CHUNK_BYTES = 1 << 21  # ids of one document are cut in a task, pieces leave it in batches of about this size

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids): ids as little-endian uint32 with ``end`` last; before: ids in its part so far."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, total = byte_pairs(path, True), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", TEXT_BYTES):
            ids, before, counts = [], [], []
            for text in batch.column("text").to_pylist():
                x = encoding.encode(text or "")
                x.append(end)
                ids.append(np.array(x, "<u4").tobytes())
                before.append(total)
                counts.append(len(x))
                total += len(x)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "before", "n_tokens", "ids"],
            )

    return docs.mapInArrow(encode, "doc_id long, part int, before long, n_tokens long, ids binary")


def _cut(length: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", CHUNK_BYTES):
            rows, held = [], 0
            for doc_id, at, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "ids")), strict=True):
                n, start = len(ids) // 4, 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(length - offset, n - start)
                    piece = ids[4 * start : 4 * (start + take)]
                    rows.append((doc_id, start, take, zlib.crc32(piece), n, sequence, offset, piece))
                    held += len(piece)
                    start += take
                    if held > CHUNK_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    return pieces


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in PIECES]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, path: str | None = None
) -> DataFrame:
    """One row a piece: its document, place there, ids and place in the packed sequences.

    All documents, each with an end id, form one stream in the order of the tokenized table; it is cut every ``length``
    ids, so only the last sequence is short. The first pass tokenizes, keeps the ids in the shared folder and counts within
    partitions; the second adds the totals of the partitions before and cuts each document by itself, since its global
    offset says where windows begin. A document over a boundary gives a piece for each side.

    A null or empty text is the end id alone. Long texts, and long runs of one character, are taken whole. A null id is carried along. Repeated rows are packed each. An empty table
    gives no piece. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_batches(docs.sparkSession, ROWS):
        ids = saved(tokenized(docs, path or vocabulary()), "tokens", compression="zstd")
    # One row a partition of the first pass: small by construction, whatever the documents.
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    placed = ids.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")
    return placed.mapInArrow(_cut(length), ", ".join(
        f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in PIECES
    ))
