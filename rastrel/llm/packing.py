"""Packing: concatenate all documents' token ids and cut the stream into windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import staged
from .subwords import Subwords

TOKENS = "part int, first long, doc_id long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Token bytes that one output batch holds, about.
BATCH_BYTES = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenised(path: str, end_id: int):
    """Ids of each document and its place in the partition's own stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords.load(path)
        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = [x + end for x in subwords.encode(some.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                first = at + np.cumsum(n) - n
                at += int(n.sum())
                small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids] if subwords.narrow else ids
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(first), some.column(0), pa.array(n), pa.array(small, pa.binary())], ["part", "first", "doc_id", "doc_tokens", "ids"])
        subwords.release()

    return run


def _cut(window: int, narrow: bool):
    """Pieces of each document between window ends; the first and last of a window's records are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for doc, first, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<u2" if narrow else "<u4").astype("<u4")
                n, at = len(ids), 0
                while at < n:
                    k = min(n - at, window - (first + at) % window)
                    for column, value in zip(out, (doc, at, k, ids[at : at + k].tobytes(), n, (first + at) // window, (first + at) % window), strict=True):
                        column.append(value)
                    held += 4 * k
                    at += k
                if held > BATCH_BYTES:
                    yield _pieces(out)
                    out, held = [[] for _ in range(7)], 0
            yield _pieces(out)

    return run


def _pieces(out: list[list]) -> pa.RecordBatch:
    long = pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else long) for i, c in enumerate(out)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    First pass: ids of each document, with `end_id` after them, and its offset in its partition's stream, staged.
    Second: prefix sums over the partitions' totals (one row a partition) give global offsets, and each document
    is cut where a window ends. Only the last window is padded. Null and empty texts are one piece of `end_id`;
    a very long text spans windows; repeated rows and null doc_ids are documents of their own; an empty table
    gives no rows; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenised(path, end_id), TOKENS)
    rows = staged(rows, "pack-ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = rows.groupBy("part").agg(F.sum("doc_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("first") + F.col("_before")).alias("first"), "ids")
    return rows.mapInArrow(_cut(window, Subwords.load(path).narrow), PIECES)
