"""Packing by powers of two: each document is cut into pieces of binary lengths, and equal lengths share a bucket.

A document of n ids has as many full sequences of `size` ids (a power of two) as go into it, then one piece
for every 1 in the binary digits of the rest, longest first. A piece is a sequence: none crosses documents, and as its length
is a power of two, none is padded. Sequences are numbered bucket by bucket, longest first, without gaps, so that a
run of numbers is a batch of equal lengths.

A piece's number in its bucket is its number within the task that cut it, written with the piece, behind all pieces of
that length of earlier tasks; only the counts by task are added up. No piece is shuffled or sorted, and a
long or common document needs nothing else than the others.

Cases: a null or empty text is one piece, the end id; repeated rows are cut each; an empty table
gives no rows; extra columns don't matter; a null document id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, map_arrow, slices, texts_of


def lengths(n: int, size: int) -> np.ndarray:
    """The binary lengths of n ids' pieces, longest first."""
    rest = n % size
    digits = [1 << b for b in range(size.bit_length() - 2, -1, -1) if rest >> b & 1]
    return np.array([size] * (n // size) + digits, np.int64)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, ids: bool = False, word_ends: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, nth): every text's ids and the end id in pieces; nth counts a task's pieces of one length. ids: with them, as an array."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(size.bit_length(), np.int64)  # pieces of each length so far
        for batch in slices(batches, "text", 4 << 20):
            cuts, crc, own, total = [], [], [], []
            for each in tokens.each(batch.column("text"), tokenizer, word_ends, end_id):
                raw = each.astype("<u4", copy=False)
                cuts.append(lengths(len(raw), size))
                total.append(len(raw))
                at = 0
                for n in cuts[-1].tolist():
                    crc.append(zlib.crc32(raw[at : at + n]))
                    at += n
                if ids:
                    own.append(raw)
            length = np.concatenate([np.zeros(0, np.int64), *cuts])
            row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            start = np.cumsum(length) - length
            doc_tokens = np.array(total, np.int64)
            start -= (np.cumsum(doc_tokens) - doc_tokens)[row]
            nth = np.empty(len(length), np.int64)
            for b in range(size.bit_length()):
                same = np.flatnonzero(length == 1 << b)
                nth[same] = seen[b] + np.arange(len(same))
                seen[b] += len(same)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(doc_tokens[row]), pa.array(np.full(len(length), task, np.int32)), pa.array(nth)]
            if ids:
                ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *own]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [*NAMES, *["ids"] * ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(texts_of(docs, "doc_id"), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long" + ", ids array<int>" * ids)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]


def numbered(cut_pieces: DataFrame) -> DataFrame:
    """Pieces, as they were written, with bucket (the power of two), sequence_id and offset (0)."""
    counts = cut_pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts, "piece-counts")  # a row for each task and length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    whole = counts.groupBy("length").agg(F.sum("n").alias("n"))  # a row for each length: 13 up to 4,096
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bucket = whole.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("first"))
    base = cut(earlier.join(F.broadcast(bucket), "length").select("length", "task", (F.col("first") + F.col("earlier")).alias("base")), "piece-bases")
    placed = cut_pieces.join(base, ["length", "task"])
    rest = [c for c in cut_pieces.columns if c not in ("task", "nth")]
    return placed.select(*rest, F.log2("length").cast("int").alias("bucket"), (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, [ids,] bucket, sequence_id, offset): every text's pieces and their sequences."""
    return numbered(cut(pieces(docs, tokenizer, end_id, size, ids), "binary-pieces"))


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, size: int = 4096) -> None:
    """The sequences with their ids as Parquet, a folder for each length: whoever reads bucket=12 gets batches of 4,096 ids without padding."""
    pack(docs, tokenizer, end_id, size, ids=True).write.partitionBy("bucket").parquet(path)
