"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt to tasks by ranges of their id, sorted, tokenized and written, one file
a task, so that files, stripes and row groups hold ascending disjoint id ranges. ORC encodes
the ids by its second run-length scheme. A reader gets a stripe a split, and a filter
on the id skips files, stripes and row groups by their minimum, maximum and Bloom filter.

Cases: a null or empty text has the end id only; repeated keys are all kept, in any order
among themselves; an empty table gives a readable folder without rows; other columns of
the input don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import map_arrow, new_path, slices, texts_of

SCHEMA = "doc_id long, n_tokens int, ids array<int>"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, word_ends: bool = False, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> str:
    """Write doc_id, n_tokens and ids (with end_id) in ascending doc_id order; stripe_bytes and index_rows are ORC's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            flat, ends = tokens.encoder(tokenizer, word_ends).encode(batch.column("text"))
            offsets = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
            sizes = np.diff(offsets).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.insert(flat, ends, end_id).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), ids], ["doc_id", "n_tokens", "ids"])

    ordered = texts_of(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        map_arrow(ordered, run, SCHEMA)
        .write.option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .option("orc.encoding.strategy", "COMPRESSION")
        .option("compression", "zstd")
        .orc(folder)
    )
    return folder


def read(spark: SparkSession, folder: str, ids: list[int] | None = None) -> DataFrame:
    """The rows; with ids, those documents only, by ORC's metadata."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    return rows if ids is None else rows.where(F.col("doc_id").isin(ids))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before.

    A window holds one file's rows; the files' totals, a row a file, are summed first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ids")
            flat, offsets = np.asarray(col.values).astype("<u4"), col.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "n_tokens", "ids_crc32"])

    named = read(spark, folder).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"))
    rows = map_arrow(named, run, "doc_id long, file string, n_tokens long, ids_crc32 long")
    within = Window.partitionBy("file").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    files = read(spark, folder).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy("least", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to a new folder of the shared storage and give the summary of what was stored."""
    spark = docs.sparkSession
    return summary(spark, write(docs, new_path(spark, "token-orc"), tokenizer, end_id))
