"""Shared helpers of the corpus operators: shared scratch storage, bounded Arrow batches, and fits in one task."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import pickle
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor shares: spark.checkpoint.dir; where that is unset on one machine, an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="midden-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """Write df to shared storage and read it back, so that what follows neither recomputes it nor loses it with an executor.

    instead: an earlier result of cut that nothing reads any more once this one is written; its files are deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if instead is not None:
        forget(instead)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if scopes := _scopes():
        scopes[-1].append(out)
    return out


_own = threading.local()


def _scopes() -> list[list[DataFrame]]:
    """The thread's open scratch scopes."""
    if not hasattr(_own, "scopes"):
        _own.scopes = []
    return _own.scopes


def forget(df: DataFrame) -> None:
    """Delete the files of a result of cut."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for scope in _scopes():
        scope[:] = [x for x in scope if x.written_at != df.written_at]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What cut writes inside is deleted at the end, but for results of cut handed to the function it gives; these belong to the scope around it.

    The driver's collector runs then, so that Spark also deletes the shuffle files of what nothing refers to any more.
    """
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes().append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        outer = [x for x in _scopes() if x is not own]
        _own.scopes = outer
        paths = {x.written_at for x in kept}
        for x in own:
            if x.written_at not in paths:
                forget(x)
            elif outer:
                outer[-1].append(x)
        own.clear()
        gc.collect()
        spark._jvm.System.gc()


BATCH_ROWS = 1000


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of BATCH_ROWS rows at most, as rows hold whole texts; workers give memory back when a task ends."""
    conf = rows.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return rows.mapInArrow(tidy, schema)


def release() -> None:
    """Give freed memory back to the system, as idle workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_one_task(rows: DataFrame, make: Callable[[pa.Table], Any]) -> Any:
    """make(rows as an Arrow table), called in one executor task; only what it returns comes to the driver.

    For fits on samples that the caller has bounded. A lost executor's task runs again, so make has to sort the rows itself.
    """
    kinds = rows.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), kinds)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(table))], pa.binary())], ["made"])

    made = map_arrow(rows.repartition(1), run, "made binary").collect()
    return pickle.loads(bytes(made[0]["made"])) if made else make(kinds.empty_table())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is held out of training."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def texts_of(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and the text under the name text, null as empty."""
    return df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about limit bytes, or one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(col), 0), pa.int64())).to_numpy(zero_copy_only=False)
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(ends.searchsorted(done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin, done = end, int(ends[end - 1])


def single_threaded() -> None:
    """Tokenizer calls stay on the task's own core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
