"""Exact k nearest neighbours: queries are dealt to tasks, the base comes by blocks, each pair of blocks keeps its best k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: Rows of a block where there are more than LEAST_BLOCKS of them: every row is sent once a block, so fewer blocks are less to send.
LARGE_BLOCK_ROWS, LEAST_BLOCKS = 16384, 6


def nearest(q: np.ndarray, qi: np.ndarray, p: np.ndarray, pi: np.ndarray, k: int, others: bool = True, want: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): of the rows p, whose ids are pi, the k nearest to each of q, ties by j; with others, rows of its own id are left out, with want (q x p), those that it doesn't hold."""
    square, near_ = (p * p).sum(axis=1), min(k, len(p))
    by_id = np.argsort(pi, kind="stable")
    first, end = (np.searchsorted(pi, qi, side, sorter=by_id) for side in ("left", "right"))
    groups = min(len(p), max(256, 8 * near_))
    out = []
    for at in range(0, len(q) if near_ else 0, 256):
        part = q[at : at + 256]
        # Products, less what is the same for all of an ask, find all that can be among the k nearest; these alone are measured exactly.
        rough = part @ p.T
        rough *= -2.0
        rough += square
        if want is not None:
            rough[~want[at : at + 256]] = np.inf
        if others:
            for row, (lo, hi) in enumerate(zip(first[at : at + 256], end[at : at + 256], strict=True)):
                rough[row, by_id[lo:hi]] = np.inf
        slack = 1e-9 * ((part * part).sum(axis=1) + square.max())
        # The k-th least of groups' minima is no less than the k-th least of all, and much sooner found.
        least = rough[:, : len(p) // groups * groups].reshape(len(part), -1, groups).min(axis=1)
        rows, cols = np.nonzero(rough <= (np.partition(least, near_ - 1, axis=1)[:, near_ - 1] + slack)[:, None])
        keep = np.isfinite(rough[rows, cols])
        rows, cols = rows[keep], cols[keep]
        exact = ((part[rows] - p[cols]) ** 2).sum(axis=1)
        order = np.lexsort((pi[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        own = place < k
        out.append((qi[at : at + 256][rows[own]], pi[cols[own]], exact[own]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0),) * 3


def as_pairs(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"i": pa.array(i.astype(np.int64)), "j": pa.array(j.astype(np.int64)), "d": pa.array(d.astype(np.float64))})


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    col = column.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def closest(table: pa.Table, k: int, others: bool = True) -> pa.Table:
    """(i, j, d): of the rows (id, v, ask) the k that aren't asks nearest to each ask, ties by j; with others, rows of the ask's own id are left out."""
    ask = table.column("ask").to_numpy(zero_copy_only=False)
    ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
    return as_pairs(*nearest(x[ask], ids[ask], x[~ask], ids[~ask], k, others))


def knn(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(i, j, d, rank): squared distances to the k nearest others, ties by j.

    Rows are dealt to b blocks of about BLOCK_ROWS, or LARGE_BLOCK_ROWS if these are many, by hash. Every block meets every block in one
    grouped task, which passes on k rows a query, and a window ranks these; memory of a task is two blocks.
    """
    n = vectors.count()
    blocks = max(1, min(-(-n // BLOCK_ROWS), max(LEAST_BLOCKS, -(-n // LARGE_BLOCK_ROWS))))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    asks = rows.select("id", "v", F.lit(True).alias("ask"), F.col("block").alias("a"), F.explode(others).alias("b"))
    base = rows.select("id", "v", F.lit(False).alias("ask"), F.explode(others).alias("a"), F.col("block").alias("b"))

    near = asks.unionAll(base).groupBy("a", "b").applyInArrow(lambda table: closest(table, k), "i long, j long, d double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
