"""Hard negatives for contrastive training, read from each anchor's rows in the full order of their scores.

A score is the inner product of two vectors whose components were rounded down to integers. For each
anchor all rows of a slice are scored, ordered by score and id, and read: the first rows of the
anchor's label are its positives; for each positive, a binary search finds where scores no longer exceed its own,
and the first rows of other labels from there on that aren't below the lower limit are its negatives.
Slices' lists are merged by Spark, so no task and no driver holds an anchor's whole order.

Anchors go to the rows: blocks of them, bounded by BLOCK_ANCHORS rows and BLOCK_BYTES, are broadcast one after
the other, and each pass reads the rows where they lie. Rows are never shuffled or copied.

Cases: rows with a null id, label or vector, or with a component that is null, infinite or not a number, take no part; a
vector that is shorter than another counts as continued by zeros, so an empty one scores 0. Rows are told
apart by id, label and vector: a repeated row counts once, and rows of one id and one label that score alike
count once. A row with the anchor's id is never its positive. An anchor without positives, and a positive without
negatives, give no rows, as does an empty table. Scores beyond 64 bits count as the nearest 64-bit number. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

#: Most anchors in a broadcast block (on average: they are dealt by hash), and most bytes of their components.
BLOCK_ANCHORS, BLOCK_BYTES = 8192, 32 << 20
#: Rows that are ordered at once, and most components among them.
SLICE_ROWS, SLICE_CELLS = 8192, 4 << 20
#: Anchors whose scores stand in memory at once.
TILE = 128
MOST = (1 << 63) - 1


class Rows:
    """ids, labels and integer components (a matrix of doubles that hold integers) of the rows that take part."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, scale: int):
        ok = pc.and_(pc.and_(pc.is_valid(batch.column("id")), pc.is_valid(batch.column("label"))), pc.is_valid(batch.column("vector")))
        batch = batch.filter(ok)
        lists = batch.column("vector")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.cast(pc.list_flatten(lists), pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
        own = np.repeat(np.arange(len(size)), size)
        good = np.ones(len(size), bool)
        good[own[~np.isfinite(flat)]] = False
        matrix = np.zeros((len(size), int(size.max(initial=0))))
        with np.errstate(invalid="ignore", over="ignore"):
            matrix[own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * flat)
        self.matrix = np.where(good[:, None], matrix, 0)[good]
        self.ids = batch.column("id").to_numpy()[good].astype(np.int64)
        self.labels = batch.column("label").to_numpy()[good].astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of a's rows with b's, as 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if top < 2.0**53:  # every partial sum is a double
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = (whole(a) if a.size else a.astype(object)) @ (whole(b) if b.size else b.astype(object)).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[Rows]:
    """The rows, gathered from small batches and parted where they are long."""
    held: list[pa.RecordBatch] = []
    rows = cells = 0
    for batch in batches:
        per_row = max(1, pc.sum(pc.fill_null(pc.list_value_length(batch.column("vector")), 0)).as_py() or 0) // max(1, batch.num_rows) + 1
        step = max(1, min(SLICE_ROWS, SLICE_CELLS // per_row))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            held.append(part)
            rows, cells = rows + part.num_rows, cells + part.num_rows * per_row
            if rows >= SLICE_ROWS or cells >= SLICE_CELLS:
                yield Rows(pa.Table.from_batches(held), scale)
                held, rows, cells = [], 0, 0
    if held:
        yield Rows(pa.Table.from_batches(held), scale)


def _ordered(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, then rising id."""
    return np.lexsort((ids, -score))


def _once(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of ordered entries don't repeat the one before."""
    keep = np.ones(len(ids), bool)
    keep[1:] = (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
    return keep


def _merged(score: np.ndarray, ids: np.ndarray, more_score: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of two short lists together."""
    score, ids = np.concatenate((score, more_score)), np.concatenate((ids, more_ids))
    at = _ordered(score, ids)
    at = at[_once(score[at], ids[at])][:k]
    return score[at], ids[at]


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def first_positives(anchors: Rows, slices: Iterator[Rows], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor scores and ids of its first k rows of the same label among the slices'."""
    found = [NONE] * len(anchors.ids)
    for rows in slices:
        for tile in range(0, len(anchors.ids), TILE):
            block = scores(anchors.matrix[tile : tile + TILE], rows.matrix)
            for i, score in enumerate(block, tile):
                order = _ordered(score, rows.ids)
                order = order[(rows.labels[order] == anchors.labels[i]) & (rows.ids[order] != anchors.ids[i])]
                s, ids = score[order], rows.ids[order]
                keep = np.flatnonzero(_once(s, ids))[:k]
                found[i] = _merged(*found[i], s[keep], ids[keep], k)
    return found


def first_negatives(anchors: Rows, limits: list[list[int]], slices: Iterator[Rows], k: int, low: int, high: int, unit: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By anchor and positive scores and ids of the first k rows of other labels whose unit-fold score is within low and high times the positive's."""
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for rows in slices:
        for tile in range(0, len(anchors.ids), TILE):
            block = scores(anchors.matrix[tile : tile + TILE], rows.matrix)
            for i, score in enumerate(block, tile):
                if not limits[i]:
                    continue
                order = _ordered(score, rows.ids)
                order = order[rows.labels[order] != anchors.labels[i]]
                s, ids = score[order], rows.ids[order]
                keep = _once(s, ids)
                s, ids = s[keep], ids[keep]
                for p, limit in enumerate(limits[i]):
                    top, bottom = high * limit // unit, -(-low * limit // unit)  # the largest and smallest whole score within
                    begin = int(np.searchsorted(-s, -top, side="left")) if abs(top) <= MOST else (0 if top > 0 else len(s))
                    stop = int(np.searchsorted(-s, -bottom, side="right")) if abs(bottom) <= MOST else (len(s) if bottom < 0 else 0)
                    stop = min(stop, begin + k)
                    if begin < stop:
                        found[i, p] = _merged(*found.get((i, p), NONE), s[begin:stop], ids[begin:stop], k)
    return found


def _listed(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key's merged lists, repeated entries once; rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    again = (F.lag("score").over(order) == F.col("score")) & (F.lag("id").over(order) == F.col("id"))
    return df.withColumn("again", F.coalesce(again, F.lit(False))).filter("NOT again").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, unit: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which anchor holds.

    Components are multiplied by scale before they are rounded down. A negative's score lies, in units, between low and high times the positive's.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), anchor.alias("anchor"))
    plain = named.select("id", "label", "vector")
    own = named.filter("anchor").select("id", "label", "vector").filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").distinct()
    own = cut(own, "anchors")
    count, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-int(count) // BLOCK_ANCHORS), -(-int(size) * 8 // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks))
    return reduce(DataFrame.unionAll, [_of_block(spark, plain, own.filter(block == b), positives, negatives, low, high, unit, scale) for b in range(blocks)])


def _of_block(spark, plain: DataFrame, own: DataFrame, positives: int, negatives: int, low: int, high: int, unit: int, scale: int) -> DataFrame:
    """The result for one block of anchors: a pass for the positives, a pass for the negatives."""
    anchors = Rows(own.toArrow(), scale)
    sent = spark.sparkContext.broadcast(anchors)  # BLOCK_ANCHORS rows, BLOCK_BYTES

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = first_positives(sent.value, _slices(batches, scale), positives)
        at = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.concatenate([NONE[0], *(s for s, _ in found)])), pa.array(np.concatenate([NONE[1], *(i for _, i in found)]))], ["at", "score", "id"])
        release()

    first = _listed(plain.mapInArrow(same, "at long, score long, id long"), ["at"], positives).orderBy("at", "rank").collect()  # a block's anchors x positives
    ids: list[list[int]] = [[] for _ in anchors.ids]
    limits: list[list[int]] = [[] for _ in anchors.ids]
    for r in first:
        ids[r["at"]].append(r["id"])
        limits[r["at"]].append(r["score"])
    known = spark.sparkContext.broadcast((ids, limits))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (own_ids, own_limits) = sent.value, known.value
        found = first_negatives(own, own_limits, _slices(batches, scale), negatives, low, high, unit)
        columns: list[list[np.ndarray]] = [[NONE[0]] for _ in range(7)]
        for (i, p), (s, found_ids) in found.items():
            for c, v in zip(columns, (i, p, own.ids[i], own_ids[i][p], own_limits[i][p]), strict=False):
                c.append(np.full(len(s), v, np.int64))
            columns[5].append(s)
            columns[6].append(found_ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["at", "place", "anchor_id", "positive_id", "positive_score", "score", "id"])
        release()

    lists = plain.mapInArrow(other, "at long, place long, anchor_id long, positive_id long, positive_score long, score long, id long")
    out = _listed(lists, ["at", "place"], negatives)
    return cut(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
