"""Packing token pieces into sequences by patterns fitted to the length histogram.

Lengths fall into classes; patterns are multisets of at most PARTS classes that fill a
sequence. Non-negative least squares fits how often each pattern is to repeat to the
histogram; the counts are rounded down and cut to what there is. A pattern's largest places take
pieces by runs of equal length; its smallest place stays open, and the residual pieces go,
longest first, each to the tightest open sequence. All of that works on runs of equal
sequences, so the plan's size depends on the number of lengths, not of pieces.

A piece finds its place by its rank among those of its length. Ranks are counted in
hashed buckets and added up, so that no task sorts all pieces of a common length.

Cases: a null or empty text is one piece of the end id; a document of an exact multiple of the
size has full pieces only; repeated rows are packed each; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, map_arrow, slices, texts_of

PARTS = 4
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, word_ends: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the end id, cut at size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tokens.each(batch.column("text"), tokenizer, word_ends, end_id)):
                raw = ids.astype("<u4", copy=False)
                for k, a in enumerate(range(0, len(raw), size)):
                    part = raw[a : a + size]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(texts_of(docs, "doc_id"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 of least |a x - b|, by an active set: the variable of the steepest descent joins, those that turn negative leave."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-7 * max(1.0, float(np.abs(b).max())):
            break
        free[j] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return x


def patterns(classes: int, parts: int) -> list[tuple[int, ...]]:
    """Multisets of at most parts classes, largest first, that sum up to classes."""
    out = []

    def add(chosen: tuple[int, ...], rest: int, top: int) -> None:
        if rest == 0:
            out.append(chosen)
        elif len(chosen) < parts:
            least = -(-rest // (parts - len(chosen)))
            for c in range(min(top, rest), least - 1, -1):
                add((*chosen, c), rest - c, c)

    add((), classes, classes)
    return out


class Plan:
    """Places (length, first rank, count, first sequence, offset) for a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], size: int, classes: int = 64):
        self.size = size
        self.left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v}
        self.rank = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.places: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}  # space -> runs of sequences (first, count)
        self._by_patterns(classes)
        self._residual()

    def _place(self, length: int, count: int, first: int, offset: int) -> None:
        self.places.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count
        self.left[length] -= count

    def _keep_open(self, first: int, count: int, space: int) -> None:
        if space and count:
            self.open.setdefault(space, []).append((first, count))

    def _by_patterns(self, classes: int) -> None:
        width = -(-self.size // classes)
        of: dict[int, list[int]] = {}
        for length in self.left:
            of.setdefault(-(-length // width), []).append(length)
        have = np.array([sum(self.left[x] for x in of.get(c, ())) for c in range(1, classes + 1)], float)
        found = [p for p in patterns(classes, PARTS) if all(c in of for c in p[: max(1, len(p) - 1)])]
        if not found:
            return
        a = np.zeros((classes, len(found)))
        for j, p in enumerate(found):
            for c in p:
                a[c - 1, j] += 1
        x = nnls(a, have)
        for j in np.argsort(-x, kind="stable"):
            p = found[j]
            filled = p[: max(1, len(p) - 1)]  # the smallest place stays open
            need = {c: filled.count(c) for c in filled}
            times = min(int(x[j]), *(sum(self.left[y] for y in of[c]) // m for c, m in need.items()))
            if times <= 0:
                continue
            runs = [(self.sequences, times, 0)]
            self.sequences += times
            for c in filled:
                new = []
                for first, count, used in runs:
                    while count:
                        length = next(y for y in of[c] if self.left[y])
                        n = min(count, self.left[length])
                        self._place(length, n, first, used)
                        new.append((first, n, used + length))
                        first, count = first + n, count - n
                runs = new
            for first, count, used in runs:
                self._keep_open(first, count, self.size - used)

    def _residual(self) -> None:
        spaces = sorted(self.open)
        for length in list(self.left):
            while n := self.left[length]:
                at = bisect.bisect_left(spaces, length)
                if at < len(spaces):
                    space = spaces[at]
                    first, count = self.open[space].pop()
                    if count > n:
                        self.open[space].append((first + n, count - n))
                        count = n
                    if not self.open[space]:
                        del self.open[space], spaces[at]
                else:
                    space, fit = self.size, self.size // length
                    first, count = self.sequences, -(-n // fit)
                    self.sequences += count
                self._place(length, count, first, self.size - space)
                rest = space - length
                if rest and rest not in self.open:
                    bisect.insort(spaces, rest)
                self._keep_open(first, count, rest)


def place(rows: DataFrame, size: int) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    histogram = {int(r["length"]): int(r["count"]) for r in rows.groupBy("length").count().collect()}  # one row a length, `size` at most
    plan = Plan(histogram, size)
    found = np.array(sorted(plan.places), np.int64).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast(found)  # bounded by the number of lengths
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.join(counts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        keys = places[:, 0] * (1 << 44) + places[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(places[at, 3] + rank - places[at, 1]), pa.array(places[at, 4])], [*names, "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(ranked.select(*names, "rank"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096) -> DataFrame:
    """Every text's pieces with their places."""
    return place(cut(pieces(docs, tokenizer, end_id, size), "pack-pieces"), size)
