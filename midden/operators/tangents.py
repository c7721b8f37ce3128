"""How far contigs lie off the plane of their neighbours within a bin, and evictions by it.

Neighbours within a bin are searched for exactly. Rows are dealt by bin, so many to a task whatever their number, and a task holds a batch of them and one
bin; a bin over BIN_ROWS is searched by pairs of blocks instead, where a task holds a batch of contigs with their few neighbours' vectors.

Cases: vectors without a finite component throughout take no part, nor do bins under five contigs; neighbours that are all one point span no plane, so
all of the deviation counts; ties go by contig.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quality
from .evidence import GROUPS
from .iterate import cut
from .knn import closest
from .neighbour_index import usable, within_cells
from .repair import contaminated, evicted

LEAST_CONTIGS = 5
#: Rows a task on average, and of a bin at most in one task.
ROWS, BIN_ROWS = 100_000, 4096
#: Bins up to this size are searched many at once, by so many numbers.
SMALL_BIN, WORK = 128, 1 << 21


def residuals(own: np.ndarray, near: np.ndarray, axes: int = 2) -> np.ndarray:
    """Squared deviation of each of own (n, length) from the mean of its near (n, k, length), less what lies in their `axes` leading directions."""
    mean = near.mean(axis=1)
    size, turned = np.linalg.svd(near - mean[:, None], full_matrices=False)[1:]
    axes = min(axes, near.shape[1] - 1)
    dev = own - mean
    along = np.einsum("nad,nd->na", turned[:, :axes], dev)
    along[size[:, :axes] <= 1e-9 * np.maximum(size[:, :1], 1e-30)] = 0.0
    return np.maximum((dev * dev).sum(axis=1) - (along * along).sum(axis=1), 0.0)


def _listed(x: np.ndarray, near: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The residual of each of x (n, length) off the first, next, ... counts of near's rows."""
    starts, off = np.cumsum(counts) - counts, np.zeros(len(x))
    for k in np.unique(counts):
        at = np.flatnonzero(counts == k)
        off[at] = residuals(x[at], near[starts[at][:, None] + np.arange(k)])
    return off


def _of_bin(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of one bin x (n, length) have neighbours, and their residuals."""
    ids = np.tile(np.arange(len(x)), 2)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(2 * len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.tile(x.ravel(), 2)))
    found = closest(pa.table({"id": ids, "v": vectors, "ask": np.arange(len(ids)) >= len(x)}), k)
    counts = np.bincount(found.column("i").to_numpy(), minlength=len(x))
    at = np.flatnonzero(counts)
    return at, _listed(x[at], x[found.column("j").to_numpy()], counts[at])


def _of_bins(x: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The residuals of rows x that lie bin by bin, by contig within; NaN where a row has none. Bins of one size go together, WORK numbers at a time."""
    off, starts = np.full(len(x), np.nan), np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes >= LEAST_CONTIGS]).tolist():
        k, own = max(3, min(most, n // 3)), starts[sizes == n]
        step = max(1, WORK // (n * n * x.shape[1]))
        for first in (own[i : i + step] for i in range(0, len(own), step)):
            at = first[:, None] + np.arange(n)
            if n <= SMALL_BIN:
                v = x[at]
                with np.errstate(over="ignore", invalid="ignore"):
                    d = ((v[:, :, None] - v[:, None]) ** 2).sum(axis=-1)
                finite = np.isfinite(d).all(axis=(1, 2))
                v, d, rows = v[finite], d[finite], at[finite].ravel()
                d[:, np.arange(n), np.arange(n)] = np.inf
                order = np.argsort(d, axis=2, kind="stable")[:, :, :k]
                near = v[np.arange(len(v))[:, None, None], order]
                off[rows] = residuals(x[rows], near.reshape(-1, k, x.shape[1]))
                at = at[~finite]
            for rows in at:
                have, found = _of_bin(x[rows], k)
                off[rows[have]] = found
    return off


def off_plane(vectors: DataFrame, most: int = 10, bin_: str = "bin", contig: str = "contig", vector: str = "v") -> DataFrame:
    """(bin, contig, off): the residual off the plane of a contig's neighbours in its bin: a third of the bin, at least three, at most `most`.

    A contig is in one bin. Rows are dealt by bin once, ROWS a task, and a task goes through its bins in order; bins over BIN_ROWS are searched by pairs of blocks.
    """
    own = usable(vectors, contig, vector, bin_).withColumnRenamed("own", "cell").where("cell IS NOT NULL")
    crowded = cut(own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > BIN_ROWS) & (F.col("n") >= LEAST_CONTIGS)))
    some = crowded.count()
    kind = own.schema["cell"].dataType.simpleString()
    schema = f"`{bin_}` {kind}, `{contig}` long, off double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rest = [bin_, contig, "off"], None

        def done(rows: pa.Table) -> pa.RecordBatch:
            cell, id_, v = (rows.column(c).combine_chunks() for c in ("cell", "id", "v"))
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            edges = np.concatenate(([0], _changes(cell), [len(cell)]))
            off = _of_bins(x, np.diff(edges), most)
            at = pa.array(np.flatnonzero(~np.isnan(off)))
            return pa.RecordBatch.from_arrays([cell.take(at), id_.take(at), pa.array(off[at.to_numpy()])], names)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            changes = _changes(rows.column("cell").combine_chunks())
            whole = int(changes[-1]) if len(changes) else 0
            if whole:
                yield done(rows.slice(0, whole))
            rest = rows.slice(whole).combine_chunks()
        if rest is not None and rest.num_rows:
            yield done(rest)

    rest = own.join(_few(crowded.select("cell"), some), "cell", "left_anti") if some else own
    dealt = rest.select("cell", "id", "v").repartition(1 + own.count() // ROWS, "cell").sortWithinPartitions("cell", "id")
    out = dealt.mapInArrow(run, schema)
    return out.unionAll(_by_blocks(own.join(_few(crowded, some), "cell"), most, schema)) if some else out


def _few(bins: DataFrame, number: int) -> DataFrame:
    return F.broadcast(bins) if number <= GROUPS else bins


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before."""
    return 1 + np.flatnonzero(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False))


def _by_blocks(rows: DataFrame, most: int, schema: str) -> DataFrame:
    """off_plane of crowded bins' rows (cell, id, v, n)."""
    rows = rows.withColumn("k", F.greatest(F.lit(3), F.least(F.lit(most), F.floor(F.col("n") / 3))))
    base = rows.select("id", "v", "cell")
    ranked = within_cells(base, base, most, others=True).withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= most)
    lists = ranked.join(base.select(F.col("id").alias("j"), F.col("v").alias("near")), "j").groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "near"))).alias("near"))  # `most` at most
    each = rows.join(lists, "id").select("cell", "id", "v", F.flatten(F.transform(F.slice("near", F.lit(1), F.col("k").cast("int")), lambda s: s.near)).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                counts = np.diff(batch.column("near").offsets.to_numpy()) // x.shape[1]
                off = _listed(x, batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(-1, x.shape[1]), counts)
                yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("id"), pa.array(off)], [c.name for c in kinds])

    kinds = each.sparkSession.createDataFrame([], schema).schema
    return each.mapInArrow(run, schema)


def evict_off_plane(hits: DataFrame, sets: DataFrame, vectors: DataFrame, over: float = 5.5, clean: float = 5.0, most: int = 10, tasks: int | None = None) -> DataFrame:
    """(bin, contig): of every contaminated bin the contigs farthest off their neighbours' plane, sole carriers passed over, up to the first that cleans it; a third of the bin at most.

    hits: (bin, contig, marker); sets: (set_id, marker); vectors: (bin, contig, v). What cleans it also costs at most five points of completeness.
    """
    now = cut(contaminated(hits, sets, over))
    off = off_plane(vectors.join(now.select("bin"), "bin", "left_semi"), most)
    off = cut(off.withColumn("off", F.round("off", 6)))
    limit = off.groupBy("bin").agg(F.floor(F.count(F.lit(1)) / 3).alias("most"))
    rows = off.join(quality.sole_carriers(hits), ["bin", "contig"], "left_anti")
    order = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("off"), "contig"))).join(limit, "bin").where(F.col("rank") <= F.col("most"))
    return evicted(order.select("bin", "contig", "rank"), hits, sets, now, False, clean, tasks=tasks)
