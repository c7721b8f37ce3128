"""A neighbour index of coarse centres: vectors lie in the cell of their nearest centre, a query looks into the cells of a few.

Equal vectors are searched for once, whatever their number. Small cells are searched together, so that a query comes once to all of those it looks into
there and brings k pairs back; a crowded one is parted, so it is many tasks. How many cells a query has to look into is measured against all rows (`probes_for`); with exact=True it also looks into every cell
that the bounds can't rule out, and the result is that of `knn.knn`.

Cases: rows whose vector is null, empty, or has a null or non-finite component take no part; ids are unique and vectors of one length; with fewer than k others all
of them come; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut, forget
from .knn import BLOCK_ROWS, as_pairs, closest, matrix, nearest

#: Cells at most: their centres are sent to every task.
MOST_CELLS = 4096
#: Vectors a cell that centres are fitted on: with 4,096 cells 65,536 of them are in the driver.
SAMPLE = 16


@dataclass(frozen=True)
class Index:
    """centres: (cells, length); rows: (id, key, v, cell, off), off the distance to the centre; heads: (key, id, v, cell, members), a row for each distinct vector, members its k least ids.

    first and parts: a cell's heads lie in the groups from its first on, in as many as it has parts.
    """

    centres: np.ndarray
    rows: DataFrame
    heads: DataFrame
    k: int
    first: np.ndarray
    parts: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a row a vector."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * (x @ centres.T), 0.0)


def _pieces(x: np.ndarray, rows: int = 1024) -> Iterator[np.ndarray]:
    return (x[at : at + rows] for at in range(0, len(x), rows))


def usable(vectors: DataFrame, key: str, vector: str, own: str | None = None) -> DataFrame:
    """(id, v) of the rows that take part, with the column own as own."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(key).cast("long").alias("id"), v.alias("v"), *([F.col(own).alias("own")] if own else []))


def fitted_centres(rows: DataFrame, cells: int, n: int, rounds: int = 8) -> np.ndarray:
    """Means by Lloyd's rounds on at most SAMPLE vectors a cell of the n rows (id, v), those drawn by a hash of the id."""
    wanted = SAMPLE * cells
    drawn = rows.withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(max(n, 1))) < 2 * wanted).orderBy("h", "id").limit(wanted)
    table = drawn.select("v").toArrow()  # bounded by SAMPLE * cells, 8 bytes a component
    if not table.num_rows:
        return np.empty((0, 0))
    x = _matrix(table.column("v").combine_chunks())
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(1).permutation(len(centres))[:cells]]
    for _ in range(rounds):
        near = np.concatenate([_to_centres(part, centres).argmin(axis=1) for part in _pieces(x)])
        size = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.flatnonzero(size))
        new = centres.copy()
        new[size > 0] = np.add.reduceat(x[order], starts, axis=0) / size[size > 0][:, None]
        if np.abs(new - centres).max() < 1e-9:
            break
        centres = new
    return centres


def _dealt(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, key, v, cell, off): key is the digest of a vector, equal for equal ones (0 and -0 too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v")) + 0.0
                d = [_to_centres(part, centres) for part in _pieces(x)]
                cell, off = np.concatenate([p.argmin(axis=1) for p in d]), np.sqrt(np.concatenate([p.min(axis=1) for p in d]))
                keys = [hashlib.sha256(row.tobytes()).digest() for row in x]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(off)], ["id", "key", "v", "cell", "off"])

    return rows.mapInArrow(run, "id long, key binary, v array<double>, cell int, off double")


def _heads(rows: DataFrame, k: int) -> DataFrame:
    """(key, id, v, cell, members) of each distinct vector; members are its k least ids, which each task cuts to before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    least = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    own = F.when(F.col("rank") == 1, F.struct("id", "v", "cell"))
    by = least.groupBy("key").agg(F.max(own).alias("h"), F.sort_array(F.collect_list("id")).alias("members"))
    return by.select("key", "h.id", "h.v", "h.cell", "members")


def build(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> Index:
    """An index for up to k neighbours; by default of as many cells as the root of the number of rows, at most MOST_CELLS."""
    rows = usable(vectors, key, vector)
    n = rows.count()
    centres = fitted_centres(rows, min(cells or max(1, round(n**0.5)), MOST_CELLS), n)
    dealt = cut(_dealt(rows, centres))
    heads = cut(_heads(dealt, k + 1))
    return Index(centres, dealt, heads, k, *_groups(heads, len(centres)))


def _groups(heads: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) of Index: cells share a group up to 2 BLOCK_ROWS heads, larger ones have several of their own."""
    size, held = np.zeros(cells, np.int64), 2 * BLOCK_ROWS
    for r in heads.groupBy("cell").count().collect():  # a row a cell
        size[r["cell"]] = r["count"]
    first, parts, at, filled = np.zeros(cells, np.int64), np.maximum(1, -(-size // held)), 0, 0
    for cell in range(cells):
        if filled and (filled + size[cell] > held):
            at, filled = at + 1, 0
        first[cell] = at
        at, filled = (at + int(parts[cell]), 0) if parts[cell] > 1 else (at, filled + int(size[cell]))
    return first, parts


def drop(index: Index) -> None:
    """Delete the index's tables."""
    forget(index.rows, index.heads)


def _by_group(index: Index, chosen: list[np.ndarray]) -> pa.Array:
    """For each ask its looks (group, cells), nearest cells first; chosen: for each the cells that it looks into."""
    first, parts = index.first, index.parts
    cell = np.concatenate(chosen).astype(np.int64)
    many = parts[cell]
    group = np.repeat(first[cell] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    ask, cell = np.repeat(np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]), many), np.repeat(cell, many)
    order = np.lexsort((group, ask))
    ask, group, cell = ask[order], group[order], cell[order]
    new = np.concatenate(([True], (ask[1:] != ask[:-1]) | (group[1:] != group[:-1]))) if len(ask) else np.empty(0, bool)
    cells = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(ask)).astype(np.int32)), pa.array(cell.astype(np.int32)))
    looks = pa.StructArray.from_arrays([pa.array(group[new].astype(np.int32)), cells], ["group", "cells"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ask[new], np.arange(len(chosen) + 1)).astype(np.int32)), looks)


def _looks(asks: DataFrame, choose: Callable[[np.ndarray, pa.RecordBatch], pa.Array], columns: list[str]) -> DataFrame:
    """(id, v, group, cells), a row for each group of which choose gives an ask cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), choose(_matrix(batch.column("v")), batch)], ["id", "v", "looks"])

    dealt = asks.select(*columns).mapInArrow(run, "id long, v array<double>, looks array<struct<group:int,cells:array<int>>>")
    return dealt.select("id", "v", F.explode("looks").alias("look")).select("id", "v", "look.group", "look.cells")


def closest_of_cells(table: pa.Table, k: int) -> pa.Table:
    """(i, j, d): of the rows (id, v, ask, cells) the k that aren't asks, in one of its cells, nearest to each ask, ties by j. Asks that look into one cell first go together."""
    ask = table.column("ask").to_numpy(zero_copy_only=False)
    ids, x, cells = table.column("id").to_numpy(), matrix(table.column("v")), table.column("cells").combine_chunks()
    many, flat = cells.value_lengths().to_numpy(), cells.flatten().to_numpy()
    starts = np.cumsum(many) - many
    p, pi, cell = x[~ask], ids[~ask], flat[starts[~ask]]
    rows = np.flatnonzero(ask)
    rows = rows[np.lexsort((ids[rows], flat[starts[rows]]))]
    out = [(np.empty(0),) * 3]
    for at in range(0, len(rows), 1024):
        own = rows[at : at + 1024]
        n = many[own]
        names, place = np.unique(flat[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_inverse=True)
        use = np.isin(cell, names)
        want = np.zeros((len(own), len(names)), bool)
        want[np.repeat(np.arange(len(own)), n), place] = True
        out.append(nearest(x[own], ids[own], p[use], pi[use], k, False, None if want.all() else want[:, np.searchsorted(names, cell[use])]))
    return as_pairs(*(np.concatenate(c) for c in zip(*out, strict=True)))


def within_groups(index: Index, looks: DataFrame, k: int) -> DataFrame:
    """(i, j, d): of each look (id, v, group, cells) the k nearest of the group's heads in these cells; a task has a group and 2 BLOCK_ROWS of its looks."""
    spark = looks.sparkSession
    places = spark.createDataFrame([(c, int(g), int(n)) for c, (g, n) in enumerate(zip(index.first, index.parts, strict=True))], "cell int, first int, parts int")  # a row a cell
    blocks = looks.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK_ROWS)).cast("int").alias("blocks"))
    base = index.heads.join(F.broadcast(places), "cell").select("id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts"))).cast("int").alias("group"))
    asks = looks.join(blocks, "group").select("id", "v", F.lit(True).alias("ask"), "cells", "group", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("a"))
    rows = base.join(blocks, "group").select("id", "v", F.lit(False).alias("ask"), F.array("cell").alias("cells"), "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"))
    return asks.unionAll(rows).groupBy("group", "a").applyInArrow(lambda table: closest_of_cells(table, k), "i long, j long, d double")


def within_cells(base: DataFrame, looks: DataFrame, k: int, others: bool = False) -> DataFrame:
    """(i, j, d): of each look (id, v, cell) the k nearest of base (id, v, cell) in that cell; a task has two blocks of about BLOCK_ROWS.

    Cells may be any groups; their counts are joined, a row a cell. With others, rows of the look's own id are left out.
    """
    count = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    blocks = count(base, "nb").join(count(looks, "na"), "cell")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = looks.join(blocks, "cell").select("id", "v", F.lit(True).alias("ask"), "cell", block("na").alias("a"), each("nb").alias("b"))
    rows = base.join(blocks, "cell").select("id", "v", F.lit(False).alias("ask"), "cell", each("na").alias("a"), block("nb").alias("b"))
    return asks.unionAll(rows).groupBy("cell", "a", "b").applyInArrow(lambda table: closest(table, k, others), "i long, j long, d double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def _missed(index: Index, asks: DataFrame, found: DataFrame, probes: int) -> DataFrame:
    """(id, v, group, cells): the cells beyond the first `probes` that may hold something as near as the farthest that was found.

    A cell's vectors are no nearer than its centre less its radius, nor than the plane that parts it from the ask's nearest centre.
    """
    centres, m = index.centres, index.k + 1
    far = index.rows.groupBy("cell").agg(F.max("off").alias("r")).collect()  # a row a cell
    places = replace(index, rows=None, heads=None)  # what tasks need
    radius = np.full(len(centres), -np.inf)
    radius[[r["cell"] for r in far]] = [r["r"] for r in far]
    bound = found.groupBy("i").agg(F.when(F.count(F.lit(1)) >= m, F.max("d")).alias("bound"))

    def choose(x: np.ndarray, batch: pa.RecordBatch) -> pa.Array:
        limit = np.sqrt(np.where(np.isnan(b := batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)), np.inf, b))
        out = []
        for at in range(0, len(x), 1024):
            d2 = _to_centres(x[at : at + 1024], centres)
            order = np.argsort(d2, axis=1, kind="stable")
            first, rows = order[:, 0], np.arange(len(d2))
            with np.errstate(divide="ignore", invalid="ignore"):
                gaps = np.sqrt(_to_centres(centres[first], centres))  # of these rows' centres only: a square of all cells isn't sent
                plane = np.nan_to_num((d2 - d2[rows, first][:, None]) / (2 * gaps), nan=0.0, posinf=0.0)
            least = np.maximum(np.sqrt(d2) - radius[None], plane)
            slack = 1e-6 * (1.0 + np.sqrt(d2.max(axis=1)))
            open_ = least <= (limit[at : at + 1024] + slack)[:, None]
            open_[rows[:, None], order[:, :probes]] = False
            out += [np.flatnonzero(o) for o in open_]
        return _by_group(places, out)

    return _looks(asks.join(bound.withColumnRenamed("i", "id"), "id", "left"), choose, ["id", "v", "bound"])


def _first(index: Index, asks: DataFrame, probes: int) -> DataFrame:
    places = replace(index, rows=None, heads=None)  # what tasks need
    return _looks(asks, lambda x, _: _by_group(places, [o for part in _pieces(x) for o in np.argsort(_to_centres(part, places.centres), axis=1, kind="stable")[:, :probes]]), ["id", "v"])


def neighbours(index: Index, k: int, probes: int, points: DataFrame | None = None, exact: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(i, j, d, rank): squared distances to the k nearest of the index, ties by j, for each of its rows, or each of the points (key, vector).

    A point isn't a neighbour of the row that has its id. k is at most the index's.
    """
    if k > index.k:
        raise ValueError(f"the index is built for up to {index.k} neighbours")
    spark, m = index.rows.sparkSession, index.k + 1
    if not len(index.centres):
        return spark.createDataFrame([], "i long, j long, d double, rank int")
    rows = index.rows if points is None else cut(_dealt(usable(points, key, vector), index.centres))
    asks = index.heads if points is None else cut(_heads(rows, 1))
    near = within_groups(index, _first(index, asks, probes), m)
    if exact and probes < len(index.centres):
        found = cut(_best(near, m).select("i", "j", "d"))
        near = found.unionAll(within_groups(index, _missed(index, asks, found, probes), m))
    # Distinct vectors become their members: the first k + 1, as one may be the row itself.
    each = _best(near, m).join(index.heads.select(F.col("id").alias("j"), "members"), "j").select("i", F.explode("members").alias("j"), "d")
    lists = _best(each, m).groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("near"))
    by_key = asks.select("key", "id").join(lists, "id").select("key", "near")
    own = rows.select("id", "key").join(by_key, "key").select(F.col("id").alias("i"), F.slice(F.filter("near", lambda s: s.j != F.col("id")), 1, k).alias("near"))
    return own.select("i", F.posexplode("near").alias("at", "s")).select("i", "s.j", "s.d", (F.col("at") + 1).alias("rank"))


def recall_by_probes(index: Index, asks: int = 256) -> list[float]:
    """The share of the nearest k + 1 distinct vectors that the first 1, 2, ... cells hold, for `asks` vectors drawn by hash, against all rows."""
    drawn = cut(index.heads.orderBy(F.xxhash64("id"), "id").limit(asks).select("id", "v"))
    cells = len(index.centres)
    looks = cut(_first(index, drawn, cells))
    true = _best(within_groups(index, looks, index.k + 1), index.k + 1)
    home = true.join(index.heads.select(F.col("id").alias("j"), "cell"), "j").groupBy("i", "cell").count().collect()  # at most asks * (k + 1) rows
    at = {r["id"]: np.argsort(_to_centres(np.array([r["v"]]), index.centres)[0], kind="stable") for r in drawn.collect()}
    hits = np.zeros(cells)
    for r in home:
        hits[np.flatnonzero(at[r["i"]] == r["cell"])[0]] += r["count"]
    forget(drawn, looks)
    return (np.cumsum(hits) / max(hits.sum(), 1)).tolist()


def probes_for(index: Index, recall: float = 0.95, asks: int = 256) -> int:
    """The least number of cells that finds this share of neighbours, as measured by recall_by_probes."""
    return next((i + 1 for i, r in enumerate(recall_by_probes(index, asks)) if r >= recall), max(1, len(index.centres)))
