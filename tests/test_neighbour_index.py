"""The neighbour index against the exact search and brute force: equal results where exact, recall where not, copies, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL

from midden.operators import knn, neighbour_index
from midden.plans import slate


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def brute(x, ids, k):
    out = set()
    for i, v in zip(ids, x, strict=True):
        d = ((v - x) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out |= {(int(i), int(ids[j]), round(float(d[j]), 9), r + 1) for r, j in enumerate(order)}
    return out


def found(df):
    return {(r["i"], r["j"], round(r["d"], 9), r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def clouds():
    """600 vectors in 12 clouds, 150 of them one and the same, 60 in pairs."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(0, 6, (12, 8)), 50, axis=0) + rng.normal(0, 1, (600, 8))
    x[::4] = x[0]
    x[1:121:4] = x[2:122:4]
    return x, rng.permutation(5000)[:600]


def test_exact_equals_brute_force_with_copies(spark, clouds):
    x, ids = clouds
    index = neighbour_index.build(frame(spark, x, ids), 7, cells=12)
    assert found(neighbour_index.neighbours(index, 7, 1, exact=True)) == brute(x, ids, 7)
    assert found(neighbour_index.neighbours(index, 3, len(index.centres))) == brute(x, ids, 3)
    neighbour_index.drop(index)


def test_small_blocks_split_crowded_cells(spark, clouds, monkeypatch):
    x, ids = clouds
    monkeypatch.setattr(neighbour_index, "BLOCK_ROWS", 16)
    index = neighbour_index.build(frame(spark, x, ids), 5, cells=3)
    assert found(neighbour_index.neighbours(index, 5, 2, exact=True)) == brute(x, ids, 5)


def test_measured_probes_reach_the_recall(spark, clouds):
    x, ids = clouds
    index = neighbour_index.build(frame(spark, x, ids), 10, cells=12)
    probes = neighbour_index.probes_for(index, 0.95)
    assert probes < 6
    got, true = found(neighbour_index.neighbours(index, 10, probes)), brute(x, ids, 10)
    assert len({g[:2] for g in got} & {t[:2] for t in true}) >= 0.9 * len(true)


def test_recall_on_embeddings(spark):
    """Nearly all distances there are alike, so many cells are looked into; the share found is measured all the same."""
    rows = slate.vectors(spark, SMALL)
    index = neighbour_index.build(rows, 10)
    got = {(r["i"], r["j"]) for r in neighbour_index.neighbours(index, 10, neighbour_index.probes_for(index, 0.95)).collect()}
    true = {(r["i"], r["j"]) for r in knn.knn(rows, 10).collect()}
    assert len(got & true) >= 0.9 * len(true) == 0.9 * 5000


def test_points(spark, clouds):
    x, ids = clouds
    index = neighbour_index.build(frame(spark, x, ids), 4, cells=8)
    points = frame(spark, [x[0], x[5] + 0.25, x[5] + 0.25], [int(ids[0]), 90001, 90002])
    out = found(neighbour_index.neighbours(index, 4, 1, points, exact=True))
    assert {o for o in out if o[0] == ids[0]} == {b for b in brute(x, ids, 4) if b[0] == ids[0]}
    d = ((x[5] + 0.25 - x) ** 2).sum(axis=1)
    order = np.lexsort((ids, d))[:4]
    assert {o[1:] for o in out if o[0] == 90001} == {o[1:] for o in out if o[0] == 90002} == {(int(ids[j]), round(float(d[j]), 9), r + 1) for r, j in enumerate(order)}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 0.0]), (4, [None, 1.0]), (5, [-0.0, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<double>")
    index = neighbour_index.build(rows, 5)
    assert found(neighbour_index.neighbours(index, 5, 1, exact=True)) == {(1, 5, 0.0, 1), (1, 7, 4.0, 2), (5, 1, 0.0, 1), (5, 7, 4.0, 2), (7, 1, 4.0, 1), (7, 5, 4.0, 2)}
    none = neighbour_index.build(rows.where("vec_id < 0"), 5)
    assert neighbour_index.neighbours(none, 5, 1).count() == 0
    with pytest.raises(ValueError):
        neighbour_index.neighbours(index, 6, 1)


def test_a_query_comes_once_to_cells_that_are_searched_together(spark, clouds):
    x, ids = clouds
    index = neighbour_index.build(frame(spark, x, ids), 7, cells=12)
    looks = neighbour_index._first(index, index.heads, 12)
    assert looks.count() == index.heads.count()  # not a row for each of twelve cells
    assert neighbour_index.within_groups(index, looks, 3).count() == 3 * index.heads.count()
