"""Residuals off neighbours' planes against plain numpy, and evictions of planted contaminants."""

from __future__ import annotations

import numpy as np
import pytest

from midden.operators import neighbour_index, tangents


def plain(x, most=10):
    n = len(x)
    out = []
    for i in range(n):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = x[np.lexsort((np.arange(n), d))[: max(3, min(most, n // 3))]]
        mean = near.mean(axis=0)
        values, axes = np.linalg.eigh((near - mean).T @ (near - mean))
        top = axes[:, np.argsort(values)[::-1][:2]]
        dev = x[i] - mean
        out.append(dev @ dev - ((top.T @ dev) ** 2).sum())
    return np.array(out)


def frame(spark, bins):
    rows = [(b, 1000 * b + i, v.tolist()) for b, x in bins.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "bin int, contig long, v array<double>")


@pytest.mark.parametrize("blocks", [4096, 8])
def test_residuals_equal_plain_numpy(spark, monkeypatch, blocks):
    monkeypatch.setattr(neighbour_index, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(5)
    bins = {1: rng.normal(size=(40, 6)), 2: rng.normal(size=(9, 6)), 3: rng.normal(size=(5, 6)), 4: rng.normal(size=(4, 6))}
    got = {r["contig"]: r["off"] for r in tangents.off_plane(frame(spark, bins)).collect()}
    want = {1000 * b + i: v for b, x in bins.items() if len(x) >= 5 for i, v in enumerate(plain(x))}
    assert got.keys() == want.keys()
    assert max(abs(got[c] - want[c]) for c in want) < 1e-8


def test_odd_rows(spark):
    same = frame(spark, {1: np.ones((6, 3))})
    odd = spark.createDataFrame([(1, 7, [4.0, 1.0, 1.0]), (1, 8, None), (1, 9, [float("nan"), 0.0, 0.0]), (1, None, [1.0, 1.0, 1.0])], same.schema)
    got = {r["contig"]: round(r["off"], 9) for r in tangents.off_plane(same.unionAll(odd)).collect()}
    assert got == {1000 + i: 0.0 for i in range(6)} | {7: 9.0}
    assert tangents.off_plane(same.where("bin < 0")).count() == 0


def test_planted_contaminants_go(spark):
    """A flat bin with two contigs high above its plane that repeat its markers, and a clean bin; each contig carries one marker."""
    rng = np.random.default_rng(9)
    flat = np.c_[rng.normal(size=(20, 2)), np.zeros((20, 2))]
    flat[18:, 2:] = [[6.0, 0.0], [0.0, 7.0]]
    hits = [(1, 1000 + i, i % 18) for i in range(20)] + [(2, 2000 + i, i) for i in range(18)]
    rows = frame(spark, {1: flat, 2: rng.normal(size=(18, 4))})
    sets = spark.createDataFrame([(m, m) for m in range(18)], "set_id int, marker int")
    out = tangents.evict_off_plane(spark.createDataFrame(hits, "bin int, contig long, marker int"), sets, rows)
    assert {tuple(r) for r in out.collect()} == {(1, 1018), (1, 1019)}
