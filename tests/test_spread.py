"""Long work on rows of one file is dealt to many tasks."""

from __future__ import annotations

import numpy as np

from midden.functions import fractal
from midden.plans import sequences


def test_complexity_bundle_is_many_tasks(spark):
    out = sequences.complexity_bundle(spark, "/root/testdata/sf0.001")
    tasks = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(tasks) == 200 and max(tasks) <= 50


def test_fluctuation_by_pieces():
    """Windows' own lines by least squares, over the piece's borders too."""
    profile = np.cumsum(np.random.default_rng(5).normal(size=3000))
    w, total, valid = 55, 0.0, 0
    for a in range(len(profile) - w + 1):
        own = profile[a : a + w]
        r = own - np.polyval(np.polyfit(np.arange(w), own, 1), np.arange(w))
        var = (r * r).sum() / (w - 1)
        rho = ((r * r).sum() + (r[1:] * r[:-1]).sum()) / ((2 * w - 1) * var)
        star = 2 * (rho + (1 + 3 * rho) / w) * (1 - 1 / (2 * w)) * var
        total, valid = total + max(star, 0.0), valid + (star > 0)
    f, n = fractal.fluctuation(profile, w)
    assert n == valid and abs(f - (total / (w * valid)) ** 0.5) < 1e-9


def test_running_sums_give_windows_own_lines():
    rng = np.random.default_rng(5)
    rows = np.cumsum(rng.normal(size=(3, 400)), axis=1)
    rows[1, 50:300] = 1000.0  # windows without any variance far from zero
    rows[2] = 0.0
    for w in (8, 21, 89):
        f, valid = fractal.Profiles(rows).fluctuation(w)
        for row in range(3):
            parts = np.lib.stride_tricks.sliding_window_view(rows[row], w)
            squares, lag = fractal._residuals(parts, w)
            var = squares / (w - 1)
            own = var >= 1e-12
            rho = (squares[own] + lag[own]) / ((2 * w - 1) * var[own])
            star = 2 * (rho + (1 + 3 * rho) / w) * (1 - 1 / (2 * w)) * var[own]
            assert valid[row] == (star > 0).sum()
            assert np.isclose(f[row], (star[star > 0].sum() / (w * max(1, valid[row]))) ** 0.5, rtol=1e-9)
