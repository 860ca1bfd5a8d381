"""Monthly series against whole matrices, and on known truth."""

import random

import numpy as np
import pytest

from kestrine.operators import inversion as V

SCHEMA = "cell int, id long, t1 double, t2 double, dt double, vx double, vy double, w double"
SINCE, N = 2015.0, 36


def truth(t):
    return 300.0 + (150.0 if t >= 2016.5 else 0.0), 100.0 - (40.0 if t >= 2016.5 else 0.0)


def mean_over(t1, t2):
    grid = np.linspace(t1, t2, 400)
    return np.mean([truth(t) for t in grid], axis=0)


def pairs(seed, cell, n, wild=0.0, lock=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        dt = rng.choice([6, 12, 24, 40, 90, 200, 500])
        t1 = rng.uniform(SINCE - 0.2, SINCE + N / 12 - 0.1)
        v = mean_over(t1, t1 + dt / 365.25) + [rng.gauss(0, 3), rng.gauss(0, 3)]
        if lock and dt > lock:
            v = v * 0.3
        if rng.random() < wild:
            v = v + rng.choice([-1, 1]) * rng.uniform(500, 900)
        rows.append((cell, i, t1, t1 + dt / 365.25, float(dt), float(v[0]), float(v[1]), 1 / max(120.0, 9314 / dt) ** 2))
    return rows


def whole(rows):
    """Three rounds over the matrix of all pairs and months."""
    t1, t2, w0 = (np.array([r[c] for r in rows]) for c in (2, 3, 7))
    v = np.array([r[5:7] for r in rows])
    edges = SINCE + np.arange(N + 1) / 12
    design = np.clip(np.minimum(t2[:, None], edges[1:]) - np.maximum(t1[:, None], edges[:-1]), 0, None) / (t2 - t1)[:, None]
    diff, x, w = np.diff(np.eye(N), axis=0), np.zeros((N, 2)), w0
    for _ in range(3):
        ata = design.T @ (w[:, None] * design)
        lam = 0.35 * max(np.trace(ata) / N, 1e-6)
        for c in (0, 1):
            for _ in range(6):
                m = ata + lam * diff.T @ ((1 / np.maximum(np.abs(diff @ x[:, c]), 5))[:, None] * diff)
                x[:, c] = np.linalg.solve(m + 1e-6 * max(1, np.trace(m) / N) * np.eye(N), design.T @ (w * v[:, c]))
        p = design @ x
        s = np.hypot(*p.T) + 1e-9
        r = v - p
        tol = np.maximum(25, 0.35 * s)
        u = np.minimum(1, np.hypot((r * p).sum(1) / s / 1.6 / tol, (r[:, 1] * p[:, 0] - r[:, 0] * p[:, 1]) / s / tol) / 3)
        w = w0 * (1 - u * u) ** 2
    return x, int((w > 0.05 * w0.max()).sum()), float(np.sqrt((w * (r * r).sum(1)).sum() / w.sum()))


def fitted(spark, rows):
    return {r.cell: r for r in V.monthly_series(spark.createDataFrame(rows, SCHEMA), ["cell"], SINCE, N).collect()}


def test_equals_whole_matrices_and_finds_the_step(spark):
    few = pairs(3, 3, 29)
    sets = {1: pairs(1, 1, 400, wild=0.2), 2: pairs(2, 2, 300)}
    odd = [(1, 9_000, None, 2016.0, 6.0, 1.0, 1.0, 1.0), (1, 9_001, 2015.5, 2016.0, 6.0, float("nan"), 1.0, 1.0), (1, 9_002, 2015.5, 2015.6, 6.0, 1.0, 1.0, 0.0)]
    got = fitted(spark, [r for rows in sets.values() for r in rows] + few + odd)
    assert set(got) == {1, 2}
    for cell, rows in sets.items():
        x, used, resid = whole(rows)
        r = got[cell]
        assert np.allclose(np.array([r.vx, r.vy]).T, x, rtol=0, atol=1e-6) and r.used == used and r.resid == pytest.approx(resid)
        # single months and both ends are held loosely, in the whole matrices too; both levels of the step stand out
        assert np.abs(np.median(x[5:17], axis=0) - (300, 100)).max() < 10 and np.abs(np.median(x[19:30], axis=0) - (450, 60)).max() < 10


def test_locked_long_pairs_are_left_out(spark):
    rows = pairs(5, 1, 500, lock=150)
    got = fitted(spark, rows)[1]
    x, used, _ = whole([r for r in rows if r[4] <= 128])
    assert np.allclose(np.array([got.vx, got.vy]).T, x, atol=1e-6) and got.used == used


def test_pairs_outside_the_months_and_empty_table(spark):
    assert fitted(spark, []) == {}
    away = [(1, i, 2030.0, 2030.1, 30.0, 100.0, 50.0, 1.0) for i in range(40)]
    assert set(fitted(spark, away)[1].vx) == {0.0}


def test_bands_of_every_width_are_eliminated():
    rng = np.random.default_rng(0)
    for n, width in ((1, 2), (2, 2), (9, 4), (6, 8)):
        full = np.zeros((3, n, n))
        for p in range(min(width, n)):
            d = rng.normal(size=(3, n - p)) + (10 * width if p == 0 else 0)
            full[:, range(n - p), range(p, n)] = full[:, range(p, n), range(n - p)] = d
        band = np.zeros((3, n, width))
        for p in range(min(width, n)):
            band[:, : n - p, p] = full[:, range(n - p), range(p, n)]
        rhs = rng.normal(size=(3, n))
        assert np.allclose(V.eliminate(band, rhs), np.linalg.solve(full, rhs[:, :, None])[:, :, 0])
