import math
import random

from pyspark.sql import functions as F

from kestrine.operators import fits as T
from kestrine.operators.relational import percentiles

SCHEMA = "cell int, id long, t1 double, t2 double, dt double, vx double, vy double, w double"


def planted(rng, cell, n, level, trend, season, wild=0.0, lock=None, years=(2015.0, 2024.5)):
    rows = []
    for i in range(n):
        dt = rng.choice([6, 12, 24, 48, 96, 200, 300])
        tm = rng.uniform(*years)
        v = [b + t * (tm - 2024.5) + s * math.cos(2 * math.pi * tm) + rng.gauss(0, 2) for b, t, s in zip(level, trend, season, strict=True)]
        if lock and dt > lock:
            v = [0.3 * c for c in v]
        if rng.random() < wild:
            v = [c + rng.choice([-1, 1]) * rng.uniform(400, 900) for c in v]
        rows.append((cell, cell * 100_000 + i, tm - dt / 730.5, tm + dt / 730.5, float(dt), *v, 1 / 25.0))
    return rows


def fitted(spark, rows, **more):
    return {r.cell: r for r in T.robust_fit(spark.createDataFrame(rows, SCHEMA), ["cell"], 2024.5, **more).collect()}


def test_truth_is_found_under_blunders_and_locked_pairs(spark):
    rng = random.Random(1)
    rows = planted(rng, 1, 400, (300, 100), (4, 2), (30, 15), wild=0.3) + planted(rng, 2, 400, (300, 100), (4, 2), (0, 0), lock=150) + planted(rng, 3, 400, (200, 0), (0, 0), (0, 0), wild=0.1) + planted(rng, 4, 20, (1, 1), (0, 0), (0, 0))
    got = fitted(spark, rows)
    assert set(got) == {1, 2, 3}  # 4 has too few pairs
    for c, cx, cy in ((1, (300, 4, 30), (100, 2, 15)), (2, (300, 4, 0), (100, 2, 0)), (3, (200, 0, 0), (0, 0, 0))):
        r = got[c]
        for k, (x, y) in enumerate(zip(cx, cy, strict=True)):
            assert abs(r[f"cx{k}"] - x) < (6, 1, 6)[k] and abs(r[f"cy{k}"] - y) < (6, 1, 6)[k], (c, k, r)
        # what doesn't replicate between even and odd years is put to nothing; pairs over a long time hold a smaller season
        assert (r.cx2 == 0) == (c != 1) and (r.cx1 == 0) == (c == 3)
    assert got[1].n < 320 and got[2].n < 320


def test_nulls_ties_hot_cells_and_nothing(spark):
    rng = random.Random(2)
    base = planted(rng, 1, 300, (50, 20), (0, 0), (0, 0))
    odd = [(1, None, 2020.0, 2020.1, 36.0, None, 1.0, 1.0), (1, 1, None, 2020.1, 36.0, 2.0, 1.0, 1.0), (1, 1, 2020.0, 2020.1, 36.0, 1e9, 1.0, 1.0), (1, 1, 2020.0, 2020.1, 36.0, 2.0, 1.0, None)]
    one, more = fitted(spark, base), fitted(spark, base + odd + base[:0])
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(one[1], more[1], strict=True))
    same = [(5, 7, 2020.0, 2020.1, 36.0, 10.0, 5.0, 1.0)] * 60  # one pair again and again
    r = fitted(spark, same)[5]
    assert abs(r.cx0 - 10) < 1e-6 and r.n == 60 and r.resid < 1e-6
    assert fitted(spark, []) == {}


def test_tiers(spark):
    rng = random.Random(3)
    rows = planted(rng, 1, 200, (80, 10), (0, 0), (0, 0))
    rows += planted(rng, 2, 200, (80, 10), (0, 0), (0, 0), years=(2008.0, 2017.9)) + planted(rng, 2, 16, (80, 10), (0, 0), (0, 0), years=(2023.9, 2024.4))
    rows += planted(rng, 3, 200, (80, 10), (0, 0), (0, 0), years=(2008.0, 2017.9))
    rows += planted(rng, 4, 200, (80, 10), (0, 0), (0, 0), years=(2018.0, 2022.0))
    rows += planted(rng, 5, 10, (80, 10), (0, 0), (0, 0), years=(2023.0, 2024.0))
    got = {r.cell: r for r in T.tiered_fit(spark.createDataFrame(rows, SCHEMA), ["cell"], 2024.5, 2018.0).collect()}
    assert {c: r.source for c, r in got.items()} == {1: 1, 2: 2, 3: 4, 4: 5, 5: 0}
    assert got[4].v0 is None and got[4].t_last < 2023.5 and abs(got[2].v0 - math.hypot(80, 10)) < 3


def test_seed_days(spark):
    assert T.seed_days(spark.range(37).withColumn("dt", F.lit(60.0))) == 64.0 and T.seed_days(spark.range(36).withColumn("dt", F.lit(60.0))) == 128.0


def test_percentiles_of_hot_keys(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(None if rng.random() < 0.1 else rng.choice([1, 1, 1, 1, 2]), float(rng.choice([rng.randrange(5), rng.random() * 100]))) for _ in range(3000)] + [(3, None), (4, 7.0)]
    got = {r.k: r for r in percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    assert set(got) == {None, 1, 2, 4}
    for k, r in got.items():
        mine = [v for j, v in rows if j == k and v is not None]
        assert r.m == len(mine) and np.allclose(r.at, np.percentile(mine, [0, 5, 50, 95, 100]))


def test_harmonics(spark):
    from kestrine.operators.harmonics import harmonics

    rng = random.Random(8)
    rows = []
    for cell, first, second, noise in ((1, 20, 0, 0.5), (2, 20, 9, 0.5), (3, 20, 18, 0.5), (4, 0, 0, 0.5), (5, 0, 9, 0.5), (6, 20, 9, 0.5)):
        for m in range(96):
            t = 2000 + (m + 0.5) / 12
            v = 100 + 2 * (t - 2000) + first * math.cos(2 * math.pi * t) + second * math.sin(4 * math.pi * t) + rng.gauss(0, noise)
            rows.append((cell, m, t, v if (cell, m) != (6, 40) else None, 50 + rng.gauss(0, noise)))
    got = {r.cell: r for r in harmonics(spark.createDataFrame(rows, "cell int, m int, t double, vx double, vy double"), ["cell"], "m", "t").collect()}
    assert set(got) == {1, 2, 3, 4, 5}  # 6 lacks a month
    # the second is kept where it is there and decays, never without the first
    assert {c: (r.kept_1, r.kept_2, r.kept_3) for c, r in got.items()} == {1: (True, False, False), 2: (True, True, False), 3: (True, False, False), 4: (False, False, False), 5: (False, False, False)}
    assert abs(got[2].xc_1 - 20) < 1.5 and abs(got[2].xs_2 - 9) < 1.5 and got[2].xc_3 == 0 and got[2].explained_2 > 0.95 > got[4].explained_3
    assert harmonics(spark.createDataFrame([], "cell int, m int, t double, vx double, vy double"), ["cell"], "m", "t").count() == 0
