"""Geometry, histograms, fits and grids against what is known of their inputs."""

import math

import numpy as np
from pyspark.sql import functions as F

from kestrine.functions import geo, predicates as P, scalars as S
from kestrine.operators import histograms as H, particles as PT, raster as G, timeseries as T


def test_albers_round_trip_and_equal_area(spark):
    pts = spark.createDataFrame([(-150.0, 61.0), (-135.5, 58.2), (-165.0, 66.0)], "lon double, lat double")
    x, y = geo.albers("lon", "lat")
    back = geo.albers_inverse("x", "y")
    for r in pts.withColumns({"x": x, "y": y}).withColumns({"lon2": back[0], "lat2": back[1]}).collect():
        assert abs(r.lon - r.lon2) < 1e-7 and abs(r.lat - r.lat2) < 1e-7
    d = 0.01
    cell = lambda lon, lat: [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d)]
    rows = [(n, k, *p) for n, c in enumerate([cell(-150.0, 60.0), cell(-140.0, 60.0)]) for k, p in enumerate(c)]
    df = spark.createDataFrame(rows, "n int, k int, lon double, lat double").withColumns({"x": x, "y": y})
    ring = F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    areas = [r.a for r in df.groupBy("n").agg(ring.alias("r")).select(geo.area(F.array(F.array("r"))).alias("a")).collect()]
    assert abs(areas[0] / areas[1] - 1) < 1e-6


def test_covers_boundary_hole_outside(spark):
    sq = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]]]
    df = spark.createDataFrame([(sq, x, y) for x, y in ((3.0, 3.0), (0.0, 2.0), (1.5, 1.5), (1.0, 1.5), (5.0, 1.0), (4.0, 4.0))], "g array<array<array<struct<x: double, y: double>>>>, x double, y double")
    assert [r.c for r in df.select(geo.covers("g", "x", "y").alias("c")).collect()] == [True, True, False, True, False, True]
    a, c = df.select(geo.area("g"), geo.centroid("g")).first()
    assert a == 15.0 and abs(c.x - (4 * 4 * 2 - 1.5) / 15) < 1e-12


def test_view_over_the_antimeridian(spark):
    df = spark.createDataFrame([(-178.0, 0.0), (170.0, 0.0), (175.0, 0.0)], "lon double, lat double")
    assert [r[0] for r in df.select(P.in_view("lon", "lat", 174, -10, 184, 10)).collect()] == [True, False, True]


def test_haversine_quarter(spark):
    d = spark.range(1).select(S.haversine(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))).first()[0]
    assert abs(d - math.pi / 2 * S.EARTH) < 1e-3


def test_seasonal_bins(spark):
    s = "timing string, doy int, doy_end int, span int, year int, volume double"
    n = lambda *rows: {r.bin: r.n for r in H.seasonal(spark.createDataFrame(list(rows), s)).collect() if r.n}
    for doy, b in ((1, 0), (10, 0), (11, 1), (360, 35), (361, 36), (366, 36)):
        assert n(("point", doy, None, None, 2012, None)) == {b: 1.0}
    assert n(("range", 6, 15, 10, 2012, 1.0)) == {0: 0.5, 1: 0.5}
    assert n(("range", 361, 5, 10, 2011, 1.0)) == {36: 0.5, 0: 0.5}


def test_seasonal_mass_is_the_number_of_events(spark):
    rows = [("range", d, d + w, w + 1, 2011, 1.0) for d in range(1, 300, 7) for w in (0, 3, 40)]
    h = H.seasonal(spark.createDataFrame(rows, "timing string, doy int, doy_end int, span int, year int, volume double"))
    assert abs(h.agg(F.sum("n")).first()[0] - len(rows)) < 1e-9


def test_timeline_weights(spark):
    s = "day date, d0 date, d1 date, year_num int, volume double"
    import datetime as dt

    rate = lambda *row: {r.bin: r.rate for r in H.timeline(spark.createDataFrame([(*row, 1.0)], s), 2020).collect() if r.rate}
    assert rate(None, dt.date(2012, 1, 31), dt.date(2012, 2, 1), 2012) == {"2012-01": 0.5, "2012-02": 0.5}
    assert rate(dt.date(2013, 5, 5), None, None, 2005) == {"2005": 1 / 12}
    assert rate(dt.date(2013, 5, 5), None, None, 2021) == {}
    assert all(abs(v - 1 / 12) < 1e-12 for v in rate(None, None, None, 2013).values()) and len(rate(None, None, None, 2013)) == 12
    assert rate(None, None, None, 1700) == {"M": 1 / 150 / 12}


def test_normal_equations_against_numpy(spark):
    """Weights, season, ridge and damping; a cell without enough rows has no solution where nothing damps."""
    rng = np.random.default_rng(1)
    rows = [(c, float(t), float(t + d), float(v), float(w)) for c in range(3) for t, d, v, w in zip(rng.uniform(2015, 2025, 60), rng.uniform(0.02, 0.6, 60), rng.normal(300, 20, 60), rng.uniform(0.5, 2, 60), strict=True)]
    df = spark.createDataFrame(rows, "cell int, t1 double, t2 double, v double, w double")
    design = T.interval_design("t1", "t2", 2020.0)
    for damping, ridge in ((None, 0.0), ((0.0, 0.0, 3.0, 3.0), 1e-3)):
        got = {r.cell: r.coef for r in T.ridge_solve(T.normal_equations(df, ["cell"], design, "v", "w"), damping, ridge).collect()}
        for c in range(3):
            t1, t2, v, w = (np.array([r[k] for r in rows if r[0] == c]) for k in (1, 2, 3, 4))
            tau = 2 * np.pi
            a = np.stack([np.ones(60), (t1 + t2) / 2 - 2020, (np.sin(tau * t2) - np.sin(tau * t1)) / (tau * (t2 - t1)), (np.cos(tau * t1) - np.cos(tau * t2)) / (tau * (t2 - t1))], axis=1)
            n = a.T @ (a * w[:, None])
            want = np.linalg.solve(n + np.eye(4) * ridge * np.trace(n) / 4 + np.diag(damping or [0] * 4), a.T @ (w * v))
            assert np.allclose(got[c], want, rtol=1e-7)
    lone = spark.createDataFrame([(1, 2020.0, 2020.5, 5.0, 1.0)], df.schema)
    assert T.ridge_solve(T.normal_equations(lone, ["cell"], design[:1], "v", "w"), ridge=0.0).first().coef is None
    assert abs(T.ridge_solve(T.normal_equations(lone, ["cell"], design[:1], "v", "w"), (0.0, 1.0), 1e-9).first().coef[0] - 5) < 0.5


def test_sensors_and_floors(spark):
    df = spark.createDataFrame([(10.0, "S1A", "S1A"), (1000.0, "S1A", None), (1000.0, None, "L7x"), (0.0, "L7", "L8")], "dt double, a string, b string")
    got = [r[0] for r in df.select(T.pair_sigma("dt", ("a", "b"), 120.0, {"L7": 3.0, "L8": 2.0})).collect()]
    assert np.allclose(got, [25.5 * 365.25 / 10, 120.0, 360.0, 25.5 * 365.25 * 3])


def test_close_words_and_repairs(spark):
    df = spark.createDataFrame([("Deposit ",), ("depsit",), ("bodies",), ("sources",), ("zzz",), (None,)], "v string")
    known = ("source", "body", "deposit")
    assert [r[0] for r in df.select(S.vocabulary("v", {"bodies": "body"}, known)).collect()] == ["deposit", None, "body", "source", None, None]
    assert {r.v: r.w for r in S.close_word(df, "v", known, "w").collect()} == {"Deposit ": "deposit", "depsit": "deposit", "bodies": None, "sources": "source", "zzz": None, None: None}
    bad = spark.createDataFrame([("caf√©",), ("â€™",), ("plain",), ("Ã¶",)], "t string")
    assert [r[0] for r in bad.select(S.mojibake("t")).collect()] == [1, 4, None, 3]
    assert [r[0] for r in bad.select(S.repaired("t")).collect()][:3] == ["café", None, "plain"]


def test_circular_mean_wraps(spark):
    m = spark.createDataFrame([(364.0,), (2.0,)], "d double").agg(T.circular_mean("d")).first()[0]
    assert abs(m - 0.375) < 1e-6


def test_moving_average_repeats_the_ends(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(20)], "k string, t int, v double")
    y = np.arange(20.0) ** 2
    pad = np.concatenate([np.full(6, y[0]), y, np.full(6, y[-1])])
    want = np.convolve(pad, np.ones(13) / 13, mode="valid")
    got = [r.smooth for r in T.moving_average(df, ["k"], "t", "v").orderBy("t").collect()]
    assert np.allclose(got, want)


def grid_of(spark, v, stale=()):
    return spark.createDataFrame([(1, i, j, None if np.isnan(v[i, j]) else float(v[i, j]), (i, j) in stale) for i in range(v.shape[0]) for j in range(v.shape[1])], "tile int, i int, j int, v double, stale boolean")


def test_neighbourhoods_against_loops(spark):
    """Squares of cells around each, at the rim and with holes."""
    rng = np.random.default_rng(3)
    v = rng.normal(10, 3, (13, 11))
    v[rng.random(v.shape) < 0.3] = np.nan
    df = grid_of(spark, v)
    filled = {(r.i, r.j): r.filled for r in G.idw_fill(df, 2, 3).collect()}
    smooth = {(r.i, r.j): r.filtered for r in G.bilateral(df, 2, 1.5, 2.0).collect()}
    context = {(r.i, r.j): r.context for r in G.window_percentile(df, 2, 0.75).collect()}
    assert len(filled) == len(smooth) == len(context) == v.size
    for (i, j), own in np.ndenumerate(v):
        near = [(a - i, b - j, v[a, b]) for a in range(max(0, i - 2), min(13, i + 3)) for b in range(max(0, j - 2), min(11, j + 3)) if not np.isnan(v[a, b])]
        if np.isnan(own):
            w = [1 / max(math.hypot(a, b), 0.5) ** 2 for a, b, _ in near]
            want = np.average([x for *_, x in near], weights=w) if len(near) >= 3 else None
            assert smooth[i, j] is None and (filled[i, j] is None) == (want is None) and (want is None or abs(filled[i, j] - want) < 1e-9)
        else:
            w = [math.exp(-(a * a + b * b) / 4.5 - (x - own) ** 2 / 8) for a, b, x in near]
            assert filled[i, j] == own and abs(smooth[i, j] - np.average([x for *_, x in near], weights=w)) < 1e-9
        assert (context[i, j] is None) == (len(near) <= 0.15 * 25) and (context[i, j] is None or abs(context[i, j] - np.percentile([x for *_, x in near], 75)) < 1e-9)


def test_fill_reaches_corners_and_leaves_stale_cells(spark):
    """Donors only in the corners of the square count; what has ended stays empty."""
    v = np.full((5, 5), np.nan)
    v[0, 0] = v[0, 4] = v[4, 0] = 1.0
    assert {(r.i, r.j): r.filled for r in G.idw_fill(grid_of(spark, v), 2, 3).collect()}[2, 2] == 1.0
    assert {(r.i, r.j): r.filled for r in G.idw_fill(grid_of(spark, v, {(2, 2)}), 2, 3, stale="stale").collect()}[2, 2] is None


def test_surplus_retires_with_slack(spark):
    rows = [(c, n, float(n)) for c, k in (("a", 5), ("b", 6), ("c", 9), ("d", 1)) for n in range(k)]
    p = spark.createDataFrame(rows, "cell string, id long, age double")
    got = PT.managed(p, p.select("cell").distinct(), ["cell"], 3, 5).collect()
    ids = {c: sorted(r.id for r in got if r.cell == c) for c in "abcd"}
    assert ids["a"] == [0, 1, 2, 3, 4] and ids["b"] == [0, 1, 2, 3, 4, 5] and ids["c"] == [4, 5, 6, 7, 8]
    assert len(ids["d"]) == 3 and sum(i < 0 for i in ids["d"]) == 2


def test_published_coordinates(spark):
    """Worked examples of the standard manual of map projections: Albers on Clarke 1866, polar stereographic on the International ellipsoid."""
    x, y = geo.albers(F.lit(-75.0), F.lit(35.0), -96.0, 23.0, 29.5, 45.5, 6_378_206.4, 0.00676866)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 1_885_472.7) < 1 and abs(r.y - 1_535_925.0) < 1
    lon, lat = geo.albers_inverse(F.lit(1_885_472.7), F.lit(1_535_925.0), -96.0, 23.0, 29.5, 45.5, 6_378_206.4, 0.00676866)
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(r.lon + 75) < 1e-5 and abs(r.lat - 35) < 1e-5
    # 75 S, 150 E about 100 W with a true scale at 71 S, seen from the north
    x, y = geo.polar_stereographic(F.lit(-150.0), F.lit(75.0), 100.0, 71.0, 6_378_388.0, 0.00672267)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 1_540_033.6) < 1 and abs(r.y - 560_526.4) < 1


def test_crest_of_a_season(spark):
    df = spark.createDataFrame([(3.0, 4.0), (-1.0, 0.0), (0.0, -2.0), (0.0, 0.0)], "c double, s double")
    amp, phase = T.season_of("c", "s")
    got = [tuple(r) for r in df.select(amp, phase).collect()]
    assert [g[0] for g in got] == [5.0, 1.0, 2.0, 0.0] and got[3][1] is None
    assert np.allclose([g[1] for g in got[:3]], [math.atan2(4, 3) / 2 / math.pi * 365.25, 365.25 / 2, 365.25 * 0.75])
