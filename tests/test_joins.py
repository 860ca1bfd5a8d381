"""Joins that buckets make possible, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kestrine.functions import geo, scalars as S
from kestrine.operators import relational as R


def metres(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * S.EARTH * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_over_the_antimeridian_and_the_poles(spark):
    rnd = random.Random(7)
    spots = [(179.9, 10.0), (-179.9, 10.0), (0.0, 89.0), (180.0, 88.5), (-60.0, -88.0), (30.0, 79.95), (30.0, 79.5), (0.05, 0.0), (-0.05, 0.0), (359.9 - 360, 45.0)]
    pts = [(i, x + rnd.uniform(-2, 2) / max(0.05, math.cos(math.radians(y))), max(-90, min(90, y + rnd.uniform(-1, 1)))) for i, (x, y) in enumerate(spots * 12)]
    pts = [(i, (x + 180) % 360 - 180, y) for i, x, y in pts]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    for reach in (30_000, 150_000):
        got = {(r.lid, r.rid) for r in R.near_pairs(df, df, "id", "id", reach, S.haversine).collect()}
        rows = R.near_pairs(df, df, "id", "id", reach, S.haversine).count()
        want = {(i, j) for i, a, b in pts for j, c, d in pts if metres(a, b, c, d) <= reach}
        assert got == want and rows == len(want)


def test_stab_and_nearest_against_all_pairs(spark):
    rnd = random.Random(8)
    iv = [(i, a, a + rnd.randint(0, 900)) for i in range(80) for a in [rnd.randint(-500, 2000)]]
    at = sorted({rnd.randint(-600, 3000) for _ in range(60)})
    got = {(r.i, r.t) for r in R.stab(spark.createDataFrame(iv, "i int, a int, b int"), spark.createDataFrame([(t,) for t in at], "t int"), "a", "b", "t", 365).collect()}
    assert got == {(i, t) for i, a, b in iv for t in at if a <= t <= b}
    left = [(k, t) for k in "xy" for t in range(0, 100, 7)] + [("z", 5)]
    right = [(k, t, t * 10) for k in "xy" for t in (3, 4, 50, 51, 90)]
    out = R.nearest(spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "k", "t", "v")
    for r in out.collect():
        mine = sorted((abs(t - r.t), t, v) for k, t, v in right if k == r.k)
        assert r.v == (mine[0][2] if mine else None)


def test_quantiles_against_sorted_values(spark):
    rnd = random.Random(9)
    vals = [(k, float(rnd.randint(0, 30))) for k in "ab" for _ in range(rnd.randint(5, 60))]
    df = spark.createDataFrame(vals, "k string, v double")
    got = {r.k: r.edges for r in R.quantile_edges(df, "v", 5, "k").collect()}
    for k in "ab":
        s = sorted(v for q, v in vals if q == k)
        assert got[k] == [s[min(len(s) - 1, i * len(s) // 5)] for i in range(6)]
    one = spark.createDataFrame([(v, got["a"]) for v in (-1.0, got["a"][1], 99.0)], "v double, e array<double>")
    assert [r[0] for r in one.select(R.quantile_bin("v", "e")).collect()][::2] == [0, 4]
    assert df.select(F.max(R.log_bin("v", 1.0, 30.0, 4))).first()[0] == 3


def test_prefixes_of_any_length(spark):
    df = spark.createDataFrame([("a",), ("a b c d e f g",), ("a b",), ("ab c",), ("A  B c",)], "n string")
    got = {(r.short_id, r.long_id) for r in R.token_prefix_pairs(df, "n", "n").collect()}
    assert got == {("a", "a b"), ("a", "a b c d e f g"), ("a", "A  B c"), ("a b", "a b c d e f g"), ("a b", "A  B c"), ("A  B c", "a b c d e f g")}
    assert ("a", "a b c d e f g") not in {(r.short_id, r.long_id) for r in R.token_prefix_pairs(df, "n", "n", 3).collect()}


def test_meeting_boxes_against_all_pairs(spark):
    rnd = random.Random(3)
    boxes = [(i, rnd.choice("ab"), x, y, x + rnd.choice([0.0, 0.5, 3.0, 9.0]), y + rnd.choice([0.0, 1.0, 4.0])) for i in range(70) for x, y in [(rnd.randint(-20, 20) / 2, rnd.randint(-20, 20) / 2)]]
    df = spark.createDataFrame(boxes, "id int, g string, x0 double, y0 double, x1 double, y1 double")
    for size in (1.0, 2.5, 50.0):
        got = [(r.a_id, r.b_id) for r in R.meeting_boxes(df, df, size, ["g"]).collect()]
        want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
        assert len(got) == len(set(got)) and set(got) == want


def shapes(spark, rnd, n):
    def star(cx, cy, r):
        turn = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(rnd.randint(3, 9)))
        return [(cx + r * rnd.uniform(0.4, 1) * math.cos(t), cy + r * rnd.uniform(0.4, 1) * math.sin(t)) for t in turn]

    rows = [(i, "ab"[i % 2], [[star(rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.uniform(0.3, 6))]]) for i in range(n)]
    return spark.createDataFrame(rows, "name int, g string, geom array<array<array<struct<x: double, y: double>>>>")


def test_covering_shapes_against_all_pairs(spark):
    """Cells inside, outside and on the border of shapes; points on cell borders and corners of shapes too."""
    rnd = random.Random(4)
    s = shapes(spark, rnd, 25)
    pts = [(i, rnd.choice([rnd.uniform(-12, 12), float(rnd.randint(-12, 12))]), rnd.choice([rnd.uniform(-12, 12), float(rnd.randint(-12, 12))])) for i in range(150)] + [(200 + k, p.x, p.y) for k, p in enumerate(s.first().geom[0][0])]
    p = spark.createDataFrame(pts, "id int, x double, y double")
    want = {(r.id, r.name) for r in p.crossJoin(s).where(geo.covers("geom", "x", "y")).collect()}
    for size in (0.5, 2.0, 40.0):
        got = [(r.id, r.name) for r in R.covering_shapes(p, s, size, "x", "y").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_nearest_shapes_against_all_pairs(spark):
    rnd = random.Random(5)
    s = shapes(spark, rnd, 12)
    pts = [(i, rnd.choice("abc"), rnd.uniform(-40, 40), rnd.uniform(-40, 40)) for i in range(60)]
    p = spark.createDataFrame(pts, "id int, g string, x double, y double")
    want = {r.id: r.m for r in p.join(s, "g").groupBy("id").agg(F.min(geo.distance_to("geom", "x", "y")).alias("m")).collect()}
    got = {r.id: r.nearest for r in R.nearest_shapes(p, s, "id", 0.5, ["g"]).collect()}
    assert set(got) == {i for i, *_ in pts}
    assert all(got[i] == pytest.approx(want[i]) if i in want else got[i] is None for i in got)


def test_keyless_quantiles_are_cut_by_ranges(spark):
    rnd = random.Random(6)
    vals = sorted(float(rnd.randint(0, 200)) for _ in range(700))
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(7)
    assert R.quantile_edges(df, "v", 7).first().edges == [vals[min(699, i * 700 // 7)] for i in range(8)]
    assert R.summary(df, "v", (0.0, 0.1, 0.5, 1.0)).first()["at"] == [vals[int(q * 699)] for q in (0.0, 0.1, 0.5, 1.0)]


def test_joins_by_cells_have_no_nested_loops(spark):
    from kestrine import plans

    from .conftest import SF

    for name in ("point_in_polygon", "iou_pairing", "convex_overlaps", "collision_classes", "distance_join", "distance_to_shapes"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
