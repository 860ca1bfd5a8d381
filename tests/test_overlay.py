import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrine.operators import overlay as O

SCHEMA = "id long, geom array<array<array<struct<x: double, y: double>>>>"


def shared(spark, shapes, pairs, width=1.0):
    s = spark.createDataFrame([(i, None if g is None else [[[(float(x), float(y)) for x, y in r] for r in p] for p in g]) for i, g in shapes.items()], SCHEMA)
    got = O.overlaps(spark.createDataFrame(pairs, "a_id long, b_id long"), s, s, width).collect()
    return {(r.a_id, r.b_id): r for r in got}


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_concave_shapes_holes_and_parts(spark):
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    shapes = {
        1: [[ell]], 2: [[[(x + 0.5, y + 0.5) for x, y in ell][::-1]]], 3: [[box(0, 0, 4, 4), box(1, 1, 3, 3)]], 4: [[box(0, 0, 4, 4), box(1, 1, 3, 3)[::-1]]],
        5: [[box(1, 1, 3, 3)]], 6: [[box(0, 0, 1, 1)], [box(2, 2, 3, 3)]], 7: [[box(4, 0, 5, 4)]], 8: [[[(0, 0), (4, 0), (0, 4), (0, 0)]]], 9: [[[(4, 4), (0, 4), (4, 0)]]], 10: [[box(2, 2, 2, 5)]], 11: None, 12: [],
    }
    want = {(1, 1): 7, (1, 2): 3.25, (1, 3): 7, (3, 4): 12, (3, 5): 0, (4, 5): 0, (5, 6): 1, (1, 6): 1, (3, 7): 0, (8, 9): 0, (8, 5): 2, (8, 3): 6, (8, 1): 5.5 + 0.5, (10, 3): 0}
    for width in (0.3, 1.0, 100.0):
        got = shared(spark, shapes, [*want, (1, 11), (12, 1)], width)
        assert {k: round(got[k].both, 9) for k in want} == {k: pytest.approx(v) for k, v in want.items()}
    assert got[1, 1].iou == pytest.approx(1) and got[3, 4].iou == pytest.approx(1) and got[1, 3].iou == pytest.approx(7 / 12)


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def test_against_counted_points(spark):
    rng = random.Random(6)

    def star():
        cx, cy = rng.uniform(0, 4), rng.uniform(0, 4)
        return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in ((2 * math.pi * k / 11, rng.uniform(0.4, 3)) for k in range(11))]

    shapes = {i: [[star()]] for i in range(12)}
    pairs = [(i, j) for i in range(12) for j in range(i)]
    got = shared(spark, shapes, pairs, 0.5)
    points = [(x / 40, y / 40) for x in range(-130, 300) for y in range(-130, 300)]
    has = {i: {p for p in points if inside(g[0][0], *p)} for i, g in shapes.items()}
    for a, b in pairs:
        assert abs(got[a, b].both - len(has[a] & has[b]) / 1600) < 0.06


def test_shapes_far_from_the_origin_keep_their_digits(spark):
    far = lambda r: [(x + 1e6, y + 2e6) for x, y in r]
    got = shared(spark, {1: [[far(box(0, 0, 10, 10))]], 2: [[far([(5, 5), (15, 5), (5, 15)])]]}, [(1, 2)], 3.0)
    assert got[1, 2].both == pytest.approx(25, abs=1e-3)


def test_projection_of_nested_shapes(spark):
    s = spark.createDataFrame([(1, [[[(1.0, 2.0), (3.0, 4.0)]]])], SCHEMA)
    r = s.select(O.flat("geom", lambda x, y: (x * 10, y + 1)).alias("g")).first()
    assert [tuple(p) for p in r.g[0][0]] == [(10.0, 3.0), (30.0, 5.0)] and O.trapezoids(s.where(F.lit(False)), "id", 1.0).count() == 0


def test_pairs_by_their_outlines_equal_pairs_by_strips(spark):
    """Stars with holes, parts and rings either way, null and empty shapes; in one block and in many."""
    from kestrine.functions import geo
    from kestrine.operators import relational as R

    rng = random.Random(12)

    def star():
        cx, cy = rng.uniform(0, 6), rng.uniform(0, 4)
        ring = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in ((2 * math.pi * k / 9, rng.uniform(0.6, 3)) for k in range(9))]
        return [ring[:: rng.choice((1, -1))], [(cx + x, cy + y) for x, y in ((-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2))][:: rng.choice((1, -1))]][: rng.choice((1, 2))]

    shapes = [(i, [star()] if i % 5 else [star(), [[(x + 20, y) for x, y in box(0.0, 0.0, 1.0, 1.0)]]]) for i in range(25)] + [(30, None), (31, [])]
    s = spark.createDataFrame(shapes, SCHEMA)
    boxed = O.outlined(s.select("id", "geom", geo.box_of("geom").alias("b")).select("id", "geom", "b.*"))
    pairs = R.meeting_boxes(boxed, boxed, 2.0)
    got = {(r.a_id, r.b_id): r for r in O.shared_areas(pairs).collect()}
    want = {(r.a_id, r.b_id): r for r in O.overlaps(pairs.select("a_id", "b_id"), s, s, 1.0).collect()}
    assert got.keys() == want.keys() and len(got) > 200
    assert all(got[k].both == pytest.approx(want[k].both, abs=1e-9) and got[k].iou == pytest.approx(want[k].iou, abs=1e-9) for k in got)
    one = boxed.where("id < 25").toArrow().to_batches()[0]
    e = O._edges(one["xs"], one["ys"])
    low = np.full(25, -9.0)
    assert np.allclose(O._shared_by_row(e, e, low), O._shared_by_row(e, e, low, 7)) and np.allclose(O._shared_by_row(e, e, low), one["area"])
