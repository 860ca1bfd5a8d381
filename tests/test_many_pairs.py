"""Small tables with many pairs: work is spread over tasks, and equal rows are compared once."""

import random

from pyspark.sql import functions as F

from kestrine import plans
from kestrine.operators import relational as R

from .conftest import SF


def test_equal_rows_are_one_and_no_id_is_lost(spark):
    rows = [(i if i % 10 else None, i % 3, float(i % 2)) for i in range(200)] + [(7, 1, 1.0)]
    df = spark.createDataFrame(rows, "id int, k int, x double")
    whole = R.alike(df, "id").collect()
    assert len(whole) == 6 and sorted((str(e.id), r.k, r.x) for r in whole for e in r.ids) == sorted((str(i), k, x) for i, k, x in rows)
    cut = R.alike(df, "id", 8).collect()
    assert len(cut) > 6 and sorted((str(e.id), r.k, r.x) for r in cut for e in r.ids) == sorted((str(i), k, x) for i, k, x in rows)


def test_dealt_cells_give_each_pair_once(spark):
    rnd = random.Random(11)
    boxes = [(i, x, y, x + rnd.choice([0.0, 2.0, 7.0]), y + 1.0) for i in range(60) for x, y in [(rnd.randint(0, 8) / 2, rnd.randint(0, 8) / 2)]]
    df = spark.createDataFrame([*boxes, boxes[0]], "id int, x0 double, y0 double, x1 double, y1 double")
    pairs = lambda n: sorted(tuple(r) for r in R.meeting_boxes(df, df, 3.0, spread=n).select("a_id", "b_id").collect())
    all_ = [*boxes, boxes[0]]
    assert pairs(1) == pairs(5) == sorted((a[0], b[0]) for a in all_ for b in all_ if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])


def test_pairs_of_a_small_table_are_made_by_many_tasks(spark):
    made = plans.queries()["collision_classes"](spark, SF)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made.groupBy(F.spark_partition_id()).count().count() > 1


def test_upright_boxes_are_told_from_other_rings(spark):
    from kestrine.functions import geo

    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    rings = [box, box[::-1], [*box, box[0]], box[1:] + box[:1], [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 2.0)], [(0.0, 0.0), (2.0, 0.0), (0.0, 1.0), (2.0, 1.0)], [(0.0, 0.0)] * 4, [(0.0, 0.0), (0.0, 1.0), (0.0, 1.0), (0.0, 0.0)], box[:3], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, r array<struct<x: double, y: double>>")
    assert [r[0] for r in df.orderBy("i").select(geo.is_upright("r")).collect()] == [True] * 4 + [False] * 7


def test_a_ring_is_worked_out_once(spark):
    """An expression for a ring stands once among its edges, so that clips of clips don't multiply."""
    from kestrine.functions import geo

    ring = F.array(*[F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((77, 0), (1, 0), (0, 1))])
    plan = spark.range(1).select(geo.edges(ring).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("77") == 1


def test_nearest_of_equal_and_empty_shapes(spark):
    """Places and shapes many times over, groups whose shapes have no points, points without coordinates."""
    from kestrine.functions import geo

    rnd = random.Random(13)
    ring = lambda x, y, w: [[[(x, y), (x + w, y), (x, y + w)]]]
    some = [("a", ring(float(rnd.randint(0, 9)), float(rnd.randint(0, 9)), 2.0)) for _ in range(40)]
    s = spark.createDataFrame([*some, *some, ("a", None), ("a", []), ("b", []), ("c", ring(30.0, 0.0, 1.0))], "g string, geom array<array<array<struct<x: double, y: double>>>>")
    p = spark.createDataFrame([(i, rnd.choice("aaabc"), float(rnd.randint(-5, 20)), rnd.randint(-5, 20) / 3) for i in range(80)] + [(90, "a", None, 1.0), (91, "a", 3.0, 3.0), (92, "a", 3.0, 3.0)], "id int, g string, x double, y double")
    want = {r.id: r.m for r in p.join(s.where("size(geom) > 0"), "g").groupBy("id").agg(F.min(geo.distance_to("geom", "x", "y")).alias("m")).collect()}
    got = {r.id: r.nearest for r in R.nearest_shapes(p, s, "id", 1.0, ["g"]).collect()}
    assert len(got) == 83 and got[90] is None
    assert all((n is None and want.get(i) is None) or abs(n - want[i]) < 1e-12 for i, n in got.items())
