import math

from pyspark.sql import functions as F

from kestrine.functions import geo, links as L, scalars as S
from kestrine.operators import editing as E


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_links(spark):
    base = "https://maps.example/"
    old = F.lit(base + "#active=7&ext=-150.02,60.99,-149.98,61.01&k=v")
    assert one(spark, L.converted(old)) == base + "#mapCenter=-150.00000%2C61.00000%2C15&mode=explore&active=7&k=v"
    for same in (base + "#mapCenter=1&ext=1,2,3,4", base, base + "#ext=1,2,x,4", base + "#active=9"):
        assert one(spark, L.converted(F.lit(same))) == same
    prefix = "https://stories.example/s/"
    assert one(spark, L.story_slug(F.lit(f" {prefix}a-b_1/?q=1#x "), prefix)) == "a-b_1"
    assert one(spark, L.story_slug(F.lit(prefix + "../x"), prefix)) is None and one(spark, L.story_slug(F.lit("http://other/a"), prefix)) is None
    assert one(spark, L.filled("geo:{lat},{lon}", lat=L.fixed(F.lit(1.23456), 4), lon=L.fixed(F.lit(-2.0), 4))) == "geo:1.2346,-2.0000"


def test_view_state(spark):
    v = one(spark, L.view_state(F.lit("#map=5.00/61.0000/-150.0000&base=sat&sx=120&ov=a.l50&z=1")))
    assert (v.zoom, v.lat, v.lon, v.base, v.sx, v.extras) == (5.0, 61.0, -150.0, "sat", None, {"z": "1"})
    assert one(spark, L.view_state(F.lit("#map=50/0/0"))).zoom is None
    assert one(spark, L.encoded(F.lit(5.0), F.lit(61.0), F.lit(-150.0), F.lit("sat"), F.create_map(F.lit("z"), F.lit("1")))) == "#map=5.00/61.0000/-150.0000&base=sat&z=1"
    assert [one(spark, L.is_view_state(F.lit(x))) for x in ("map=1/2/3", "base=x", "map=<b>", "map=1\n")] == [True, False, False, False]
    assert [one(spark, L.nice_length(F.lit(x))) for x in (7.0, 1300.0, 250.0)] == [5.0, 1000.0, 200.0]


def rings(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


def test_convex_overlap(spark):
    a, b = rings((0, 0), (2, 0), (2, 2), (0, 2)), rings((1, 1), (1, 3), (3, 3), (3, 1))
    assert abs(one(spark, geo.convex_iou(a, b)) - 1 / 7) < 1e-12
    assert one(spark, geo.convex_iou(a, a)) == 1.0
    assert one(spark, geo.convex_iou(a, rings((5, 5), (6, 5), (6, 6)))) == 0.0
    tri = rings((0, 0), (2, 0), (0, 2))
    assert abs(one(spark, geo.convex_iou(a, tri)) - 0.5) < 1e-12


def test_shapes_and_distances(spark):
    a = rings((0, 0), (2, 0), (2, 2), (0, 2))
    assert one(spark, geo.same_shape(a, rings((2, 2), (2, 0), (0, 0), (0, 2), (2, 2)))) is True
    assert one(spark, geo.same_shape(a, rings((0, 0), (2, 0), (2, 2), (0, 3)))) is False
    g = F.array(F.array(a))
    assert one(spark, geo.distance_to(g, F.lit(5.0), F.lit(6.0))) == 5.0 and one(spark, geo.distance_to(g, F.lit(1.0), F.lit(1.0))) == 0.0
    cell = rings((0, 0), (1, 0), (1, 1), (0, 1))
    assert abs(one(spark, geo.spherical_area(cell, 1.0)) - math.radians(1) * math.sin(math.radians(1))) < 1e-12
    assert abs(one(spark, geo.ring_length(rings((0, 0), (90, 0)), S.haversine)) - math.pi / 2 * S.EARTH) < 1e-3


def test_polar_round_trip(spark):
    x, y = geo.polar_stereographic(F.lit(-147.0), F.lit(61.0))
    lon, lat = geo.polar_inverse(F.col("x"), F.col("y"))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).select(F.pmod(lon + 180, F.lit(360.0)) - 180, lat).first()
    assert abs(r[0] + 147) < 1e-8 and abs(r[1] - 61) < 1e-7
    assert abs(one(spark, L.mercator_shift(F.lit(0.5))) - 0.5) < 1e-12


def test_saving_parts(spark):
    parts = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 20, "c")], "rec int, id int, geom string")
    none = parts.limit(0)
    bad = lambda u, d, i: sorted(map(tuple, E.problems(parts, u, d, i, "rec", "id").collect()))
    assert bad(none, parts.where("rec = 2"), none) == [(2, "no part left")]
    assert bad(none, parts.where("rec = 2"), spark.createDataFrame([(2, 21, "n")], parts.schema)) == []
    assert bad(spark.createDataFrame([(2, 10, "x")], parts.schema), none, none) == [(2, "unknown part")]
    up = spark.createDataFrame([(10, "new"), (20, "c")], "id int, new_geom string")
    out = E.saved(parts, up, parts.where("id = 11"), spark.createDataFrame([(1, 12, "i"), (1, 13, "")], parts.schema), "id", F.col("geom") != F.col("new_geom"), F.col("geom") != "")
    assert sorted(map(tuple, out.collect())) == [(1, 10, "new"), (1, 12, "i"), (2, 20, "c")]
    staging = spark.createDataFrame([], "id int, geom string, name string")
    who = spark.createDataFrame([(1, 10, "Free"), (2, 20, "Last"), (1, 11, "TAKEN")], "rec int, id int, name string")
    left, st = E.detached(parts, staging, who.where("id <> 11"), "rec", "id", spark.createDataFrame([("taken",)], "name string"), "name")
    assert sorted(r.id for r in left.collect()) == [11, 20] and [(r.id, r.name) for r in st.collect()] == [(10, "Free")]


def test_preview(spark):
    staged = spark.createDataFrame([(1, "A", "body", 0.0, 0.0), (2, "a", "body", 0.0, 1.0), (3, "B", "source", 5.0, 5.0)], "id int, name string, role string, x double, y double")
    existing = spark.createDataFrame([(9, "b", 5.0, 6.0)], "id int, name string, x double, y double")
    got = {r.name: r for r in E.preview(staged, existing, "name", "role", S.haversine).collect()}
    assert got["A"].warnings == ["parts far apart", "repeated roles"]
    assert got["B"].warnings == ["adds to a record", "far from that record"] and got["B"].attach_to == 9


def test_photos(spark):
    up = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, content string")
    got = {r.id: (r.photo_id, r.dedupe) for r in E.photos_by_content(up, "content", ["id"]).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, True)}
    links = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 2, 1)], "rec int, photo int, sort_order int")
    left, photos = E.unlinked(links, links.where("rec = 2 and photo = 2").select("rec", "photo"), spark.createDataFrame([(1,), (2,)], "photo int"), "rec", "photo")
    assert left.count() == 2 and [r.photo for r in photos.collect()] == [1]
    out = E.reordered(links, spark.createDataFrame([(2, [2, 1])], "rec int, photos array<int>"), "rec", "photo")
    assert {(r.rec, r.photo): r.sort_order for r in out.collect()} == {(1, 1): 0, (2, 1): 1, (2, 2): 0}
    assert sorted(map(tuple, E.settings(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3"), ("c", "9")], "key string, value string")).collect())) == [("a", "1"), ("b", "3")]


def test_part_diff(spark):
    cur = spark.createDataFrame([(1, 7, "g"), (2, 7, "h"), (3, 8, "k")], "id int, rec int, geom string")
    up = spark.createDataFrame([(1, 7, "g"), (2, 7, "H"), (4, 99, "n")], "id int, rec int, geom string")
    got = E.part_diff(cur, up, "id", "rec", cur.select("rec"), F.col("a.geom") == F.col("b.geom"))
    assert {r.id: r.status for r in got.collect()} == {1: "unchanged", 2: "update", 3: "missing", 4: "no parent"}


def test_patching_documents(spark):
    doc = '{"a": "https://m.example/#ext=-150.02,60.99,-149.98,61.01", "b": "https://m.example/#mapCenter=1", "c": "é <x> https://o.example/?ext=1"}'
    out = one(spark, L.patched(F.lit(doc)))
    assert out == doc.replace("#ext=-150.02,60.99,-149.98,61.01", "#mapCenter=-150.00000%2C61.00000%2C15&mode=explore")
    assert one(spark, L.n_patched(F.lit(doc))) == 1


def test_tile_budget(spark):
    n = one(spark, S.tile_count(F.lit(-180.0), F.lit(-85.0), F.lit(179.99), F.lit(85.0), range(3)))
    assert n == 1 + 4 + 16
    assert one(spark, S.zoom_in_budget(F.lit(-180.0), F.lit(-85.0), F.lit(179.99), F.lit(85.0), 30)) == 2


def test_keyframes(spark):
    from kestrine.operators import particles as PT

    s = spark.createDataFrame([(i, i / 8) for i in range(33)], "id int, t double")
    assert sorted(r.t for r in PT.keyframes(s, "t", 0.25, 3, 2.0).collect()) == [1.75, 2.0, 2.25]
