"""Functions that no query calls, on small tables."""

import pytest
from pyspark.sql import functions as F

from kestrine.operators import merge as M, rules as U
from kestrine.sources import readers as RD, writers as WR
from kestrine.streaming import windows as SW


def test_catalogues(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    assert RD.catalogue(df, ("id",)) == [("name", "string", True)]
    rows = U.catalogue(spark).orderBy("position").collect()
    assert [r.target for r in rows] == [r.target for r in U.RULES] and all(r.inputs for r in rows)


def test_files_and_their_contents(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"one")
    (tmp_path / "y.txt").write_bytes(b"two")
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in RD.objects(spark, str(tmp_path)).collect()}
    assert got == {"x.bin": (3, hashlib.sha256(b"one").hexdigest()), "y.txt": (3, hashlib.sha256(b"two").hexdigest())}
    assert RD.objects(spark, str(tmp_path), "*.bin").count() == 1


def test_laid_out_collections_and_members(spark, tmp_path):
    text = """{
  "type": "FeatureCollection",
  "features": [
    {"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"n": 1}}
  ]
}"""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.geojson").write_text(text)
    (tmp_path / "in" / "readme.txt").write_text("not a collection")
    got = RD.features(spark, str(tmp_path), whole=True, members="*.geojson").select("id", RD.point(F.col("coordinates")).alias("p")).collect()
    assert [(r.id, r.p.x, r.p.y) for r in got] == [("p", 1.5, 2.0)]


def test_sidecar_grid(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"size": 2,\n "counts": [[1, 0],\n [5, 7]]}')
    assert sorted(map(tuple, RD.grid(spark, str(tmp_path / "d.json"), "counts").collect())) == [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 5.0), (1, 1, 7.0)]


def test_reference_tables_are_replaced_or_kept(spark, tmp_path):
    path = str(tmp_path / "ref")
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    ok, probe = F.col("name") != "", F.col("name") == "here"
    assert RD.replaced(rows("here", "b"), path, ok, probe, "countries").count() == 2
    with pytest.raises(ValueError, match="probe"):
        RD.replaced(rows("b"), path, ok, probe, "countries")
    with pytest.raises(Exception, match="invalid"):
        RD.replaced(rows("here", ""), path, ok, F.lit(True), "countries")
    assert spark.read.parquet(path).count() == 2


def test_manifest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "tile string")
    assert [tuple(r) for r in WR.manifest(df, "tile").collect()] == [("a", 1), ("b", 2)]


def test_inserts_unknown_columns_and_cascades(spark):
    old, up = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "z", 0), (2, "b", 0)], "id int, v string, w int")
    assert M.unknown_columns(old, up) == ["w"]
    assert sorted((r.id, r.v) for r in M.inserted(old, up, "id").collect()) == [(1, "a"), (2, "b")]
    parents = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id int, twin int")
    children = spark.createDataFrame([(1, "x"), (2, "y")], "parent int, c string")
    got = M.without(parents, parents.where("id = 2"), "id", {"c": (children, "parent")}, "twin")
    assert sorted(map(tuple, got["parents"].collect())) == [(1, None), (3, None)] and [r.c for r in got["c"].collect()] == ["x"]


def test_first_of_each_in_a_stream(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k int, ts string").select("k", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(src)
    got = SW.run_available(SW.first_of_each(SW.source(spark, src), "ts", ["k"]), "first")
    assert sorted(r.k for r in got.collect()) == [1, 2]
