import pytest
from pyspark.sql import functions as F

from kestrine.sources import readers as RD, writers as WR


def test_features_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null,"properties":{"n":1}},{"type":"Feature","id":"q","geometry":{"type":"Polygon","coordinates":[[[0,0,5],[1,0,5],[1,1,5]]]},"properties":{"m":"x"}}]}')
    rows = sorted(RD.features(spark, str(tmp_path)).collect(), key=lambda r: r.position)
    assert [r.id for r in rows] == ["upload-1", "q"] and rows[0].properties == {"n": "1"}
    f = RD.features(spark, str(tmp_path))
    assert RD.route(f).first().kind == "polygons"
    g = f.where("id = 'q'").select(RD.multipolygon(F.col("geometry_type"), F.col("coordinates")).alias("g")).first().g
    assert [(p.x, p.y) for p in g[0][0]] == [(0, 0), (1, 0), (1, 1)]


def test_other_documents_raise(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"Feature"}')
    with pytest.raises(Exception, match="FeatureCollection"):
        RD.features(spark, str(tmp_path)).collect()


def test_ramp_and_csv(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# c\nnv 0 0 0 0\n1 10 20 30\n2.5 1 2 3 0 # end\n")
    assert [tuple(r) for r in RD.colour_ramp(spark, str(tmp_path / "r.txt")).collect()] == [(1.0, 10, 20, 30, 255), (2.5, 1, 2, 3, 0)]
    (tmp_path / "r.csv").write_text("# made by\n# hand\na,b\n1,2\n3, \n")
    assert [(r.a, r.b) for r in RD.commented_csv(spark, str(tmp_path / "r.csv"), "a string, b string", ["b"]).collect()] == [("1", "2")]


def test_int16(spark):
    df = spark.createDataFrame([(2.5,), (None,), (1e9,)], "v double").select(WR.packed_int16(F.col("v")).alias("p"))
    assert [r.p for r in df.collect()] == [2, -32768, 32000]
    assert [r[0] for r in df.select(WR.unpacked(F.col("p"))).collect()] == [2.0, None, 32000.0]


def test_validation_fails_when_read(spark):
    assert RD.validated(spark.range(3), F.col("id") >= 0, "id").count() == 3
    with pytest.raises(Exception, match="invalid: id"):
        RD.validated(spark.range(3), F.col("id") > 0, "id").collect()
