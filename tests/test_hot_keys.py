import pytest
from pyspark.sql import functions as F

from kestrine.operators import editing as E, raster as G, relational as R
from kestrine.sources import writers as W


def test_photos_of_one_content(spark):
    rows = [(3, "a"), (1, "a"), (2, "b"), (5, None), (4, None), (6, ""), (7, "")]
    got = {r.id: (r.photo_id, r.dedupe) for r in E.photos_by_content(spark.createDataFrame(rows, "id long, c string"), "c", ["id"]).collect()}
    assert got == {1: (1, False), 3: (1, True), 2: (2, False), 4: (4, False), 5: (4, True), 6: (6, False), 7: (6, True)}


def test_slugs(spark):
    rows = [(1, "x"), (2, "x"), (3, ""), (4, ""), (5, None), (6, None), (7, "y")]
    got = {r.id: r.slug for r in R.disambiguated(spark.createDataFrame(rows, "id long, n string"), F.col("n"), "id").collect()}
    assert got == {1: "x", 2: "x-2", 3: "", 4: "", 5: None, 6: None, 7: "y"}


def test_neighbourhoods_across_chunks(spark):
    cells = [(t, i, j, float(i * 100 + j) if (i + j) % 3 else None, t) for t in (0, 1) for i in range(-5, 40, 1) for j in range(0, 40, 3)]
    df = spark.createDataFrame(cells, "tile long, i int, j int, v double, extra long")
    value = {(t, i, j): v for t, i, j, v, _ in cells if v is not None}
    for radius in (1, 6):
        got = G.neighbourhoods(df, radius).collect()
        assert len(got) == len(cells)
        for r in got:
            want = sorted((value[r.tile, i, j], (i - r.i) ** 2 + (j - r.j) ** 2) for i in range(r.i - radius, r.i + radius + 1) for j in range(r.j - radius, r.j + radius + 1) if (r.tile, i, j) in value)
            assert sorted((x.v, x.d2) for x in r.near) == want and r.extra == r.tile
    assert G.neighbourhoods(df.limit(0), 2).count() == 0


def test_windows_of_nothing_are_null(spark):
    df = spark.createDataFrame([(0, 0, 0, None), (0, 30, 30, 5.0)], "tile long, i int, j int, v double")
    assert {r.i: r.filtered for r in G.bilateral(df).collect()} == {0: None, 30: 5.0}
    assert {r.i: r.filled for r in G.idw_fill(df).collect()} == {0: None, 30: 5.0}
    assert {r.i: r.context for r in G.window_percentile(df, 2, 0.75).collect()} == {0: None, 30: None}


def test_no_period_raises(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "p int, v double")
    assert W.cropped(df, "p", "v", 0).count() == 1
    with pytest.raises(ValueError, match="no period"):
        W.cropped(df, "p", "v", 5)
