"""Tables in order of chunks: as many files as tasks, and a box reads those that may hold it."""

from pathlib import Path

from pyspark.sql import functions as F

from kestrine.sources import readers as RD


def test_many_chunks_are_few_files_and_a_box_reads_few_of_them(spark, tmp_path):
    from kestrine.sources import writers as WR

    cells = spark.range(90_000).select((F.col("id") % 300 - 20).alias("x"), F.floor(F.col("id") / 300).alias("y"), F.col("id").alias("n")).unionByName(spark.createDataFrame([(None, 5, 1)], "x long, y long, n long"))
    # else a table as small as this is one file
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = WR.write_chunks(cells, str(tmp_path / "c"), (2, 3))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = len(list(Path(tmp_path / "c").glob("*.parquet")))
    assert got.count() == 90_001 and got.select("xc", "yc").distinct().count() > 15_000 and 1 < files <= 64
    for box in ((-20, 0, -15, 9), (100, 120, 103, 120), (270, 290, 400, 400)):
        inside = RD.chunks_in(got, box, sizes=(2, 3))
        x0, y0, x1, y1 = box
        assert inside.count() == len(range(max(-20, x0), min(279, x1) + 1)) * len(range(max(0, y0), min(299, y1) + 1))
        assert inside.select(F.expr("_metadata.file_path")).distinct().count() < files
        assert "GreaterThanOrEqual(xc" in inside._jdf.queryExecution().executedPlan().toString()
