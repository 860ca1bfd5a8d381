"""Readers: feature collections, commented CSV, colour ramps, chunked arrays, catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "type string, features array<struct<type: string, id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"


def features(spark: SparkSession, path: str, whole: bool = False, members: str = "*") -> DataFrame:
    """(file, position, id, geometry_type, coordinates, properties) of GeoJSON collections, one per line, or with whole one per file, however it is laid out.

    members picks files of a folder by a pattern, as of an unzipped upload.

    Coordinates stay text and properties are a map, so files need not agree.
    Features without an id are named by place, 'upload-N'. A document that
    isn't a FeatureCollection raises when it is read.
    """
    rows = spark.read.option("pathGlobFilter", members).option("recursiveFileLookup", True).text(path, wholetext=whole).select("value", F.expr("_metadata.file_path").alias("file"))
    parsed = rows.where(F.length(F.trim("value")) > 0).withColumn("c", F.from_json("value", FEATURES))
    ok = F.when(F.col("c.type") == "FeatureCollection", F.col("c.features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast("array<struct<type: string, id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"))
    f = parsed.select("file", F.posexplode(ok).alias("position", "f"))
    return f.select("file", "position", F.coalesce("f.id", F.concat(F.lit("upload-"), (F.col("position") + 1).cast("string"))).alias("id"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def point(coordinates: Column) -> Column:
    """struct(x, y) of a point's coordinates."""
    a = F.from_json(coordinates, "array<double>")
    return F.struct(F.get(a, F.lit(0)).alias("x"), F.get(a, F.lit(1)).alias("y"))


def multipolygon(geometry_type: Column, coordinates: Column) -> Column:
    """Polygons as array<array<array<struct<x, y>>>>; null for other geometries. More than two ordinates are cut to two."""
    polygons = F.when(geometry_type == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).when(geometry_type == "MultiPolygon", coordinates)
    xy = F.from_json(polygons, "array<array<array<array<double>>>>")
    return F.transform(xy, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y")))))


def route(found: DataFrame) -> DataFrame:
    """(file, kind): polygons or records, by the first geometry that isn't null."""
    first = F.min_by("geometry_type", F.when(F.col("geometry_type").isNotNull(), F.col("position")))
    return found.groupBy("file").agg(F.when(first.isin("Polygon", "MultiPolygon"), "polygons").otherwise("records").alias("kind"))


def commented_csv(spark: SparkSession, path: str, schema: str, needed: Sequence[str]) -> DataFrame:
    """CSV with # lines before the header; rows with a blank in the needed columns go. file tells where a row is from."""
    rows = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path).withColumn("file", F.expr("_metadata.file_path"))
    for c in needed:
        rows = rows.where(F.length(F.trim(F.col(c).cast("string"))) > 0)
    return rows


def colour_ramp(spark: SparkSession, path: str) -> DataFrame:
    """(value, r, g, b, a) of a ramp file: comments and the no-data line are skipped, alpha is 255 if missing."""
    t = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"[\s,]+").alias("p"))
    n = lambda i: F.get("p", F.lit(i)).try_cast("double")
    return t.where((F.size("p") >= 4) & n(0).isNotNull()).select(n(0).alias("value"), *[n(i).cast("int").alias(c) for i, c in enumerate("rgb", 1)], F.coalesce(n(4), F.lit(255)).cast("int").alias("a"))


def unfilled(value: Column, fill: float | None) -> Column:
    """Fill values to null, unless the fill is 0 or unset."""
    return F.nullif(value, F.lit(fill)) if fill else value


def chunks_in(df: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y", chunk_x: str = "xc", chunk_y: str = "yc", sizes: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Cells inside the box; chunk columns are tested first, so that a table partitioned by them is pruned. sizes are a chunk's width and height."""
    x0, y0, x1, y1 = box
    import math

    by_chunk = F.col(chunk_x).between(math.floor(x0 / sizes[0]), math.floor(x1 / sizes[0])) & F.col(chunk_y).between(math.floor(y0 / sizes[1]), math.floor(y1 / sizes[1]))
    return df.where(by_chunk).where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def grid(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(i, j, n) of a matrix in a JSON sidecar: {field: [[...], ...]} over any number of lines."""
    rows = spark.read.option("multiLine", True).schema(f"`{field}` array<array<double>>").json(path)
    return rows.select(F.posexplode(field).alias("i", "row_")).select("i", F.posexplode("row_").alias("j", "n"))


def replaced(rows: DataFrame, path: str, check: Column, probe: Column, what: str) -> DataFrame:
    """Writes rows as the reference table at path and returns it. A row that fails the check, or no row that the probe finds, raises before the old table goes."""
    fine = validated(rows, check, what)
    if fine.where(probe).isEmpty():
        raise ValueError(f"{what}: the probe finds nothing")
    fine.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def catalogue(df: DataFrame, exclude: Sequence[str] = ()) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of a table's columns: what forms, exports and comparisons go by."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema if f.name not in exclude]


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, sha256) of files; contents are read by the executors only."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def validated(rows: DataFrame, check: Column, what: str) -> DataFrame:
    """rows, which fail when read if the check doesn't hold for each of them."""
    return rows.where(F.when(check, True).otherwise(F.raise_error(F.lit(f"invalid: {what}")).cast("boolean")))
