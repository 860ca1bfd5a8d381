"""Writers: feature collections, sorted and quantised bundles, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(ident: Column, lon: Column, lat: Column, properties: Sequence[Column | str]) -> Column:
    """A point feature as JSON; the geometry is null if either coordinate is, null properties stay."""
    geometry = F.when(lon.isNotNull() & lat.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), ident.alias("id"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def shape_feature(ident: Column, polygons: Column, properties: Sequence[Column | str]) -> Column:
    """A multipolygon feature as JSON; rings are closed if they aren't."""
    pair = lambda q: F.array(q["x"], q["y"])
    closed = lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    coordinates = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(closed(r), pair)))
    geometry = F.when(polygons.isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), ident.alias("id"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def write_collections(rows: DataFrame, json_column: str, path: str) -> None:
    """One FeatureCollection per line for up to some thousand features: a line holds what a batch of rows holds, so no task gathers all."""
    batch = F.floor(F.monotonically_increasing_id() / 1000)
    packed = rows.select(json_column, batch.alias("b_")).groupBy("b_").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(json_column), ","), F.lit("]}")).alias("value"))
    packed.select("value").write.text(path)


def flattened(parts: DataFrame, parents: DataFrame, parent_key: str, key: str, drop: Sequence[str] = ()) -> DataFrame:
    """Parts with their parent's columns; the parent's own key goes, and names that both have are the part's."""
    names = [c for c in parents.columns if c not in (*parts.columns, key, *drop)]
    p = parents.select(F.col(key).alias("pk_"), *names)
    return parts.join(p, parts[parent_key] == p["pk_"]).drop("pk_")


def packed_int16(value: Column, scale: float = 1.0, nodata: int = -32768, most: int = 32000) -> Column:
    """Rounded half to even and clipped to 16 bits; null is the no-data value."""
    clipped = F.when(value.isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), F.bround(value / scale, 0))))
    return F.coalesce(clipped, F.lit(nodata)).cast("smallint")


def unpacked(value: Column, scale: float = 1.0, nodata: int = -32768) -> Column:
    return F.nullif(value, F.lit(nodata).cast("smallint")).cast("double") * scale


def write_sorted(df: DataFrame, path: str, by: str, partitions: int | None = None) -> None:
    """A bundle in order of one column, range by range, so that readers skip by its statistics."""
    dealt = df.repartitionByRange(partitions, by) if partitions else df.repartitionByRange(by)
    dealt.sortWithinPartitions(by).write.option("compression", "zstd").parquet(path)


def cropped(df: DataFrame, period: str, value: str, least: int) -> DataFrame:
    """Rows from the first to the last period with more than `least` values; ValueError if there is none."""
    first, last = df.groupBy(period).agg(F.count(value).alias("n_")).where(F.col("n_") > least).agg(F.min(period), F.max(period)).first()
    if first is None:
        raise ValueError(f"no period has more than {least} values")
    return df.where(F.col(period).between(F.lit(first), F.lit(last)))


def write_snapshot(tables: Mapping[str, tuple[DataFrame, str]], members: DataFrame, member_key: str, path: str) -> DataFrame:
    """Each table's rows of the members as Parquet under path/name, and a manifest (name, columns, n); tables give their key."""
    spark = members.sparkSession
    keys = members.select(F.col(member_key).alias("m_")).distinct()
    out = []
    for name, (df, key) in tables.items():
        df.join(keys, df[key] == keys["m_"], "left_semi").write.parquet(f"{path}/{name}")
        out.append((name, list(df.columns), spark.read.parquet(f"{path}/{name}").count()))
    manifest = spark.createDataFrame(out, "name string, columns array<string>, n long")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


def manifest(df: DataFrame, key: str) -> DataFrame:
    """Keys with rows, in order, and how many."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 0").orderBy(key)


def write_chunks(cells: DataFrame, path: str, sizes: tuple[float, float], x: str = "x", y: str = "y", group: int = 8 << 20) -> DataFrame:
    """Writes cells with their chunk (xc, yc) in order of chunks, and returns the table at path.

    Files hold ranges of chunks, cut into row groups of some `group` bytes by
    whose bounds readers skip what they don't need. There are as many files
    as tasks, however many chunks there are: a folder per chunk takes longer
    to make and list than its rows to write.
    """
    at = {"xc": F.floor(F.col(x) / sizes[0]).cast("int"), "yc": F.floor(F.col(y) / sizes[1]).cast("int")}
    cells.withColumns(at).repartitionByRange("xc", "yc").sortWithinPartitions("xc", "yc").write.option("parquet.block.size", group).parquet(path)
    return cells.sparkSession.read.parquet(path)
