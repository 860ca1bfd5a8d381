"""Windows over streams: watermarks, late rows, sessions, duplicates. The functions take batches too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def source(spark: SparkSession, path: str, at: str = "ts", files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream; its event time becomes a timestamp, as watermarks ask for."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    # a pattern, as the table may be a folder or one file
    return r.parquet(f"{path}*").withColumn(at, F.col(at).cast("timestamp"))


def windowed(df: DataFrame, at: str, size: str, keys: list[str], aggs: dict[str, Column], slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, end, keys, aggs) of tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    got = df.withWatermark(at, late).groupBy(w.alias("w_"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return got.select(F.col("w_.start").alias("start"), F.col("w_.end").alias("end"), *keys, *aggs)


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """(keys, start, end, n) of sessions that a gap ends."""
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w_"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w_.start").alias("start"), F.col("w_.end").alias("end"), "n")


def first_of_each(df: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row per key within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, appends to Parquet in the shared folder, and returns that table.

    Windows that the watermark hasn't closed are not in it.
    """
    spark = df.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
