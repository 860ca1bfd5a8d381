"""What the operators of this package share: columns, shared storage, links."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches hold at most this many bytes, so that long texts don't fill a worker.
BATCH_BYTES = str(8 << 20)
#: Spark's setting by which an execution's shuffle files go when it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local one if all run in one process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kestrine-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package has written under shared_dir()."""
    if not path.startswith(shared_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of executors and aren't computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def swept(df: DataFrame) -> DataFrame:
    """cut(), after which the shuffle files that it took go at once instead of when the driver happens to collect garbage. For steps of which there are many in a row."""
    spark = df.sparkSession
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        return cut(df.select("*"))  # a frame takes the setting of the time when it is made
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_bytes(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def same(a: str, b: str, *keys: str) -> Column:
    """Null-safe equality of the aliases' keys."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, root) per node, root the smallest node reached.

    Alternates large-star and small-star steps until the edges stay the same;
    each step is a minimum per node (combined before the shuffle) and a join
    that adaptive execution may split, so hubs don't meet in one task. A large
    star has at most a row for each edge, so repeated ones go once a round.
    """
    def pairs(x: list[Column], y: list[Column]) -> Column:
        return F.explode(F.array(*(F.struct(a.alias("u"), b.alias("v")) for a, b in (x, y)))).alias("p")

    u, v, m = F.col("u"), F.col("v"), F.col("m")
    e = swept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.select(pairs([u, v], [v, u])).select("p.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.join(low, "u").where("v > u").select(v.alias("u"), m.alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = swept(large.join(low, "u").select(pairs([u, m], [v, m])).select("p.*").where("u <> v").distinct())
        after = e.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError("components did not settle")
