"""An import as one operation: compared, checked, then written as a new version of every table at once.

Two tables take part: records, and parts that point at them. An upload has
both. Its parts may point at its own new records, or at none: then a record is
made for each name among them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import name_key
from ..session import settled
from .merge import diff, first_values

PROBLEM = "kind string, key long, name string, problem string"


@dataclass(frozen=True)
class Tables:
    """records (id, name, ...) and parts (id, record_id, name, role, ...); ids are whole numbers."""

    records: DataFrame
    parts: DataFrame


def numbered(df: DataFrame, order: Sequence[str], after: int, name: str) -> DataFrame:
    """df with name: after + 1, after + 2, ... in order, without gaps.

    Rows are sorted into ranges by Spark; a range starts where those before it
    end, so no task sees more than its range. order should tell rows apart.
    """
    cut = settled(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    sizes = cut.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    starts = sizes.withColumn("start_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")  # a row per range
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return cut.join(starts, "range_").withColumn(name, own + F.col("start_") + F.lit(after)).drop("range_", "start_")


def synthesised(upload: Tables, columns: Sequence[str] = ()) -> Tables:
    """upload in which parts without a record point at one made for their name: catastrophic if one of them is a source or deposit, slow if not.

    Made records get negative ids, below those that the upload has; of
    `columns` each takes the first value among its parts that isn't empty. Parts
    without record and name stay as they are, and fail the checks.
    """
    orphan = F.col("record_id").isNull() & (name_key("name") != "")
    p = upload.parts.withColumn("key_", F.when(orphan, name_key("name")))
    some = p.where("key_ is not null")
    kind = F.when(F.bool_or(F.col("role").isin("source", "deposit")), "catastrophic").otherwise("slow")
    made = some.groupBy("key_").agg(kind.alias("kind"), F.min_by("name", "id").alias("name"))
    if columns:
        made = made.join(first_values(some, "key_", ("id",), columns).drop("conflicts"), "key_")
    low = upload.records.agg(F.least(F.lit(0), F.min("id"))).first()[0]
    made = settled(numbered(made, ["key_"], 0, "k_").withColumn("id", F.lit(low or 0) - F.col("k_")))
    records = upload.records.unionByName(made.select(*[c for c in made.columns if c in upload.records.columns]), allowMissingColumns=True)
    point = made.select("key_", F.col("id").alias("made_"))
    parts = p.join(point, "key_", "left").withColumn("record_id", F.coalesce("record_id", "made_"))
    return Tables(records, parts.select(*upload.parts.columns))


def problems(current: Tables, upload: Tables, checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(kind, key, name, problem) of everything that an import would refuse.

    Ids that are null or given twice, parts that point nowhere, new records
    whose name another record has, and rows for which a check (problem: (kind,
    condition)) doesn't hold; a condition that is null holds.
    """
    row = lambda df, kind, problem: df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("key"), F.col("name"), F.lit(problem).alias("problem"))
    out, both = [], {"record": upload.records, "part": upload.parts}
    for kind, df in both.items():
        out.append(row(df.where("id is null"), kind, "no id"))
        out.append(row(df.where("id is not null").groupBy("id").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1"), kind, "id given twice"))
        out += [row(df.where(~condition), kind, problem) for problem, (k, condition) in checks.items() if k == kind]
    ids = current.records.select("id").unionByName(upload.records.select("id")).distinct().select(F.col("id").alias("record_id"))
    out.append(row(upload.parts.join(ids, "record_id", "left_anti"), "part", "points at no record"))
    key = name_key("name")
    new = upload.records.join(current.records.select("id"), "id", "left_anti").where(key != "")
    renamed = upload.records.select("id", F.col("name").alias("to_"))
    stays = current.records.join(renamed, "id", "left").select(name_key(F.coalesce("to_", "name")).alias("key_")).distinct()
    out.append(row(new.withColumn("key_", key).join(stays, "key_", "left_semi"), "record", "name is taken"))
    twice = new.groupBy(key.alias("key_")).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    out.append(row(new.withColumn("key_", key).join(twice, "key_", "left_semi"), "record", "name given twice"))
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


def compared(current: Tables, upload: Tables, checks: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """(kind, key, status, changes, problems) for every record and part of either side, in one table.

    status is update, insert, unchanged or missing (in the table only, and
    left alone by an import); changes are those of merge.diff, problems those
    found for the key, in order. Rows without an id have key null.
    """
    found = problems(current, upload, checks or {}).groupBy("kind", "key").agg(F.sort_array(F.collect_set("problem")).alias("problems"))
    once = lambda df: df.where("id is not null").dropDuplicates(["id"])
    d = diff(current.records, once(upload.records), "id").withColumn("kind", F.lit("record")).unionByName(diff(current.parts, once(upload.parts), "id").withColumn("kind", F.lit("part")))
    d = d.select("kind", F.col("id").cast("long").alias("key"), "status", "changes")
    same = (F.col("d.kind") == F.col("p.kind")) & F.col("d.key").eqNullSafe(F.col("p.key"))
    both = d.alias("d").join(found.alias("p"), same, "full")
    return both.select(F.coalesce("d.kind", "p.kind").alias("kind"), F.coalesce("d.key", "p.key").alias("key"), F.coalesce("d.status", F.lit("refused")).alias("status"), "changes", F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


def applied(current: Tables, upload: Tables) -> Tables:
    """current with the upload: known ids updated in the columns that the upload has, new records and parts inserted under the next free ids.

    New ids follow the largest of the table, records in the order of theirs in
    the upload; parts are pointed at them. Nothing is checked here.
    """

    def merged(now: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = now.select("id")
        most = now.agg(F.max("id")).first()[0] or 0
        ids = settled(numbered(up.join(known, "id", "left_anti").select("id"), ["id"], most, "new_"))
        up = up.join(ids, "id", "left")
        names = [c for c in up.columns if c in now.columns and c != "id"]
        a, b = now.alias("a"), up.where("new_ is null").alias("b")
        hit = F.col("b.id").isNotNull()
        old = a.join(b, F.col("a.id") == F.col("b.id"), "left").select(*[F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).cast(now.schema[c].dataType).alias(c) if c in names else F.col(f"a.{c}") for c in now.columns])
        new = up.where("new_ is not null").select(F.col("new_").cast(now.schema["id"].dataType).alias("id"), *[F.col(c).cast(now.schema[c].dataType).alias(c) for c in names])
        return old.unionByName(new, allowMissingColumns=True).select(*now.columns), ids

    records, ids = merged(current.records, upload.records)
    to = ids.select(F.col("id").alias("record_id"), "new_")
    pointed = upload.parts.join(to, "record_id", "left").withColumn("record_id", F.coalesce("new_", "record_id")).select(*upload.parts.columns)
    return Tables(records, merged(current.parts, pointed)[0])


def _switch(spark: SparkSession, root: str, version: str) -> None:
    """Point root at a version: the pointer is written beside the old one and renamed over it, which a reader sees whole or not at all."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)
    beside = jvm.org.apache.hadoop.fs.Path(at, f".next-{version}")
    out = at.getFileSystem(conf).create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(beside, jvm.org.apache.hadoop.fs.Path(at, "CURRENT"), over)


def written(spark: SparkSession, tables: Tables, root: str) -> Tables:
    """A new version of both tables under root, switched to once both are whole; older versions stay for those who read them."""
    import uuid

    version = uuid.uuid4().hex
    tables.records.write.parquet(f"{root}/{version}/records")
    tables.parts.write.parquet(f"{root}/{version}/parts")
    _switch(spark, root, version)
    return stored(spark, root)


def stored(spark: SparkSession, root: str) -> Tables:
    """The version that root points at."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return Tables(spark.read.parquet(f"{root}/{version}/records"), spark.read.parquet(f"{root}/{version}/parts"))


def imported(spark: SparkSession, root: str, upload: Tables, checks: Mapping[str, tuple[str, Column]] | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """The whole import into the tables at root: records made for orphans, comparison, checks, then both tables written and switched.

    Returns the comparison. With a problem anywhere nothing is written, and
    ValueError tells how many there are and the first few. If nothing would
    change, nothing is written either.
    """
    now = stored(spark, root)
    up = synthesised(upload, columns)
    found = settled(compared(now, up, checks))
    bad = found.where(F.size("problems") > 0)
    few = bad.orderBy("kind", "key").limit(5).collect()
    if few:
        raise ValueError(f"{bad.count()} rows refused, nothing imported: " + "; ".join(f"{r.kind} {r.key}: {', '.join(r.problems)}" for r in few))
    if not found.where(F.col("status").isin("insert", "update")).isEmpty():
        written(spark, applied(now, up), root)
    return found
