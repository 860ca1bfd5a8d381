"""Whole imports: nothing is written if anything is refused, ids stay dense, and an export comes back as no change."""

import os

import pytest
from pyspark.sql import functions as F

from kestrine.operators import imports as I

RECORDS = "id long, name string, kind string, size double"
PARTS = "id long, record_id long, name string, role string, size double"
def checks():
    return {"size below zero": ("record", F.col("size") >= 0)}


def tables(spark, records, parts):
    return I.Tables(spark.createDataFrame(records, RECORDS), spark.createDataFrame(parts, PARTS))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "tables")
    I.written(spark, tables(spark, [(1, "Alder", "slow", 5.0), (4, "Birch", "slow", None)], [(2, 1, "a", "body", 1.0), (9, 4, "b", None, None)]), path)
    return path


def test_update_insert_and_children_of_new_records(spark, root):
    up = tables(spark, [(1, "Alder", "slow", 6.0), (-7, "Cedar", "fast", 2.0), (-3, "Elm", "fast", None)], [(2, 1, "a", "source", 1.0), (-1, -7, "c", "body", None), (-2, -3, "e", "body", 3.0), (-5, None, " Fir", "deposit", 8.0), (-4, None, "fir ", "body", None)])
    found = I.imported(spark, root, up, checks(), ["size"])
    assert {(r.kind, r.key): r.status for r in found.collect()} == {("record", 1): "update", ("record", 4): "missing", ("record", -7): "insert", ("record", -3): "insert", ("record", -8): "insert", ("part", 2): "update", ("part", 9): "missing"} | {("part", -k): "insert" for k in (1, 2, 4, 5)}
    got = I.stored(spark, root)
    assert rows(got.records) == [(1, "Alder", "slow", 6.0), (4, "Birch", "slow", None), (5, " Fir", "catastrophic", 8.0), (6, "Cedar", "fast", 2.0), (7, "Elm", "fast", None)]
    assert rows(got.parts) == sorted([(2, 1, "a", "source", 1.0), (9, 4, "b", None, None), (10, 5, " Fir", "deposit", 8.0), (11, 5, "fir ", "body", None), (12, 7, "e", "body", 3.0), (13, 6, "c", "body", None)], key=repr)


@pytest.mark.parametrize(
    "records, parts, problem",
    [
        ([(1, "Alder", "slow", -1.0)], [], "record 1: size below zero"),
        ([(None, "Oak", "slow", 1.0)], [], "record None: no id"),
        ([(1, "x", "slow", 1.0), (1, "y", "slow", 1.0)], [], "record 1: id given twice"),
        ([], [(-1, 77, "z", "body", None)], "part -1: points at no record"),
        ([], [(-1, None, None, "body", None)], "part -1: points at no record"),
        ([(-1, " birch", "slow", 1.0)], [], "record -1: name is taken"),
        ([(-1, "Oak", "slow", 1.0), (-2, "oak ", "slow", 1.0)], [], "record -1: name given twice"),
    ],
)
def test_one_problem_stops_all(spark, root, records, parts, problem):
    before = sorted(os.listdir(root)), rows(I.stored(spark, root).records)
    with pytest.raises(ValueError, match="refused, nothing imported") as e:
        I.imported(spark, root, tables(spark, [*records, (-50, "Fine", "slow", 1.0)], parts), checks())
    assert problem in str(e.value)
    assert (sorted(os.listdir(root)), rows(I.stored(spark, root).records)) == before


def test_a_name_freed_by_the_upload_can_be_taken(spark, root):
    I.imported(spark, root, tables(spark, [(4, "Beech", "slow", None), (-1, "Birch", "slow", 1.0)], []), checks())
    assert [r[:2] for r in rows(I.stored(spark, root).records)] == [(1, "Alder"), (4, "Beech"), (5, "Birch")]


def test_round_trip_changes_nothing(spark, root, tmp_path):
    """Export, read back, compare, import: no change, no new version, and the next export has the same bytes."""
    from kestrine.sources import readers, writers

    def export(path):
        t = I.stored(spark, root)
        for name, df in (("records", t.records), ("parts", t.parts)):
            cols = [c for c in df.columns if c != "id"]
            f = df.withColumn("x", F.lit(1.0)).coalesce(1).sortWithinPartitions("id").select(writers.feature(F.col("id"), F.col("x"), F.col("x"), cols).alias("j"))
            f.write.text(f"{path}/{name}")
        return t

    def read(path, name, schema):
        f = spark.read.text(f"{path}/{name}").select(F.from_json("value", "id string, properties map<string, string>").alias("f"))
        types = dict(c.split(" ") for c in schema.split(", "))
        return f.select(*[(F.col("f.id") if c == "id" else F.col("f.properties")[c]).cast(t).alias(c) for c, t in types.items()])

    def contents(path):
        return [p.read_bytes() for p in sorted(path.rglob("part-*"))]

    export(str(tmp_path / "one"))
    back = I.Tables(read(str(tmp_path / "one"), "records", RECORDS), read(str(tmp_path / "one"), "parts", PARTS))
    versions = sorted(os.listdir(root))
    found = I.imported(spark, root, back, checks())
    assert {r.status for r in found.collect()} == {"unchanged"} and sorted(os.listdir(root)) == versions
    export(str(tmp_path / "two"))
    assert contents(tmp_path / "one") == contents(tmp_path / "two") and contents(tmp_path / "one")


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "none")
    I.written(spark, tables(spark, [], []), path)
    assert I.imported(spark, path, tables(spark, [], [])).count() == 0
    I.imported(spark, path, tables(spark, [(-9, "A", None, None)], [(-1, -9, "a", None, None)]))
    got = I.stored(spark, path)
    assert rows(got.records) == [(1, "A", None, None)] and rows(got.parts) == [(1, 1, "a", None, None)]
