"""Hand-computed cases of the rules, and what must hold between cascade, comparison and batch update."""

from pyspark.sql import functions as F

from kestrine.operators import merge as M
from kestrine.operators import rules as U

REC = "id int, kind string, permafrost boolean, volume_site long, volume_method string, year_text string, seismic_at date, date_min date, insar_a boolean, insar_b boolean, insar_c boolean, insar_d boolean, patchy boolean, plain boolean, geomorph boolean, subtle_text string, evaluated boolean"


def one(spark, schema, row, col):
    return spark.createDataFrame([row], schema).select(col).first()[0]


def test_any_true_is_not_sql_or(spark):
    s = "a boolean, b boolean, c boolean, d boolean"
    assert one(spark, s, (False, None, None, None), U.any_true("a", "b", "c", "d")) is False
    assert one(spark, s, (True, False, None, None), U.any_true("a", "b", "c", "d")) is True
    assert one(spark, s, (None, None, None, None), U.any_true("a", "b", "c", "d")) is None


def test_size_inclusion(spark):
    s = "kind string, area_body double, area_source double, area_deposit double"
    cases = [(("slow", 50_000.0, None, None), True), (("slow", 49_999.0, None, None), False), (("slow", None, None, None), False), (("catastrophic", None, 0.0, 500_000.0), True), ((None, 1e9, 1e9, 1e9), None)]
    for row, want in cases:
        assert one(spark, s, row, U.size_inclusion()) is want


def test_creep(spark):
    s = "patchy boolean, plain boolean, insar boolean, geo boolean, subtle string, seen boolean"
    c = U.creep_behavior("patchy", "plain", "insar", "geo", "subtle", "seen")
    assert one(spark, s, (True, True, None, None, None, None), c) == "Patchy obvious creep"
    assert one(spark, s, (None, None, None, None, "  ", True), c) == "Cryptic"
    assert one(spark, s, (None, None, None, None, None, None), c) is None


def test_class_by_era(spark):
    s = "kind string, size_inclusion boolean, creep_behavior string, year_text string, seismic_at date, date_min date"
    for text, want in (("2012", "Catastrophic"), ("2011", "Catastrophic Modern"), ("1850", "Catastrophic Modern"), ("1849", "Catastrophic Holocene"), ("early Holocene", "Catastrophic Holocene")):
        assert one(spark, s, ("catastrophic", True, None, text, None, None), U.record_class()) == want
    assert one(spark, s, ("catastrophic", True, "Cryptic", "2012", None, None), U.record_class()) == "Catastrophic Cryptic"
    assert one(spark, s, ("catastrophic", True, None, "12", None, None), U.record_class()) is None
    assert one(spark, s, ("slow", None, None, None, None, None), U.record_class()) == "Small slow landslide"
    assert one(spark, s, ("slow", True, None, None, None, None), U.record_class()) is None


def test_part_volume_rounds_to_even(spark):
    s = "kind string, permafrost boolean, role string, area double"
    for row, want in ((("slow", True, "body", 2.5), 50), (("catastrophic", None, "deposit", 1.25), 2), (("slow", False, "body", 100.0), 100), (("slow", False, "deposit", 100.0), None)):
        assert one(spark, s, row, U.part_volume()) == want


def test_volumes(spark):
    s = "kind string, volume_body long, volume_source long, volume_deposit long, volume_site long, volume_estimated long"
    assert one(spark, s, ("catastrophic", None, None, None, None, None), U.volume_estimated()) is None
    assert one(spark, s, ("catastrophic", None, 5, 7, None, None), U.volume_estimated()) == 7
    assert one(spark, s, ("slow", None, None, None, 0, 9), U.volume_preferred()) == 0


def test_tolerant_equality(spark):
    s = "a string, b string, x double, y double"
    eq = lambda row, kind, a="a", b="b": one(spark, s, row, U.tolerant_equal(F.col(a), F.col(b), kind))
    assert eq(("", None, None, None), "string")
    assert eq((None, None, 10.0, 11.0), "double", "x", "y")
    assert not eq((None, None, 10.0, 10.00001), "degrees", "x", "y")
    assert not eq((None, None, 10.0, None), "double", "x", "y")


def test_nothing_differs_after_cascade_and_batch(spark):
    recs = spark.createDataFrame([(i, ["slow", "catastrophic"][i % 2], i == 3, 7 if i == 1 else None, None, "2013", None, None, i % 3 == 0 or None, False, None, None, None, None, None, None, True) for i in range(8)], REC)
    parts = spark.createDataFrame([(i, r, 1000.0 * i) for i in range(6) for r in ("source", "body", "deposit")], "parent_id int, role string, area double")
    done = U.cascade(recs, parts)
    again = U.cascade(done, parts)
    cols = {"size_inclusion": "exact", "volume_preferred": "exact", "record_class": "string", "area_body": "double"}
    assert U.differences(done, again, "id", cols).count() == 0
    old = done.withColumn("volume_preferred", F.lit(1).cast("long"))
    assert U.differences(U.applied(old, done, "id", cols), done, "id", cols).count() == 0


def test_triggers():
    assert U.triggered("record_class") == []
    assert U.triggered("insar_a") == ["insar_creep", "creep_behavior", "record_class"]


def test_diff_of_equal_tables_is_empty(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 3)], "id int, name string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "", 3)], "id int, name string, n int")
    assert {r.status for r in M.diff(a, b, "id").collect()} == {"unchanged"}
    assert sorted(map(tuple, M.upsert(a, b, "id").collect())) == [(1, "x", None), (2, "", 3)]


def test_synthesised_parents(spark):
    p = spark.createDataFrame([("X", "source", 1, "a"), ("X", "deposit", 2, "b"), ("Y", "body", 3, None)], "name string, role string, k int, note string")
    got = {r.name: r for r in M.parents_of(p, "name", "role", ["k"], ["note"]).collect()}
    assert (got["X"].kind, got["X"].note, got["X"].conflicts) == ("catastrophic", "a", ["note"])
    assert (got["Y"].kind, got["Y"].conflicts) == ("slow", [])


def test_collisions(spark):
    s = "iou double, ka string, kb string, a string, b string"
    c = M.collision(F.col("iou"), F.col("ka"), F.col("kb"), F.col("a"), F.col("b"))
    assert one(spark, s, (0.9995, "p", "q", "p", "q"), c) == "update"
    assert one(spark, s, (0.5, "p", "p", "p", "p"), c) == "block"
    assert one(spark, s, (0.1, "a b", "a b", "a  B", "A b"), c) == "review"
    assert one(spark, s, (0.1, "a", "b", "a", "b"), c) is None
