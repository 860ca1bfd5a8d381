"""Derived columns: rules with their inputs, the order they run in, and the comparison of stored with computed values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import col, era

#: Thresholds of the rules: fixed values.
BODY_FROM, SOURCE_FROM, DEPOSIT_FROM = 50_000.0, 50_000.0, 500_000.0
CATASTROPHIC_FROM, MODERN_FROM = 2012, 1850
ESTIMATE = "Automated estimate"


def any_true(*flags) -> Column:
    """True if any is true, else false if any is false, else null: not SQL's OR."""
    cs = [col(f) for f in flags]
    some = lambda v: reduce(lambda a, b: a | b, [F.coalesce(c == v, F.lit(False)) for c in cs])
    return F.when(some(True), True).when(some(False), False)


def size_inclusion(kind="kind", body="area_body", source="area_source", deposit="area_deposit", limits=(BODY_FROM, SOURCE_FROM, DEPOSIT_FROM)) -> Column:
    at = lambda c: F.coalesce(col(c), F.lit(0.0))
    return F.when(col(kind) == "slow", at(body) >= limits[0]).when(col(kind) == "catastrophic", (at(source) >= limits[1]) | (at(deposit) >= limits[2]))


def creep_behavior(patchy, plain, insar, geomorph, subtle_text, evaluated) -> Column:
    """A label by priority; patchy before plain, 'Cryptic' if looked at and none seen. The labels are fixed values."""
    t = lambda c: F.coalesce(col(c), F.lit(False))
    return F.when(t(patchy), "Patchy obvious creep").when(t(plain), "Obvious creep").when(t(insar) | F.coalesce(F.length(F.trim(col(subtle_text))) > 0, F.lit(False)), "Subtle creep").when(t(geomorph), "Geomorph creep").when(t(evaluated), "Cryptic")


def record_class(kind="kind", size="size_inclusion", creep="creep_behavior", year_text="year_text", seismic="seismic_at", date_min="date_min") -> Column:
    """Size first; then creep for slow records, and for the others the era, with creep if it is recent. Without either: null."""
    e, kind_, creep_ = era(year_text, seismic, date_min), F.lower(F.trim(col(kind))), F.nullif(F.trim(col(creep)), F.lit(""))
    small = ~F.coalesce(col(size), F.lit(False))
    slow = F.when(small, "Small slow landslide").when(creep_.isNotNull(), F.concat(F.lit("Slow "), creep_))
    recent = F.when(creep_.isNotNull(), F.concat(F.lit("Catastrophic "), creep_)).otherwise("Catastrophic")
    fast = F.when(small, "Small catastrophic landslide").when(e >= CATASTROPHIC_FROM, recent).when((e == 0) | (e >= MODERN_FROM), "Catastrophic Modern").when(e.isNotNull(), "Catastrophic Holocene")
    return F.when(kind_ == "slow", slow).when(kind_ == "catastrophic", fast)


def part_volume(kind="kind", permafrost="permafrost", role="role", area="area") -> Column:
    """Volume of a part from its area; halves go to even."""
    v = F.when(F.coalesce(col(permafrost), F.lit(False)), col(area) * 20).when(((col(kind) == "slow") & (col(role) == "body")) | ((col(kind) == "catastrophic") & (col(role) == "source")), 0.1 * F.pow(col(area), 1.5)).when((col(kind) == "catastrophic") & (col(role) == "deposit"), col(area) * 2)
    return F.bround(v, 0).cast("long")


def volume_estimated(kind="kind", body="volume_body", source="volume_source", deposit="volume_deposit") -> Column:
    zero = F.lit(0).cast("long")
    return F.when(col(kind) == "slow", col(body)).when(col(kind) == "catastrophic", F.nullif(F.greatest(F.coalesce(col(source), zero), F.coalesce(col(deposit), zero)), zero))


def volume_preferred(site="volume_site", estimate="volume_estimated") -> Column:
    return F.coalesce(col(site), col(estimate))


def volume_method(method="volume_method", site="volume_site") -> Column:
    return F.when(col(site).isNotNull(), col(method)).otherwise(ESTIMATE)


@dataclass(frozen=True)
class Rule:
    """What a rule writes, what it reads, and how: as a column, or with part_sums()."""

    target: str
    inputs: tuple[str, ...]
    summary: str
    column: Callable[[], Column] | None = None
    from_parts: bool = False


def part_sums(records: DataFrame, parts: DataFrame) -> DataFrame:
    """records with areas and volumes of their parts by role: six sums in one aggregate, one join."""
    roles = ("body", "source", "deposit")
    names = [f"{v}_{r}" for v in ("area", "volume") for r in roles]
    kinds = records.select(F.col("id").alias("parent_id"), "kind", "permafrost")
    measured = parts.drop("volume").join(kinds, "parent_id").withColumn("volume", part_volume())
    sums = measured.groupBy("parent_id").agg(*[F.sum(F.when(F.col("role") == r, F.col(v))).alias(f"{v}_{r}") for v in ("area", "volume") for r in roles])
    return records.drop(*names).join(sums, records["id"] == sums["parent_id"], "left").drop("parent_id")


RULES: tuple[Rule, ...] = (
    Rule("area_body", ("parts.area",), "areas of a record's parts by role", from_parts=True),
    Rule("size_inclusion", ("kind", "area_body", "area_source", "area_deposit"), "large enough to be listed", column=size_inclusion),
    Rule("volume_body", ("parts.volume",), "volumes of a record's parts by role", from_parts=True),
    Rule("volume_estimated", ("kind", "volume_body", "volume_source", "volume_deposit"), "volume by area", column=volume_estimated),
    Rule("volume_preferred", ("volume_site", "volume_estimated"), "measured on site, else estimated", column=volume_preferred),
    Rule("volume_method", ("volume_method", "volume_site"), "how the volume came about", column=volume_method),
    Rule("insar_creep", ("insar_a", "insar_b", "insar_c", "insar_d"), "any sensor saw creep", column=lambda: any_true("insar_a", "insar_b", "insar_c", "insar_d")),
    Rule("creep_behavior", ("patchy", "plain", "insar_creep", "geomorph", "subtle_text", "evaluated"), "label of creep", column=lambda: creep_behavior("patchy", "plain", "insar_creep", "geomorph", "subtle_text", "evaluated")),
    Rule("record_class", ("kind", "size_inclusion", "creep_behavior", "year_text", "seismic_at", "date_min"), "class shown on the map", column=record_class),
)


def cascade(records: DataFrame, parts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rules in order, each seeing what the earlier ones wrote: one lazy plan over all records.

    All that comes from parts is summed in one pass, before the first rule
    that needs it.
    """
    if any(r.from_parts for r in rules):
        records = part_sums(records, parts)
    for r in rules:
        if not r.from_parts:
            records = records.withColumn(r.target, r.column())
    return records


def triggered(field: str, rules: Sequence[Rule] = RULES) -> list[str]:
    """Targets to compute again when a field changes: none if the field is itself a target."""
    if field in {r.target for r in rules}:
        return []
    dirty = {field}
    for r in rules:
        if dirty & set(r.inputs):
            dirty.add(r.target)
    return [r.target for r in rules if r.target in dirty]


def label(name, role=None) -> Column:
    """What a row is called where it is listed: a record by its name, a part by its record's name and its role."""
    from ..functions.predicates import col as c

    return c(name) if role is None else F.concat(c(name), F.lit(" ("), c(role), F.lit(")"))


def tolerant_equal(a: Column, b: Column, kind: str) -> Column:
    """Equality of stored and computed values: '' is null; floats may differ by 1, metres by half, degrees by half a metre; else exact."""
    if kind == "string":
        return F.nullif(a, F.lit("")).eqNullSafe(F.nullif(b, F.lit("")))
    most = {"double": 1.0, "metres": 0.5, "degrees": 0.5 / 111_320}.get(kind)
    if most is None:
        return a.eqNullSafe(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= most)


def differences(stored: DataFrame, computed: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """(key, column_name, old_value, new_value): a row for each value on which stored and computed don't agree."""
    s, c = stored.alias("s"), computed.alias("c")
    both = s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"))
    changes = F.array(*[F.when(~tolerant_equal(F.col(f"s.{n}"), F.col(f"c.{n}"), kind), F.struct(F.lit(n).alias("column_name"), F.col(f"s.{n}").cast("string").alias("old_value"), F.col(f"c.{n}").cast("string").alias("new_value"))) for n, kind in columns.items()])
    return both.select(F.col(f"s.{key}").alias(key), F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def agreement(stored: DataFrame, computed: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """(rule, agreements, changes) per column, in one pass."""
    s, c = stored.alias("s"), computed.alias("c")
    both = s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"))
    sums = both.agg(*[F.count_if(tolerant_equal(F.col(f"s.{n}"), F.col(f"c.{n}"), k)).alias(n) for n, k in columns.items()], F.count(F.lit(1)).alias("n_"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("agreements"), (F.col("n_") - F.col(n)).alias("changes")) for n in columns])).alias("r")).select("r.*")


def applied(stored: DataFrame, computed: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """stored with the computed value where they don't agree, the stored one where they do."""
    c = computed.select(F.col(key).alias("k_"), *(F.col(n).alias(f"new_{n}") for n in columns))
    out = stored.join(c, stored[key] == c["k_"], "left")
    keep = lambda n, k: F.when(F.col("k_").isNull() | tolerant_equal(F.col(n), F.col(f"new_{n}"), k), F.col(n)).otherwise(F.col(f"new_{n}"))
    return out.withColumns({n: keep(n, k) for n, k in columns.items()}).select(*stored.columns)


def catalogue(spark, rules: Sequence[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame([(n, r.target, list(r.inputs), r.summary) for n, r in enumerate(rules)], "position int, target string, inputs array<string>, summary string")
