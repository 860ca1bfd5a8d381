"""Joins, aggregates, order-dependent picks and set deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import col


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def counts_with_zeros(df: DataFrame, dim: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Counts for every row of dim, 0 where df has none."""
    return dim.join(counts_by(df, *keys, name=name), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def role_sums(parts: DataFrame, parent: str, role: str, value: str, roles: Sequence[str], prefix: str = "area") -> DataFrame:
    """One row per parent, a sum for each role in one pass; null where the parent has no part of that role."""
    return parts.groupBy(parent).agg(*[F.sum(F.when(F.col(role) == r, F.col(value))).alias(f"{prefix}_{r}") for r in roles])


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """The first row of each group in the order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
    return out.select(*keep) if keep else out


def role_rank(role, order: Sequence[str]) -> Column:
    out = F.when(F.lit(False), 0)
    for n, r in enumerate(order):
        out = out.when(col(role) == r, n)
    return out.otherwise(len(order))


def representative(parts: DataFrame, parent: str, role: str, primary: str, order: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One part per parent: by role, then primary ones first (null last), then the ids, which should be total.

    A minimum of structs, combined before the shuffle; nothing is sorted.
    """
    others = [c for c in parts.columns if c != parent]
    rank = F.struct(role_rank(role, order), F.coalesce(-F.col(primary).cast("int"), F.lit(1)), *map(F.col, ids))
    return parts.groupBy(parent).agg(F.min_by(F.struct(*others), rank).alias("p_")).select(parent, "p_.*")


def boxes_in_cells(df: DataFrame, size: float, box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """df with cx and cy, a row for each cell of `size` that the box meets."""
    x0, y0, x1, y1 = (F.floor(F.col(c) / size) for c in box)
    return df.withColumn("cx", F.explode(F.sequence(x0, x1))).withColumn("cy", F.explode(F.sequence(y0, y1)))


def tasks(spark: SparkSession) -> int:
    """How many tasks keep all cores busy with what a small table makes much work of."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def alike(df: DataFrame, id_col: str, most: int = 1024) -> DataFrame:
    """Rows that are equal but for their id as one, with an array ids of structs; about `most` ids in each, so that many make several."""
    cols = [c for c in df.columns if c != id_col]
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*cols)) / most)
    return df.withColumn("part_", F.pmod(F.xxhash64(id_col), parts)).groupBy(*cols, "part_").agg(F.collect_list(F.struct(F.col(id_col).alias("id"))).alias("ids")).drop("part_")


def meeting_boxes(left: DataFrame, right: DataFrame, size: float, on: Sequence[str] = (), spread: int = 1) -> DataFrame:
    """Pairs of rows whose boxes meet, and that agree in the columns `on`: an equi-join on cells of `size`, about as wide as boxes are.

    Columns are named a_ and b_ by side; both have x0, y0, x1, y1. A pair is
    found in each cell that both meet and kept in the first of them, the one
    with the lower left corner of what they share. Small tables may have many
    pairs, so the join's tasks are as many as the cores can use, whatever the
    tables' size, and no side is held as a whole. Where cells are few and
    full, `spread` deals the left rows of a cell to so many tasks.
    """
    side = lambda df, p: boxes_in_cells(df, size).select(*(F.col(c).alias(c if c in (*on, "cx", "cy") else f"{p}_{c}") for c in (*df.columns, "cx", "cy")))
    a, b, cell = side(left, "a"), side(right, "b"), [*on, "cx", "cy"]
    if spread > 1:
        a = a.withColumn("deal_", F.pmod(F.xxhash64(*a.columns), F.lit(spread)).cast("int"))
        b = b.withColumn("deal_", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        cell = [*cell, "deal_"]
    low_x, low_y = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    first = (F.col("cx") == F.floor(low_x / size)) & (F.col("cy") == F.floor(low_y / size))
    return a.repartition(tasks(left.sparkSession), *cell).join(b.hint("merge"), cell).where(meet & first).drop("cx", "cy", "deal_")


def covering_shapes(points: DataFrame, shapes: DataFrame, size: float, x: str, y: str, geom: str = "geom") -> DataFrame:
    """points with each of the shapes (geom and more) that covers them; the boundary counts.

    Shapes are cut into cells of `size`, points look up their own cell. A cell
    that no edge of the shape meets is inside or outside as a whole: the
    latter make no row, and in the former nothing is tested.
    """
    from ..functions.geo import box_of, cell_state, covers

    names = [c for c in shapes.columns if c != geom]
    boxed = shapes.select("*", box_of(geom).alias("b_")).select("*", "b_.*")
    cut_up = boxes_in_cells(boxed, size).withColumn("state_", cell_state(geom, F.col("cx") * size, F.col("cy") * size, F.lit(size))).where("state_ >= 0")
    cut_up = cut_up.select("cx", "cy", *names, "state_", F.when(F.col("state_") == 0, F.col(geom)).alias(geom))
    placed = points.withColumns({"cx": F.floor(F.col(x) / size), "cy": F.floor(F.col(y) / size)})
    return placed.join(cut_up, ["cx", "cy"]).where((F.col("state_") == 1) | F.when(F.col("state_") == 0, covers(geom, x, y)).otherwise(F.lit(False))).drop("cx", "cy", "state_", geom)


def nearest_shapes(points: DataFrame, shapes: DataFrame, key: str, reach: float, on: Sequence[str] = (), geom: str = "geom", turns: int = 40) -> DataFrame:
    """(key, nearest): distance of points (key, x, y) from the nearest shape that agrees in the columns `on`; null if there is none.

    In each turn points look at shapes within the reach, by cells of its size,
    and those that found one are done; the reach doubles for the others, so
    that no point meets all shapes unless it is as far from them as they are
    wide. A point is measured to the shape whose box is nearest, and then only
    to those whose boxes are nearer than that. Equal places and equal shapes
    are looked at once. Shapes without points are none.
    """
    from ..functions.geo import box_of, distance_to
    from ..session import settled

    spark = points.sparkSession
    known = shapes.select(*on, geom).distinct().select(*on, geom, box_of(geom).alias("b_")).where("b_.x0 is not null").select(*on, geom, "b_.*").repartition(tasks(spark))
    boxed = settled(known.withColumn("sid", F.monotonically_increasing_id()))
    places = points.select(*on, "x", "y").distinct().join(boxed.select(*on).distinct(), list(on), "left_semi") if on else points.select("x", "y").distinct().where(F.lit(not boxed.isEmpty()))
    todo = settled(places.where("x is not null and y is not null").withColumn("pid", F.monotonically_increasing_id()))
    box = F.hypot(*(F.greatest(F.lit(0.0), F.col(f"b_{c}lo") - F.col(f"a_{c}"), F.col(f"a_{c}") - F.col(f"b_{c}hi")) for c in "xy"))
    done = None
    for _ in range(turns):
        wide = boxed.select(*on, "sid", *(F.col(f"{c}0").alias(f"{c}lo") for c in "xy"), *(F.col(f"{c}1").alias(f"{c}hi") for c in "xy"), *((F.col(c) + by).alias(c) for c, by in (("x0", -reach), ("y0", -reach), ("x1", reach), ("y1", reach))))
        placed = lambda p: p.select("*", *(F.col(c).alias(c + n) for c in "xy" for n in "01"))
        met = lambda p: meeting_boxes(placed(p), wide, 2 * reach, on, spread=8).withColumn("box_", box)
        measured = lambda pairs: pairs.join(boxed.select("sid", geom), "sid").withColumn("m_", distance_to(geom, "x", "y"))
        near = met(todo).groupBy(F.col("a_pid").alias("pid")).agg(F.min_by("b_sid", "box_").alias("sid"))
        one = settled(measured(todo.join(near, "pid")).select(*on, "x", "y", "pid", "m_"))
        nearer = met(one).where(F.col("box_") < F.col("a_m_")).select(F.col("a_pid").alias("pid"), F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.col("b_sid").alias("sid"))
        best = one.select("pid", "m_").unionByName(measured(nearer).select("pid", "m_")).groupBy("pid").agg(F.min("m_").alias("nearest")).where(F.col("nearest") <= reach)
        found = settled(todo.join(best, "pid").select(*on, "x", "y", "nearest"))
        done = found if done is None else done.unionByName(found)
        todo = settled(todo.join(found, [*on, "x", "y"], "left_anti"))
        if todo.isEmpty():
            break
        reach *= 2
    else:
        raise ValueError("shapes are too far away; start with a larger reach")
    own = points.join(done, [*on, "x", "y"]).groupBy(key).agg(F.min("nearest").alias("nearest"))
    return points.select(key).join(own, key, "left")


def delta(current: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with what to do: add or remove."""
    a, b = current.select(*keys).distinct(), wanted.select(*keys).distinct()
    return b.join(a, list(keys), "left_anti").withColumn("action", F.lit("add")).unionByName(a.join(b, list(keys), "left_anti").withColumn("action", F.lit("remove")))


def token_prefix_pairs(df: DataFrame, id_col: str, name: str, most_extra: int | None = None) -> DataFrame:
    """Pairs (short_id, long_id): the words of one name begin another.

    A long name looks up each of its own proper prefixes by equality, those at
    most most_extra words shorter if that is given; so names that share a
    first word don't meet in one group, and a name of n words makes n - 1 rows.
    """
    toks = df.select(F.col(id_col).alias("id"), F.split(F.lower(F.trim(F.col(name))), r"\s+").alias("t"))
    whole = toks.select(F.col("id").alias("short_id"), F.array_join("t", " ").alias("key"))
    n = F.size("t")
    cuts = F.sequence(F.lit(1) if most_extra is None else F.greatest(F.lit(1), n - most_extra), n - 1)
    heads = toks.where(n > 1).select(F.col("id").alias("long_id"), F.explode(F.transform(cuts, lambda k: F.array_join(F.slice("t", F.lit(1), k), " "))).alias("key"))
    return heads.join(whole, "key").select("short_id", "long_id")


def next_words(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """(short_id, long_id, extra, tail) of names of which one begins the other: the long one's next word, and the short one's last."""
    toks = df.select(F.col(id_col).alias("id"), F.split(F.lower(F.trim(F.col(name))), r"\s+").alias("t"))
    whole = toks.select(F.col("id").alias("short_id"), F.array_join("t", " ").alias("key"), F.element_at("t", -1).alias("tail"))
    heads = toks.where(F.size("t") > 1).select(F.col("id").alias("long_id"), F.inline(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda k: F.struct(F.array_join(F.slice("t", F.lit(1), k), " ").alias("key"), F.get("t", k).alias("extra")))))
    return heads.join(whole, "key").select("short_id", "long_id", "extra", "tail")


def near_pairs(left: DataFrame, right: DataFrame, lid: str, rid: str, metres: float, distance) -> DataFrame:
    """Pairs of points within metres, by an equi-join on grid cells and then the distance.

    left and right have lon and lat. Every left point looks in its own cell
    and the cells around it. Cells are as high as the distance and wide
    enough for it up to 79.9 degrees of latitude; beyond, a row has all
    longitudes in one cell, which also holds right points within the distance
    of that border for the left points beyond it.
    """
    border, step = 79.9, max(metres / 111_000.0 * 1.01, 1e-6)
    n = max(1, int(360 * 0.17 / step))
    polar = F.abs(F.col("lat")) > border

    def placed(d: DataFrame, key: str, prefix: str) -> DataFrame:
        cx = F.least(F.lit(n - 1), F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / (360.0 / n)))
        return d.select(F.col(key).alias(f"{prefix}id"), F.col("lon").alias(f"{prefix}lon"), F.col("lat").alias(f"{prefix}lat"), polar.alias(f"{prefix}polar"), F.floor(F.col("lat") / step).alias("jy"), cx.alias("jx"))

    around = F.array(*map(F.lit, (-1, 0, 1)))
    a = placed(left, lid, "l").withColumn("jy", F.explode(F.transform(around, lambda k: F.col("jy") + k)))
    cells = F.transform(around, lambda k: F.pmod(F.col("jx") + k, F.lit(n)).cast("long"))
    top = F.array(F.lit(-1).cast("long"))
    a = a.withColumn("jx", F.explode(F.when(F.col("lpolar"), top).otherwise(F.array_distinct(F.concat(cells, F.when(F.abs(F.col("llat")) > border - step, top).otherwise(F.array().cast("array<long>")))))))
    b = placed(right, rid, "r")
    own = F.array(F.col("jx").cast("long"))
    b = b.withColumn("jx", F.explode(F.when(F.col("rpolar"), top).when(F.abs(F.col("rlat")) > border - step, F.concat(own, top)).otherwise(own)))
    once = (F.col("jx") >= 0) | F.col("lpolar") | F.col("rpolar")
    out = a.join(b, ["jy", "jx"]).where(once).withColumn("metres", distance("llon", "llat", "rlon", "rlat"))
    return out.where(F.col("metres") <= metres).select("lid", "rid", "metres")


def stab(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, width: float) -> DataFrame:
    """Intervals that hold a point, by an equi-join on buckets of the start, and then the exact test.

    An interval is put in every bucket it meets; buckets should be about as
    wide as intervals are long.
    """
    a = intervals.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    b = points.withColumn("bucket_", F.floor(F.col(at) / width))
    return a.join(b, "bucket_").where(F.col(at).between(F.col(start), F.col(end))).drop("bucket_")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of right that is nearest in `at` within the key, the earlier of two as near.

    One sort per key: the last value before and the first after come from
    windows over the union of both sides.
    """
    l, r = left.select(key, at).distinct().withColumn("v_", F.lit(None)), right.select(key, at, F.struct(F.col(at).alias("t"), F.col(value).alias("x")).alias("v_"))
    both = l.select(key, at, F.lit(None).cast(r.schema["v_"].dataType).alias("v_"), F.lit(True).alias("left_")).unionByName(r.withColumn("left_", F.lit(False)))
    w = Window.partitionBy(key).orderBy(at)
    seen = both.withColumns({"before_": F.last("v_", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "after_": F.first("v_", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))}).where("left_")
    late = F.col("before_").isNull() | (F.abs(F.col("after_.t") - F.col(at)) < F.abs(F.col(at) - F.col("before_.t")))
    found = seen.select(key, at, F.when(late, F.col("after_.x")).otherwise(F.col("before_.x")).alias(value))
    return left.join(found, [key, at], "left")


def _ranked_counts(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, value, n_, to_, m_) per distinct value: how many rows have it, how many of its keys have it or less, and all.

    Keys and values are cut into ranges by Spark, and a key's part of a range
    starts where its parts in the ranges before end, so no task holds all
    values of a key that many rows have. There is a part per key, and one more
    per range.
    """
    from ..session import settled

    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_"))
    cut_up = settled(n.repartitionByRange(*keys, value).withColumn("range_", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    parts = cut_up.groupBy("range_", *keys).agg(F.sum("n_").alias("s_")).withColumns({"start_": F.coalesce(F.sum("s_").over(whole.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "m_": F.sum("s_").over(whole)})
    same = F.col("a.range_") == F.col("b.range_")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    met = cut_up.alias("a").join(parts.alias("b"), same).select(*[f"a.{c}" for c in ("range_", *keys, value, "n_")], "b.start_", "b.m_")
    own = F.sum("n_").over(Window.partitionBy("range_", *keys).orderBy(value))
    return met.select(*keys, value, "n_", (own + F.col("start_")).alias("to_"), "m_")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, at array, m): interpolated percentiles of each key's values, exactly, and how many there are; nulls are left out."""
    cum = _ranked_counts(df, value, keys)
    place = F.col("s_") * (F.col("m_") - 1)
    at = cum.select("*", F.posexplode(F.array(*map(F.lit, shares))).alias("i_", "s_")).withColumns({"lo_": F.floor(place), "hi_": F.ceil(place)})
    has = lambda c: (F.col(c) < F.col("to_")) & (F.col(c) >= F.col("to_") - F.col("n_"))
    two = at.where(has("lo_") | has("hi_")).groupBy(*keys, "i_", "m_").agg(F.min(value).alias("a_"), F.max(value).alias("b_"), F.first(place - F.col("lo_")).alias("f_"))
    mixed = F.col("a_") + (F.col("b_") - F.col("a_")) * F.col("f_")
    return two.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i_", mixed.alias("x_")))), lambda s: s["x_"]).alias("at"), F.first("m_").alias("m"))


def quantile_edges(df: DataFrame, value: str, bins: int, *keys: str) -> DataFrame:
    """(keys, edges array): edge i is the value at position min(m - 1, floor(i / bins * m)) of the sorted values.

    Positions are exact and come from counts per distinct value, which are
    combined before the shuffle.
    """
    cum = _ranked_counts(df, value, keys)
    at = cum.withColumn("i_", F.explode(F.sequence(F.lit(0), F.lit(bins)))).withColumn("p_", F.least(F.col("m_") - 1, F.floor(F.col("i_") * F.col("m_") / F.lit(bins))))
    hit = at.where((F.col("p_") < F.col("to_")) & (F.col("p_") >= F.col("to_") - F.col("n_")))
    return hit.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i_", value))), lambda s: s[value]).alias("edges"))


def summary(df: DataFrame, value: str, shares: Sequence[float], *keys: str) -> DataFrame:
    """(keys, at array): values at position int(share * (m - 1)) of the sorted values, exactly."""
    cum = _ranked_counts(df, value, keys)
    at = cum.select("*", F.posexplode(F.array(*map(F.lit, shares))).alias("i_", "s_")).withColumn("p_", F.floor(F.col("s_") * (F.col("m_") - 1)))
    hit = at.where((F.col("p_") < F.col("to_")) & (F.col("p_") >= F.col("to_") - F.col("n_")))
    return hit.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i_", value))), lambda s: s[value]).alias("at"))


def log_bin(value, low: float, high: float, n: int) -> Column:
    """Bin of equal width in the logarithm, clamped to 0 .. n - 1; 0 for what isn't positive, null for null."""
    import math

    place = F.floor((F.ln(F.greatest(col(value), F.lit(1e-300))) - math.log(low)) / ((math.log(high) - math.log(low)) or 1.0) * n)
    return F.when(col(value) <= 0, 0).when(col(value).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), place)).cast("int"))


def quantile_bin(value, edges) -> Column:
    """Bin of a value by quantile_edges(); ties go up."""
    inner = F.slice(col(edges), 2, F.greatest(F.size(col(edges)) - 2, F.lit(0)))
    return F.when(col(value).isNotNull(), F.size(F.filter(inner, lambda e: col(value) >= e)))


def joint_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], av: str, bv: str, low: int = 1, high: int = 255) -> DataFrame:
    """(av, bv, n, state): cells of two layers counted by their pair of values; state tells what only one has, and what is at an end of the range."""
    joined = a.join(b, list(keys), "full").groupBy(av, bv).agg(F.count(F.lit(1)).alias("n"))
    at_end = F.col(av).isin(low, high) | F.col(bv).isin(low, high)
    return joined.withColumn("state", F.when(F.col(av).isNull() & F.col(bv).isNull(), "none").when(F.col(av).isNull(), "desc only").when(F.col(bv).isNull(), "asc only").when(at_end, "clipped").otherwise("both"))


def stratified_sample(df: DataFrame, strata: Sequence[str], ids: Sequence[str], each: int, seed: int = 12345) -> DataFrame:
    """At most `each` rows of each stratum, by a seeded hash of the ids; the same rows on every run."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])), *ids)
    return df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= each).drop("rn_")


def primary_flags(parts: DataFrame, parent: str, role: str, primary: str, ids: Sequence[str], primary_role: Column) -> DataFrame:
    """parts with new_primary and changed: of the parts with the parent's primary role the first is primary, all others aren't."""
    is_role = F.col(role) == primary_role
    w = Window.partitionBy(parent, is_role).orderBy(F.col(primary).desc_nulls_last(), *ids)
    new = F.coalesce(is_role, F.lit(False)) & (F.row_number().over(w) == 1)
    return parts.withColumn("new_primary", new).withColumn("changed", F.coalesce(primary, F.lit(False)) != F.col("new_primary"))


def disambiguated(df: DataFrame, slug: Column, id_col: str) -> DataFrame:
    """df with slug: the smallest id keeps it, the others get their id appended; '' and null stay. Ids are unique.

    The smallest id is a minimum, combined before the shuffle; rows whose slug says nothing take no part in the join.
    """
    slugged = df.withColumn("slug", slug)
    first = slugged.where("slug <> ''").groupBy(F.col("slug").alias("s_")).agg(F.min(id_col).alias("first_"))
    met = slugged.join(first, F.nullif(F.col("slug"), F.lit("")) == F.col("s_"), "left")
    return met.withColumn("slug", F.when(F.col("s_").isNull() | (F.col("first_") == F.col(id_col)), F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col(id_col).cast("string")))).drop("s_", "first_")


def strided(df: DataFrame, step: int) -> DataFrame:
    """Every step-th cell of a grid in both directions."""
    return df.where((F.col("i") % step == 0) & (F.col("j") % step == 0))


def named_in(df: DataFrame, text: str, pattern: str, records: DataFrame, name: str, id_col: str) -> DataFrame:
    """df with ref_id: the smallest id of the record whose name a text quotes (first group of pattern), or null."""
    first = records.groupBy(F.col(name).alias("n_")).agg(F.min(id_col).alias("ref_id"))
    quoted = df.withColumn("q_", F.nullif(F.regexp_extract(F.col(text), pattern, 1), F.lit("")))
    return quoted.join(first, F.col("q_") == F.col("n_"), "left").drop("q_", "n_")


def gathered_centre(parts: DataFrame, key: str, x: str, y: str, area: str) -> DataFrame:
    """(key, x, y): centre of all parts of a key, weighted by area; of parts without area the plain mean."""
    w = F.sum(area)
    at = lambda c: F.when(w > 0, F.sum(F.col(area) * F.col(c)) / w).otherwise(F.avg(c))
    return parts.groupBy(key).agg(at(x).alias(x), at(y).alias(y))
