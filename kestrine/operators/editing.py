"""Editing shapes and photos as table operations: checks before writes, staging, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group of staged parts is far apart beyond this many metres, and has many parts beyond this number.
FAR, MANY = 5_000.0, 4


def problems(parts: DataFrame, updates: DataFrame, deletes: DataFrame, inserts: DataFrame, parent: str, key: str) -> DataFrame:
    """(parent, problem): ids that aren't on the record, and records that would keep no part."""
    own = parts.select(parent, key)
    strange = updates.select(parent, key).unionByName(deletes.select(parent, key)).distinct().join(own, [parent, key], "left_anti").select(parent, F.lit("unknown part").alias("problem"))
    left = own.join(deletes.select(parent, key).distinct(), [parent, key], "left_anti").select(parent).unionByName(inserts.select(parent)).distinct()
    empty = deletes.select(parent).distinct().join(left, parent, "left_anti").select(parent, F.lit("no part left").alias("problem"))
    return strange.unionByName(empty).distinct()


def saved(parts: DataFrame, updates: DataFrame, deletes: DataFrame, inserts: DataFrame, key: str, changed: Column, valid: Column) -> DataFrame:
    """parts after deletes, updates (columns named new_...) where changed holds, and valid inserts."""
    kept = parts.join(deletes.select(key).distinct(), key, "left_anti")
    names = [c for c in updates.columns if c.startswith("new_")]
    u = kept.join(updates.select(key, *names), key, "left")
    out = u.withColumns({n[4:]: F.when(changed & F.col(n).isNotNull(), F.col(n)).otherwise(F.col(n[4:])) for n in names}).select(*parts.columns)
    return out.unionByName(inserts.where(valid), allowMissingColumns=True)


def detached(parts: DataFrame, staging: DataFrame, who: DataFrame, parent: str, key: str, taken: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(parts, staging) with the parts of who (parent, key, name) moved to staging: unless it is the record's last part, or the name is taken."""
    n = parts.groupBy(parent).agg(F.count(F.lit(1)).alias("n_"))
    go = who.groupBy(parent).agg(F.count(F.lit(1)).alias("g_"))
    fine = n.join(go, parent).where("g_ < n_").select(parent)
    ok = who.join(fine, parent, "left_semi").join(taken.select(F.lower(F.col(name)).alias("t_")), F.lower(F.col(name)) == F.col("t_"), "left_anti")
    moved = parts.join(ok.select(parent, key, name), [parent, key])
    return parts.join(ok.select(parent, key), [parent, key], "left_anti"), staging.unionByName(moved.drop(parent), allowMissingColumns=True)


def preview(staged: DataFrame, existing: DataFrame, name: str, role: str, distance) -> DataFrame:
    """(name, n_parts, attach_to, span, apart, warnings) per staged name.

    staged has x and y of each part, existing (id, name, x, y) of each record.
    span is the greatest distance between two parts of a name, by a self-join
    on it; it only counts for new names, apart only for known ones.
    """
    key = F.lower(F.col(name))
    s = staged.withColumn("k_", key)
    a, b = s.select("k_", "id", F.col("x").alias("ax"), F.col("y").alias("ay")), s.select("k_", F.col("id").alias("id2"), F.col("x").alias("bx"), F.col("y").alias("by"))
    span = a.join(b, "k_").where("id < id2").groupBy("k_").agg(F.max(distance("ax", "ay", "bx", "by")).alias("span"))
    e = existing.groupBy(F.lower(F.col(name)).alias("k_")).agg(F.min("id").alias("attach_to"), F.avg("x").alias("ex"), F.avg("y").alias("ey"))
    g = s.groupBy("k_").agg(F.min(name).alias(name), F.count(F.lit(1)).alias("n_parts"), F.countDistinct(role).alias("roles_"), F.avg("x").alias("sx"), F.avg("y").alias("sy"))
    out = g.join(span, "k_", "left").join(e, "k_", "left").withColumn("apart", F.when(F.col("attach_to").isNotNull(), distance("sx", "sy", "ex", "ey")))
    warn = F.array(F.when(F.col("attach_to").isNotNull(), "adds to a record"), F.when(F.col("apart") > FAR, "far from that record"), F.when(F.col("attach_to").isNull() & (F.col("span") > FAR), "parts far apart"), F.when(F.col("n_parts") > MANY, "many parts"), F.when(F.col("roles_") < F.col("n_parts"), "repeated roles"))
    return out.select(name, "n_parts", "attach_to", "span", "apart", F.filter(warn, lambda x: x.isNotNull()).alias("warnings"))


def photos_by_content(uploads: DataFrame, content: str, order: list[str]) -> DataFrame:
    """uploads with sha256, photo_id (the first upload with that content) and dedupe; null contents are one.

    The first one is a minimum, combined before the shuffle, and the join is one that Spark may split: uploads of one content don't meet in a task.
    """
    h = uploads.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    first = h.groupBy(F.col("sha256").alias("s_")).agg(F.min_by("id", F.struct(*order)).alias("photo_id"))
    met = h.join(first, F.coalesce("sha256", F.lit("")) == F.coalesce("s_", F.lit(""))).drop("s_")
    return met.withColumn("dedupe", F.col("photo_id") != F.col("id"))


def unlinked(links: DataFrame, gone: DataFrame, photos: DataFrame, record: str, photo: str) -> tuple[DataFrame, DataFrame]:
    """(links, photos) after links go; a photo goes with its last link."""
    left = links.join(gone, [record, photo], "left_anti")
    lost = gone.select(photo).distinct().join(left.select(photo), photo, "left_anti")
    return left, photos.join(lost, photo, "left_anti")


def reordered(links: DataFrame, wanted: DataFrame, record: str, photo: str) -> DataFrame:
    """links with sort_order by the posted arrays (record, photos array); what isn't posted keeps its place."""
    at = wanted.select(record, F.posexplode("photos").alias("pos_", photo))
    return links.join(at, [record, photo], "left").withColumn("sort_order", F.coalesce(F.col("pos_"), F.col("sort_order"))).drop("pos_")


def settings(current: DataFrame, posted: DataFrame) -> DataFrame:
    """(key, value): known keys take the posted value."""
    return current.join(posted.select("key", F.col("value").alias("new_")), "key", "left").select("key", F.coalesce("new_", "value").alias("value"))


def not_cached(wanted: DataFrame, cached: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Distinct keys that aren't cached, the first `most` in order if asked."""
    out = wanted.select(key).distinct().join(cached.select(key), key, "left_anti")
    return out.orderBy(key).limit(most) if most else out


def part_diff(current: DataFrame, upload: DataFrame, key: str, parent: str, parents: DataFrame, same_shape: Column) -> DataFrame:
    """(key, status): as merge.diff, with shapes compared by same_shape over aliases a and b, and 'no parent' where the upload's parent is unknown."""
    a, b = current.alias("a"), upload.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    names = [c for c in upload.columns if c in current.columns and c not in (key, "geom")]
    changed = ~same_shape
    for n in names:
        changed = changed | ~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    status = F.when(F.col(f"a.{key}").isNull(), "insert").when(F.col(f"b.{key}").isNull(), "missing").when(F.coalesce(changed, F.lit(True)), "update").otherwise("unchanged")
    got = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.col(f"b.{parent}").alias("p_"), status.alias("status"))
    known = parents.select(F.col(parent).alias("k_")).distinct()
    return got.join(known, F.col("p_") == F.col("k_"), "left").select(key, F.when(F.col("p_").isNotNull() & F.col("k_").isNull(), "no parent").otherwise(F.col("status")).alias("status"))
