"""Comparing an upload with a table, and merging it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Overlap from which an uploaded shape is the stored one, and from which it may be.
SAME_SHAPE, MAYBE_SHAPE = 0.999, 0.80


def changed(a: Column, b: Column, text: bool) -> Column:
    return ~(F.nullif(a, F.lit("")).eqNullSafe(F.nullif(b, F.lit(""))) if text else a.eqNullSafe(b))


def diff(current: DataFrame, upload: DataFrame, key: str) -> DataFrame:
    """(key, status, changes): update, insert, unchanged or missing for every key of either side.

    Only columns that the upload has and the table too are compared; '' equals
    null. changes are (column_name, old_value, new_value). One full outer
    join on the key.
    """
    names = [c for c in upload.columns if c != key and c in current.columns]
    text = {n for n, t in current.dtypes if t == "string"}
    a, b = current.alias("a"), upload.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    row = F.array(*[F.when(changed(F.col(f"a.{n}"), F.col(f"b.{n}"), n in text), F.struct(F.lit(n).alias("column_name"), F.col(f"a.{n}").cast("string").alias("old_value"), F.col(f"b.{n}").cast("string").alias("new_value"))) for n in names])
    found = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.col(f"a.{key}").isNull().alias("new_"), F.col(f"b.{key}").isNull().alias("gone_"), F.filter(row, lambda x: x.isNotNull()).alias("changes"))
    status = F.when(F.col("new_"), "insert").when(F.col("gone_"), "missing").when(F.size("changes") > 0, "update").otherwise("unchanged")
    return found.select(key, status.alias("status"), F.when(status == "update", F.col("changes")).alias("changes"))


def unknown_columns(current: DataFrame, upload: DataFrame) -> list[str]:
    return [c for c in upload.columns if c not in current.columns]


def upsert(current: DataFrame, upload: DataFrame, key: str, keep_old_if_null: bool = True) -> DataFrame:
    """current with the rows of upload: known keys are updated in the upload's columns, new keys inserted."""
    names = [c for c in upload.columns if c != key and c in current.columns]
    a, b = current.alias("a"), upload.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    has = F.col(f"b.{key}").isNotNull()

    def value(n: str) -> Column:
        if n == key:
            return F.coalesce(f"a.{key}", f"b.{key}").alias(key)
        if n not in names:
            return F.col(f"a.{n}").alias(n)
        return (F.coalesce(f"b.{n}", f"a.{n}") if keep_old_if_null else F.when(has, F.col(f"b.{n}")).otherwise(F.col(f"a.{n}"))).alias(n)

    return both.select(*[value(n) for n in current.columns])


def inserted(current: DataFrame, upload: DataFrame, key: str) -> DataFrame:
    """Insert what is new and leave the rest alone."""
    return current.unionByName(upload.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def with_history(history: DataFrame, current: DataFrame, touched: DataFrame, key: str, action: str, at: Column) -> DataFrame:
    """history and the rows of current that are about to be touched."""
    old = current.join(touched.select(key).distinct(), key, "left_semi").withColumns({"action": F.lit(action), "changed_at": at})
    return history.unionByName(old, allowMissingColumns=True)


def without(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], pointer: str | None = None) -> dict[str, DataFrame]:
    """Cascade: parents without the gone keys, and each child table without their rows; pointers to gone rows become null."""
    g = gone.select(F.col(key).alias("gone_")).distinct()
    out = parents.join(g, parents[key] == g["gone_"], "left_anti")
    if pointer:
        out = out.join(g, out[pointer] == g["gone_"], "left").withColumn(pointer, F.when(F.col("gone_").isNull(), F.col(pointer))).select(*parents.columns)
    return {"parents": out} | {n: c.join(g, c[k] == g["gone_"], "left_anti") for n, (c, k) in children.items()}


def backfilled(df: DataFrame, values: dict[str, Column], unless: str | None = None) -> DataFrame:
    """df with values where a column is null; with `unless`, with all of them but where that flag holds."""
    keep = (lambda c: F.col(c).isNotNull()) if unless is None else (lambda c: F.coalesce(F.col(unless), F.lit(False)))
    return df.withColumns({c: F.when(keep(c), F.col(c)).otherwise(v) for c, v in values.items()})


def first_values(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: of each column the first value that isn't empty, and the columns on which rows disagree."""
    rank = F.struct(*order)
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()
    aggs = [F.min_by(F.when(some(c), F.col(c)), F.when(some(c), rank)).alias(c) for c in columns]
    text = lambda c: F.when(some(c), F.col(c).cast("string"))
    conflict = F.array(*[F.when(F.min(text(c)) != F.max(text(c)), F.lit(c)) for c in columns])
    return rows.groupBy(key).agg(*aggs, F.filter(conflict, lambda x: x.isNotNull()).alias("conflicts"))


def parents_of(orphans: DataFrame, name: str, role: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A parent for each name among orphan parts: catastrophic if any part is a source or deposit, slow if not."""
    merged = first_values(orphans, name, order, columns)
    kind = orphans.groupBy(name).agg(F.when(F.bool_or(F.col(role).isin("source", "deposit")), "catastrophic").otherwise("slow").alias("kind"), F.count(F.lit(1)).alias("n_parts"))
    return merged.join(kind, name)


def collision(iou: Column, name_key_a: Column, name_key_b: Column, name_a: Column, name_b: Column) -> Column:
    """What to do with an upload that meets a stored record: update, block, review, or null."""
    return F.when(iou >= SAME_SHAPE, "update").when(name_a == name_b, "block").when((name_key_a == name_key_b) | (iou > MAYBE_SHAPE), "review")


def duplicate_names(df: DataFrame, id_col: str, key: Column, live: Column) -> DataFrame:
    """(name_key, ids) of live records that share a normalised name."""
    return df.where(live).groupBy(key.alias("name_key")).agg(F.sort_array(F.collect_list(id_col)).alias("ids")).where(F.size("ids") > 1)


#: A last word that tells a time, and words that tie a name weakly: fixed values.
TIME_WORD = r"^(\d{4}|holocene|modern)(\.\d+)?\z"
WEAK_WORD = r"(?i)\b(trib(?:utary)?|neighbou?r)\b"


def name_reasons(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """(id, reason): why a name should be looked at; the first of four scans wins.

    A base name is one that begins another's, unless what follows tells it
    apart on purpose: a time, a number, or ~. The smallest such id decides.
    """
    from .relational import next_words

    on_purpose = F.col("extra").rlike(TIME_WORD) | F.col("extra").rlike(r"^\d+\z") | (F.col("extra") == "~")
    kind = F.when(F.col("extra").rlike(r"^[a-z]\z") & F.col("tail").rlike(TIME_WORD), "first of repeats").otherwise("base of another name")
    base = next_words(df, id_col, name).where(~on_purpose).groupBy("short_id").agg(F.min_by(kind, "long_id").alias("base_"))
    words = F.split(F.lower(F.trim(F.col(name))), r"\s+")
    letter = F.exists(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i - 1).alias("p"))), lambda x: F.coalesce(x["w"].rlike(r"^[a-z]\z") & x["p"].rlike(TIME_WORD), F.lit(False)))
    out = df.join(base, df[id_col] == base["short_id"], "left")
    reason = F.coalesce(F.when(F.col(name).rlike(WEAK_WORD), "weakly tied"), F.when(F.array_contains(words, "x"), "lone x"), F.col("base_"), F.when(letter, "letter after a time"))
    return out.select(F.col(id_col), reason.alias("reason"))


def flag_updates(df: DataFrame, reasons: Sequence[Column], flagged: str = "flagged", reason: str = "flag_reason", overwrite: bool = False) -> DataFrame:
    """df with flags set where a scan gives a reason: the first scan wins, and a reason that is there stays."""
    first = F.coalesce(*reasons)
    return df.withColumn("new_", first).withColumns({flagged: F.coalesce(flagged, F.lit(False)) | F.col("new_").isNotNull(), reason: F.col("new_") if overwrite else F.coalesce(reason, "new_")}).drop("new_")
