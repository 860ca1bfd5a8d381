"""Weighted rendezvous hashing of record keys over shards.

Each shard draws a score from the key and its own name, -weight / ln(u); the
highest wins. A shard that is added takes rows only into itself, and a shard
that goes gives only its own rows away.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .mixing import coin

#: Rows of a slice within a shard in which slots are counted, on average.
SLICE_ROWS = 20_000


def rendezvous(key: Column, shards: Sequence[int] | Mapping[int, float], seed: str = "shard") -> Column:
    """The shard of a key; shards may have weights. A null key is a key like any other."""
    weighted = shards if isinstance(shards, Mapping) else dict.fromkeys(shards, 1.0)
    draws = []
    for s, weight in weighted.items():
        u = coin(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"@{s}")), seed) + F.lit(0.5 / (1 << 52))
        draws.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(int(s)).alias("shard")))
    return F.array_max(F.array(*draws))["shard"]


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with slot long, gapless from 0 within each shard.

    Places are counted in slices of a shard, by a hash of the order columns,
    and a slice starts where the slices before it end; so a shard's rows
    don't meet in one task.
    """
    rows = cut(rows)
    slices = max(1, rows.count() // slice_rows)
    keyed = rows.withColumn("slice_", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    sizes = keyed.groupBy(shard, "slice_").agg(F.count(F.lit(1)).alias("n_"))
    start = F.coalesce(F.sum("n_").over(Window.partitionBy(shard).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(shard, "slice_", start.alias("start_"))
    place = F.row_number().over(Window.partitionBy(shard, "slice_").orderBy(*order)) - 1
    return keyed.withColumn("place_", place).join(starts, [shard, "slice_"]).withColumn("slot", (F.col("start_") + F.col("place_")).cast("long")).drop("slice_", "place_", "start_")


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, size, text_crc32, shard, grown_shard, slot) per row of docs.

    size is the UTF-8 bytes of the text (null: none) plus 1; grown_shard is
    the shard with one shard more. Rows that repeat an id go to the same
    shard and get slots of their own; null ids share a shard; an empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.col("doc_id")
    rows = rows.withColumns({"shard": rendezvous(key, range(shards)), "grown_shard": rendezvous(key, range(shards + 1))})
    return with_slots(rows, "shard", ["doc_id", "size", "text_crc32"])


def write_shards(docs: DataFrame, path: str, shards: int | Mapping[int, float] = 8, id_col: str = "doc_id") -> None:
    """Writes docs as Parquet, a folder for each shard, with all their columns. The folders are named shard_no=..., with more underscores if docs has such a column."""
    names = range(shards) if isinstance(shards, int) else shards
    folder = "shard_no"
    while folder.lower() in {c.lower() for c in docs.columns}:
        folder += "_"
    docs.withColumn(folder, rendezvous(F.col(id_col), names)).write.partitionBy(folder).parquet(path)
