"""Mixing sources to target weights by whole repetitions and a seeded coin.

Sizes are summed per source, each source gets a target, and rate = target /
size of the source. A document is emitted floor(rate) times, and once more if
its coin falls below the fraction rate - floor(rate). A coin is uniform in
[0, 1) from a hash of the seed, so over seeds every document gets its extra
copy with probability equal to the fraction; nothing is chosen by its outcome.

The coins of a source's long documents, those of over 1 / LONG_SHARE of its
size (so fewer than LONG_SHARE of them), share one hash and are spread evenly
in order of size: among neighbours in size the fraction of them gets a copy.
All other documents have a coin of their own. So a few very long documents
can't carry a source far from its target, and the others deviate by
1 / (2 * sqrt(LONG_SHARE)) of the source's size at most (standard deviation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights of the sources in order of code point, null last; they repeat.
WEIGHTS = (1, 2, 3)
#: A document is long if it has over 1 / LONG_SHARE of its source's words.
LONG_SHARE = 10_000
#: Up to so many rows a table of sources or of long documents is sent to every task; beyond, it is joined by shuffle.
BROADCAST_ROWS = 250_000
#: No source is repeated more often than this.
MOST = 3


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: str) -> Column:
    """Uniform in [0, 1) with 52 bits from the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with rank_, their place by code point, null last, from 0.

    Sources are cut into ranges by Spark; a rank is the number of sources in
    earlier ranges, of which there are as many as shuffle partitions, plus the
    place in the own one.
    """
    order = [F.col("source").isNull(), F.col("source")]
    cut_up = cut(sources.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    before, offsets = 0, {}
    for r in sorted(cut_up.groupBy("range_").count().collect()):
        offsets[r.range_], before = before, before + r["count"]
    if not offsets:
        return cut_up.select("*", F.lit(0).alias("rank_")).drop("range_")
    starts = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return cut_up.withColumn("rank_", F.element_at(starts, F.col("range_")) + place).drop("range_")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with target: the total shared by weight, at most `most` times a source's size.

    What a source can't take is shared by weight among the others, until none
    is above. Each round fixes the sources above their bound and needs three
    sums of the driver.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank_") % len(weights) + 1).cast("int"))
    table = cut(ranked(sizes).withColumn("weight", w))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("source_size") * most if full >= 0 else F.lit(False)
        n, taken, open_weight = table.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == full or not open_weight:
            break
        level, full = float(total - taken) / float(open_weight), n
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(level), (F.col("source_size") * most).cast("double")).alias("target"))


def _rate() -> Column:
    return F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))


def rates(slim: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) of slim (id, source, size). Sums are combined before the shuffle."""
    sizes = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    return _sent(cut(sizes.withColumn("rate", _rate())))


def spread(slim: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """(source, id, spread): the coins of long documents. One hash per source, moved on by the rate from each to the next in order of size.

    Of n in a row floor or ceil of n times the fraction fall below the
    fraction. Rows that repeat an id within a source share its coin.
    """
    long = _joined(slim, sources).where(F.col("size") * LONG_SHARE > F.col("source_size")).groupBy("source", "id", "rate").agg(F.max("size").alias("size"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), F.asc_nulls_last("id"))) - 1
    at = coin(F.col("source"), f"{seed} source") - place * F.col("rate")
    return _sent(cut(long.select("source", "id", (at - F.floor(at)).alias("spread"))))


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _joined(rows: DataFrame, table: DataFrame, *more: str) -> DataFrame:
    """rows with the columns of their source's row in table, or of that which agrees in the columns `more` too; without one, nulls."""
    keys = ("source", *more)
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return rows.alias("d").join(table.alias("s"), on, "left").select("d.*", *(f"s.{c}" for c in table.columns if c not in keys))


def _times(rows: DataFrame, slim: DataFrame, seed: str, weights: Sequence[float], most: float, name: str = "times") -> DataFrame:
    """rows (id, source, ...) with source_size, target and how often each is taken."""
    sources = rates(slim, weights, most)
    tossed = _joined(_joined(rows, sources), spread(slim, sources, seed), "id")
    u = F.coalesce("spread", coin(F.col("id"), seed))
    return tossed.withColumn(name, (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")).drop("rate", "spread")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))


def copies(docs: DataFrame, seed: str = "mix", weights: Sequence[float] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row (id, source, size, source_size, target, times) per row of docs.

    Null and empty texts have size 0, null sources are one source, sources
    without words have rate 0 and are never emitted; rows that repeat an id
    within a source share a coin; very long texts are counted whole; an empty
    table gives an empty result; other columns are ignored.
    """
    slim = sized(docs, id_col, source_col, text_col)
    return _times(slim, slim, seed, weights, most)


def mix(docs: DataFrame, seed: str = "mix", weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """docs (doc_id, source, text and more) with every row as often as copies() takes it; the columns are those of docs, whatever their names.

    The last pass reads ids and sources for the coins; texts only pass by.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row_"), F.col("doc_id").alias("id"), F.col("source").alias("source"))
    out = _times(rows, sized(docs), seed, weights, most).where("times > 0")
    return out.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy_")).select("row_.*")
