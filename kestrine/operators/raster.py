"""Grids as rows (tile, i, j, v): blocks, neighbourhoods, sampling and tiles. Null is no data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import col
from .relational import percentiles


def block_mean(df: DataFrame, value: str, tile: str = "tile", size: int = 2) -> DataFrame:
    """(tile, bi, bj, mean): mean over a block of the means of its rows; nulls are left out."""
    rows = df.groupBy(tile, F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"), (F.col("i") % size).alias("r_")).agg(F.avg(value).alias("m_"))
    return rows.groupBy(tile, "bi", "bj").agg(F.avg("m_").alias("mean"))


def block_max(df: DataFrame, value: str, tile: str = "tile", size: int = 2) -> DataFrame:
    """(tile, bi, bj, most): largest value of a block; null where no cell has one."""
    return df.groupBy(tile, F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj")).agg(F.max(value).alias("most"))


def neighbourhoods(df: DataFrame, radius: int, tile: str = "tile", value: str = "v") -> DataFrame:
    """df (tile, i, j, value) with near: array of (v, d2), the values in the square of `radius` around each cell, and their squared distances.

    Cells go to chunks of some four radii a side, and those near a border to
    the chunks beyond it as well: one shuffle, of about two rows per cell
    whatever the radius. Windows are then cut out of the chunk's rows. Null
    values are no one's neighbour; a cell is one of its own.
    """
    size = max(16, 4 * radius)
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / size), F.floor((F.col(c) + radius) / size)))
    sent = df.withColumn("ci_", reach("i")).withColumn("cj_", reach("j"))
    own = (F.col("ci_") == F.floor(F.col("i") / size)) & (F.col("cj_") == F.floor(F.col("j") / size))
    chunk = [tile, "ci_", "cj_"]
    cells = sent.select(*chunk, "i", F.when(F.col(value).isNotNull(), F.struct("j", F.col(value).cast("double").alias("v"))).alias("c_"), F.when(own, F.struct(*df.columns)).alias("m_")).repartition(*chunk)
    rows = cells.groupBy(*chunk, "i").agg(F.collect_list("c_").alias("cells"), F.collect_list("m_").alias("mine_"))
    whole = rows.groupBy(*chunk).agg(F.collect_list(F.struct("i", "cells")).alias("rows_"), F.flatten(F.collect_list("mine_")).alias("mine_"))
    m = whole.select("rows_", F.explode("mine_").alias("m"))
    i, j = F.col("m.i"), F.col("m.j")
    in_row = lambda r: F.transform(F.filter(r["cells"], lambda c: F.abs(c["j"] - j) <= radius), lambda c: F.struct(c["v"].alias("v"), ((c["j"] - j) * (c["j"] - j) + (r["i"] - i) * (r["i"] - i)).alias("d2")))
    return m.select("m.*", F.flatten(F.transform(F.filter("rows_", lambda r: F.abs(r["i"] - i) <= radius), in_row)).alias("near"))


def _mean(near: str, weight) -> Column:
    """Mean of the values of a neighbourhood under weight(x); null if it is empty."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))
    weighed = F.transform(near, lambda x: F.struct(weight(x).alias("w"), x["v"].alias("v")))
    return F.aggregate(weighed, zero, lambda t, x: F.struct((t["w"] + x["w"]).alias("w"), (t["s"] + x["w"] * x["v"]).alias("s")), lambda t: t["s"] / F.nullif(t["w"], F.lit(0.0)))


def bilateral(df: DataFrame, radius: int = 4, sigma_px: float = 2.0, sigma_v: float = 1.0, tile: str = "tile", value: str = "v") -> DataFrame:
    """df (tile, i, j, value) with filtered: edge-keeping mean; weights fall with distance and with difference of value. No data stays so."""
    own = F.col(value).cast("double")
    weight = lambda x: F.exp(-x["d2"] / (2.0 * sigma_px * sigma_px) - (x["v"] - own) * (x["v"] - own) / (2.0 * sigma_v * sigma_v))
    return neighbourhoods(df, radius, tile, value).withColumn("filtered", F.when(own.isNotNull(), _mean("near", weight))).drop("near")


def idw_fill(df: DataFrame, radius: int = 6, least: int = 3, tile: str = "tile", value: str = "v", stale: str | None = None) -> DataFrame:
    """df (tile, i, j, value) with filled: own value, or the mean by inverse squared distance of at least `least` cells of the square around.

    Cells marked in the column `stale` stay empty: what they had has ended.
    """
    open_ = F.size("near") >= least
    if stale:
        open_ = open_ & ~F.coalesce(F.col(stale), F.lit(False))
    around = _mean("near", lambda x: 1 / F.greatest(F.lit(0.25), x["d2"]))
    return neighbourhoods(df, radius, tile, value).withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(open_, around)).drop("near")


def window_percentile(df: DataFrame, radius: int, share: float, least_share: float = 0.15, tile: str = "tile", value: str = "v") -> DataFrame:
    """df (tile, i, j, value) with context: an interpolated percentile of the square around, null where too few cells have a value."""
    few = least_share * (2 * radius + 1) ** 2
    place = (F.size("s_") - 1) * F.lit(share)
    low, high = F.get("s_", F.floor(place).cast("int")), F.get("s_", F.ceil(place).cast("int"))
    ranked = neighbourhoods(df, radius, tile, value).withColumn("s_", F.array_sort(F.transform("near", lambda x: x["v"]))).drop("near")
    return ranked.withColumn("context", F.when(F.size("s_") > few, low + (high - low) * (place - F.floor(place)))).drop("s_")


def bilinear(points: DataFrame, grid: DataFrame, ids: Sequence[str], tile: str = "tile", value: str = "v") -> DataFrame:
    """points (tile, x, y in cells) with sampled: mean of the four corners by nearness, of those that have a value; null if they weigh 0.05 or less."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    x, y = F.floor("x"), F.floor("y")
    wx, wy = F.when(F.col("c.a") == 1, F.col("x") - x).otherwise(1 - (F.col("x") - x)), F.when(F.col("c.b") == 1, F.col("y") - y).otherwise(1 - (F.col("y") - y))
    p = points.select(*ids, tile, "x", "y", F.explode(corners).alias("c")).select(*ids, tile, (x + F.col("c.a")).alias("j"), (y + F.col("c.b")).alias("i"), (wx * wy).alias("w_"))
    got = p.join(grid.where(F.col(value).isNotNull()).select(tile, "i", "j", F.col(value).alias("v_")), [tile, "i", "j"]).groupBy(*ids).agg(F.when(F.sum("w_") > 0.05, F.sum(F.col("w_") * F.col("v_")) / F.sum("w_")).alias("sampled"))
    return points.join(got, list(ids), "left")


def stretch(df: DataFrame, keys: Sequence[str], value: str = "v", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """df with level 0..255 between the percentiles of each band."""
    p = percentiles(df, keys, value, [low, high]).select(*keys, F.col("at").alias("p_"))
    a, b = F.get("p_", F.lit(0)), F.get("p_", F.lit(1))
    level = F.when((b > a) & F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(value) - a) / (b - a) * 255)))
    return df.join(p, list(keys), "left").withColumn("level", F.round(level)).drop("p_")


def tile_pyramid(points: DataFrame, lon: str, lat: str, zooms: range) -> DataFrame:
    """(z, x, y, n): counts per tile of each zoom. Each zoom is summed from the next deeper one, so rows are read once."""
    from ..functions.scalars import tile_x, tile_y

    z = zooms[-1]
    level = points.groupBy(tile_x(lon, F.lit(z)).alias("x"), tile_y(lat, F.lit(z)).alias("y")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(z).alias("z"), "x", "y", "n")
    out = level
    for z in reversed(zooms[:-1]):
        level = level.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.sum("n").alias("n")).select(F.lit(z).alias("z"), "x", "y", "n")
        out = out.unionByName(level)
    return out


def fade(value, first, last, t, years: float = 1.0) -> Column:
    """value, falling to 0 over `years` outside [first, last]."""
    out = F.greatest(F.lit(0.0), F.greatest(col(first) - col(t), col(t) - col(last)))
    return col(value) * F.greatest(F.lit(0.0), 1 - out / years)
