"""Particles on a grid: how many a cell has, and snapshots of their states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def managed(particles: DataFrame, cells: DataFrame, keys: Sequence[str], least: int, most: int, slack: int = 1, seed: int = 7) -> DataFrame:
    """Particles (keys, id, age) brought to between least and most per cell: the newest surplus retires, and ids are spawned at hashed places.

    A cell retires only once it has over most + slack, so that one at the
    bound doesn't lose and gain in turn.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("age"), "id")
    numbered = particles.withColumns({"rn_": F.row_number().over(w), "all_": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    kept = numbered.where((F.col("all_") <= most + slack) | (F.col("rn_") <= most)).drop("rn_", "all_")
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    short = cells.join(n, list(keys), "left").withColumn("miss_", least - F.coalesce("n_", F.lit(0))).where("miss_ > 0").withColumn("k_", F.explode(F.sequence(F.lit(1), F.col("miss_").cast("int"))))
    unit = lambda salt: F.pmod(F.xxhash64(*keys, "k_", F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    new = short.select(*keys, (-F.abs(F.xxhash64(*keys, "k_", F.lit(seed)) % (1 << 40)) - 1).alias("id"), F.lit(0.0).alias("age"), unit("x").alias("fx"), unit("y").alias("fy"))
    return kept.unionByName(new, allowMissingColumns=True)


def keyframes(states: DataFrame, at: str, every: float, most: int, now: float) -> DataFrame:
    """Snapshots on a grid of times, the `most` nearest to now."""
    on = states.where(F.abs(F.col(at) / every - F.round(F.col(at) / every)) < 1e-6)
    times = on.select(at).distinct().orderBy(F.abs(F.col(at) - now), at).limit(most)
    return on.join(times, at, "left_semi")
