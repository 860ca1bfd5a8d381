"""Harmonics of monthly series per cell, each fitted to what the ones before leave, as rounds of sums.

A harmonic is kept if even and odd years agree on it, if the one before was
kept, if it decays, and if all together stay plausible beside the mean speed.
A round sums the residuals of each cell by halves and joins the harmonic back;
a cell has as many rows as there are months, so nothing in a group grows with
the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import moving_average

# Results must equal those of the method.
AGREE_COS = (0.60, 0.78, 0.88)
AGREE_RATIO, LEAST_AMP, DECAY, TOTAL_SHARE = 2.5, 3.0, 0.7, 0.6
HALF_WINDOW = 6

_PARTS = ("xc", "xs", "yc", "ys")


def _size(names: Sequence[str]) -> Column:
    return F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])))


def harmonics(series: DataFrame, cell: Sequence[str], month: str, t: str, k_max: int = 3) -> DataFrame:
    """(cell, speed, and for each k: kept_k, xc_k, xs_k, yc_k, ys_k, explained_k) of the cells whose series (cell, month, t, vx, vy) is whole.

    A series has one row per month; it is whole if it has both components in
    every month that the table has. What varies over longer times is taken off
    first, by a centred mean of 13 months. Coefficients of a harmonic that
    isn't kept are 0; explained_k is the share of the variance that the kept
    ones up to k explain, null if there is none.
    """
    keys, n = list(cell), series.select(month).distinct().count()
    both = F.col("vx").isNotNull() & F.col("vy").isNotNull()
    whole = series.groupBy(*keys).agg(F.count_if(both).alias("n_"), F.hypot(F.avg("vx"), F.avg("vy")).alias("speed")).where(F.col("n_") == n).drop("n_")
    rows = series.join(whole.select(*keys), keys, "left_semi").select(*keys, month, F.col(t).alias("t"), "vx", "vy")
    for v in ("x", "y"):
        rows = moving_average(rows, keys, month, f"v{v}", HALF_WINDOW).withColumn(f"r{v}", F.col(f"v{v}") - F.col("smooth")).drop("smooth")
    rows = rows.select(*keys, "t", "rx", "ry", F.pmod(F.floor("t"), F.lit(2)).alias("odd"))
    power = F.sum(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))
    state = whole.join(rows.groupBy(*keys).agg(power.alias("all_")), keys).withColumns({"before_": F.lit(float("inf")), "total_": F.lit(0.0)})
    for k in range(1, k_max + 1):
        c, s = F.cos(2 * math.pi * k * F.col("t")), F.sin(2 * math.pi * k * F.col("t"))
        product = {"xc": F.col("rx") * c, "xs": F.col("rx") * s, "yc": F.col("ry") * c, "ys": F.col("ry") * s, "cc": c * c}
        sums = rows.groupBy(*keys).agg(*[F.sum(F.when(F.col("odd") == h, v).otherwise(0.0)).alias(f"{p}{h}") for p, v in product.items() for h in (0, 1)])
        half = sums.select(*keys, *[(F.col(f"{p}{h}") / F.nullif(F.col(f"cc{h}"), F.lit(0.0))).alias(f"{p}{h}") for p in _PARTS for h in (0, 1)], *[((F.col(f"{p}0") + F.col(f"{p}1")) / F.nullif(F.col("cc0") + F.col("cc1"), F.lit(0.0))).alias(p) for p in _PARTS])
        one, two, amp = _size([f"{p}0" for p in _PARTS]), _size([f"{p}1" for p in _PARTS]), _size(_PARTS)
        cos = sum((F.col(f"{p}0") * F.col(f"{p}1") for p in _PARTS[1:]), F.col("xc0") * F.col("xc1")) / F.greatest(one * two, F.lit(1e-9))
        kept = (cos > AGREE_COS[min(k, len(AGREE_COS)) - 1]) & (F.greatest(one, two) / F.greatest(F.least(one, two), F.lit(1e-9)) < AGREE_RATIO) & (F.col("amp_") > LEAST_AMP)
        if k > 1:
            kept = kept & F.col(f"kept_{k - 1}") & (F.col("amp_") < DECAY * F.col("before_")) & (F.col("total_") + F.col("amp_") < F.greatest(F.lit(2 * LEAST_AMP), TOTAL_SHARE * F.col("speed")))
        state = state.join(half.withColumn("amp_", amp), keys).withColumn(f"kept_{k}", F.coalesce(kept, F.lit(False)))
        on = F.col(f"kept_{k}")
        state = state.withColumns({f"{p}_{k}": F.when(on, F.col(p)).otherwise(0.0) for p in _PARTS} | {"before_": F.when(on, F.col("amp_")).otherwise(F.col("before_")), "total_": F.col("total_") + F.when(on, F.col("amp_")).otherwise(0.0)}).drop("amp_", *_PARTS, *[f"{p}{h}" for p in _PARTS for h in (0, 1)])
        fit = rows.join(state.select(*keys, *[f"{p}_{k}" for p in _PARTS]), keys)
        rows = fit.select(*keys, "t", (F.col("rx") - F.col(f"xc_{k}") * c - F.col(f"xs_{k}") * s).alias("rx"), (F.col("ry") - F.col(f"yc_{k}") * c - F.col(f"ys_{k}") * s).alias("ry"), "odd")
        left = rows.groupBy(*keys).agg(power.alias("left_"))
        state = state.join(left, keys).withColumn(f"explained_{k}", 1 - F.col("left_") / F.nullif(F.col("all_"), F.lit(0.0))).drop("left_")
    return state.drop("all_", "before_", "total_")
