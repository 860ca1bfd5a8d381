"""Composites, fits by normal equations and models of observations per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import col

YEAR = 365.25
MAD = 1.4826


def circular_mean(doy, period: float = YEAR) -> Column:
    """Mean day of year on a circle."""
    a = col(doy) * (2 * 3.141592653589793 / period)
    return F.pmod(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))) * (period / (2 * 3.141592653589793)), F.lit(period))


def median_composite(df: DataFrame, keys: Sequence[str], value: str, least: int = 3) -> DataFrame:
    """(keys, median, n); the median is null below `least` observations."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("m_")).select(*keys, F.when(F.col("n") >= least, F.col("m_")).alias("median"), "n")


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str, least: int = 8, floor: float = 0.0) -> DataFrame:
    """(keys, median, mad): the scaled median of distances from the median, joined back and taken again."""
    med = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.count(value).alias("n")).where(F.col("n") >= least)
    return df.join(med, list(keys)).groupBy(*keys).agg(F.first("median").alias("median"), F.greatest(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5) * MAD, F.lit(floor)).alias("mad"))


def first_bin_below(stats: DataFrame, cell: Sequence[str], at: str) -> DataFrame:
    """(cell, cap): the first bin after the cell's first whose median is under the first's median less its MAD; null if none."""
    w = Window.partitionBy(*cell).orderBy(at)
    ref = stats.withColumn("low_", F.first(F.col("median") - F.col("mad")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ref.groupBy(*cell).agg(F.min(F.when(F.col("median") < F.col("low_"), F.col(at))).alias("cap"))


def moving_average(df: DataFrame, keys: Sequence[str], at: str, value: str, half: int = 6) -> DataFrame:
    """df with smooth: centred mean of 2 * half + 1 rows in which the ends stand in for what lies beyond."""
    w = Window.partitionBy(*keys).orderBy(at)
    around = w.rowsBetween(-half, half)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, i = F.count(F.lit(1)).over(all_), F.row_number().over(w)
    before, after = F.greatest(F.lit(0), half - i + 1), F.greatest(F.lit(0), half - (n - i))
    total = F.sum(value).over(around) + before * F.first(value).over(all_) + after * F.last(value).over(all_)
    return df.withColumn("smooth", total / (2 * half + 1))


def interval_design(t1, t2, reference: float) -> tuple[Column, Column, Column]:
    """Mean of t - reference, cos 2 pi t and sin 2 pi t over [t1, t2], exactly."""
    tau = 2 * 3.141592653589793
    dt = F.greatest(col(t2) - col(t1), F.lit(1e-9))
    return (col(t1) + col(t2)) / 2 - reference, (F.sin(tau * col(t2)) - F.sin(tau * col(t1))) / (tau * dt), (F.cos(tau * col(t1)) - F.cos(tau * col(t2))) / (tau * dt)


def normal_equations(df: DataFrame, keys: Sequence[str], columns: Sequence[Column], value, weight) -> DataFrame:
    """(keys, ata array, atb array, n): sums of weighted products, combined before the shuffle; ata is row by row."""
    cs = [F.lit(1.0), *columns]
    x = df.select(*keys, *[c.alias(f"c{i}") for i, c in enumerate(cs)], col(value).alias("v_"), col(weight).alias("w_"))
    k = len(cs)
    pair = lambda i, j: F.sum(F.col("w_") * F.col(f"c{min(i, j)}") * F.col(f"c{max(i, j)}"))
    sums = x.groupBy(*keys).agg(*[pair(i, j).alias(f"a{i}{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col("w_") * F.col(f"c{i}") * F.col("v_")).alias(f"b{i}") for i in range(k)], F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, F.array(*[f"a{min(i, j)}{max(i, j)}" for i in range(k) for j in range(k)]).alias("ata"), F.array(*[f"b{i}" for i in range(k)]).alias("atb"), "n")


def ridge_solve(equations: DataFrame, damping: Sequence[float] | None = None, ridge: float = 1e-6) -> DataFrame:
    """equations with coef: solutions with a small ridge in proportion to the mean of the diagonal, and extra damping per column; null if singular.

    Elimination with column pivots on the rows of (ata | atb), as one fold.
    """
    k = F.size("atb")
    each = F.sequence(F.lit(0), k - 1)
    trace = F.aggregate(each, F.lit(0.0), lambda s, i: s + F.get("ata", i * k + i))
    extra = F.array(*[F.lit(float(d)) for d in damping]) if damping is not None else F.transform(each, lambda _: F.lit(0.0))
    more = lambda i, j: F.when(i == j, F.lit(ridge) * F.col("t_") / k + F.get("d_", i)).otherwise(0.0)
    rows = F.transform(each, lambda i: F.concat(F.transform(each, lambda j: F.get("ata", i * k + j) + more(i, j)), F.array(F.get("atb", i))))

    def eliminate(m: Column, c: Column) -> Column:
        size = lambda r: F.abs(F.get(F.get(m, r), c))
        best = F.array_max(F.transform(F.sequence(c, k - 1), lambda r: F.struct(size(r).alias("size"), (-r).alias("r"))))

        def step(p: Column) -> Column:
            pivot = F.get(m, p)
            by = F.when(F.get(pivot, c) == 0, F.lit(float("nan"))).otherwise(F.get(pivot, c))
            scaled = F.transform(pivot, lambda v: v / by)
            swapped = F.transform(m, lambda row, r: F.when(r == c, scaled).when(r == p, F.get(m, c)).otherwise(row))
            return F.transform(swapped, lambda row, r: F.when(r == c, row).otherwise(F.transform(row, lambda v, j: v - F.get(row, c) * F.get(scaled, j))))

        return F.element_at(F.transform(F.array(-best["r"]), step), 1)

    prepared = equations.withColumns({"t_": trace, "d_": extra}).withColumn("m_", rows)
    solved = prepared.withColumn("m_", F.aggregate(each, F.col("m_"), eliminate))
    return solved.withColumn("coef", F.when(~F.exists("m_", lambda r: F.isnan(F.element_at(r, -1))), F.transform("m_", lambda r: F.element_at(r, -1)))).drop("t_", "d_", "m_")


def verdict(residual, sigma, z: float = 3.0) -> Column:
    """0 without a model, 1 if within z sigmas, 2 beyond."""
    return F.when(col(residual).isNull(), 0).when(F.abs(col(residual)) <= z * col(sigma), 1).otherwise(2)


def pair_sigma(dt_days, sensors: Sequence, floor: float = 20.0, slow: dict[str, float] | None = None) -> Column:
    """Error of a displacement over dt days, wider by the largest factor of a prefix that one of its sensors has. floor is each source's own."""
    base = F.greatest(F.lit(floor), F.lit(25.5 * YEAR) / F.greatest(col(dt_days), F.lit(1.0)))
    factor = F.lit(1.0)
    for prefix, wider in (slow or {}).items():
        met = F.lit(False)
        for sensor in sensors:
            met = met | F.coalesce(F.startswith(col(sensor), F.lit(prefix)), F.lit(False))
        factor = F.greatest(factor, F.when(met, F.lit(float(wider))).otherwise(1.0))
    return base * factor


def yearly_context(df: DataFrame, keys: Sequence[str], at, value: str, dt_days: str, most_days: float, least: int = 3) -> DataFrame:
    """(keys, year, mean, n): mean of the pairs of at most most_days per year; null below `least`."""
    short = df.where(F.col(dt_days) <= most_days).groupBy(*keys, F.floor(col(at)).cast("int").alias("year")).agg(F.avg(value).alias("m_"), F.count(value).alias("n"))
    return short.select(*keys, "year", F.when(F.col("n") >= least, F.col("m_")).alias("mean"), "n")


def season_of(c, s) -> tuple[Column, Column]:
    """Amplitude of a season c cos + s sin, and the day of year of its crest."""
    day = F.pmod(F.atan2(col(s), col(c)) / (2 * 3.141592653589793) * YEAR, F.lit(YEAR))
    return F.hypot(col(c), col(s)), F.when((col(c) != 0) | (col(s) != 0), day)


def interpolated(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """(keys, at, n): the value at a share of a key's sorted values, between two neighbours mixed with one rounding, as SQL's quantile_cont is; n counts nulls too.

    A mix rounded twice may fall short of a limit that the exact one reaches.
    A key's different values meet in one row, with their counts.
    """
    each = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_"))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).cast("double").alias("v"), F.col("n_").alias("n")))
    s = each.groupBy(*keys).agg(F.sum("n_").alias("n"), F.sort_array(F.collect_list(known)).alias("s_"))
    placed = s.withColumn("place_", (F.aggregate("s_", F.lit(0).cast("long"), lambda t, x: t + x["n"]) - 1) * F.lit(share))
    none = F.lit(None).cast("double")

    def step(t: Column, x: Column) -> Column:
        to = t["to"] + x["n"]
        pick = lambda old, at: F.when((t["to"] <= at("place_")) & (at("place_") < to), x["v"]).otherwise(old)
        return F.struct(to.alias("to"), pick(t["a"], F.floor).alias("a"), pick(t["b"], F.ceil).alias("b"))

    ends = placed.withColumn("e_", F.aggregate("s_", F.struct(F.lit(0).cast("long").alias("to"), none.alias("a"), none.alias("b")), step)).select(*keys, "n", "e_.a", "e_.b", (F.col("place_") - F.floor("place_")).alias("f_"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mixed = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), zero(F.col("a")), 1 - F.col("f_"), zero(F.col("b")) * F.col("f_")).cast("double")
    return ends.select(*keys, F.when(F.col("f_") == 0, F.col("a")).when(F.col("a").isNotNull(), mixed).alias("at"), "n")


def context_screen(value, context, fast: float, share: float) -> Column:
    """False for a slow value where its surroundings are fast: under `share` of a context of `fast` or more. Without context, true; null for no value among fast ones."""
    return F.coalesce(col(context) < fast, F.lit(True)) | ~(col(value) < share * col(context))


def model_value(coef: Column, t: Column, first: Column, last: Column, reference: float, slack: float = 0.5) -> Column:
    """level + trend + season at t; the trend stands still beyond the window, and beyond its slack there is no value."""
    tau = 2 * 3.141592653589793
    c = lambda i: F.get(coef, F.lit(i))
    inside = F.greatest(first, F.least(last, t))
    return F.when(t.between(first - slack, last + slack), c(0) + c(1) * (inside - reference) + c(2) * F.cos(tau * t) + c(3) * F.sin(tau * t))


def blend(df: DataFrame, keys: Sequence[str], year: str, value: str, at: str) -> DataFrame:
    """df with blended: linear between the middles of adjacent years; the row's own value if no next year follows at once."""
    w = Window.partitionBy(*keys).orderBy(year)
    nxt, ny = F.lead(value).over(w), F.lead(year).over(w)
    f = col(at) - (F.col(year) + 0.5)
    return df.withColumn("blended", F.when((ny == F.col(year) + 1) & nxt.isNotNull() & f.between(0, 1), F.col(value) * (1 - f) + nxt * f).otherwise(F.col(value)))
