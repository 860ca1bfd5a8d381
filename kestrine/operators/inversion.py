"""Monthly series of cells from pairs that each give a mean over an interval.

A pair is a row of shares of months. Spark sums their products by cell, month
and distance of months, which is a band matrix of fixed size per cell; the
bands of many cells are eliminated at once by numpy, month after month, with
the absolute differences of months held down by reweighting. Weights of pairs
come from residuals of the last series, as rounds of sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .relational import percentiles
from .timeseries import MAD, first_bin_below

# Results must equal those of the method.
LEAST_PAIRS, LEAST_IN_BIN = 30, 8
SMOOTH, INNER, OUTER = 0.35, 6, 3
STILL = 5.0
TUKEY, TOL_FLOOR, TOL_SHARE, ALONG = 3.0, 25.0, 0.35, 1.6
BINS, CAP_LEAST = (0.0, 16.0, 32.0, 64.0, 128.0, 256.0), 32.0

SALTS = 16
#: Cells whose bands are eliminated together; bounds what numpy holds.
BLOCK = 256


def month_shares(t1, t2, since: float, months: int, step: float = 1 / 12) -> Column:
    """Array of (m, s): the share s of [t1, t2] that lies in month m, of those from `since` on; what lies outside is in none."""
    a, b = F.col(t1), F.col(t2)
    first = F.greatest(F.lit(0), F.floor((a - since) / step)).cast("int")
    last = F.least(F.lit(months - 1), F.floor((b - since) / step)).cast("int")
    overlap = lambda m: F.least(b, since + (m + 1) * step) - F.greatest(a, since + m * step)
    each = F.transform(F.sequence(first, last), lambda m: F.struct(m.alias("m"), (overlap(m) / F.greatest(b - a, F.lit(1e-9))).alias("s")))
    return F.when(first <= last, F.filter(each, lambda x: x["s"] * F.greatest(b - a, F.lit(1e-9)) > 1e-9)).otherwise(F.array().cast("array<struct<m:int,s:double>>"))


def eliminate(band: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solutions of symmetric band systems: band is (systems, months, width), its first column the diagonal, then what lies right of it."""
    u, y = band.copy(), rhs.copy()
    n, width = u.shape[1:]
    for k in range(n):
        for p in range(1, min(width, n - k)):
            f = u[:, k, p] / u[:, k, 0]
            u[:, k + p, : width - p] -= f[:, None] * u[:, k, p:]
            y[:, k + p] -= f * y[:, k]
    x = np.zeros_like(y)
    for k in reversed(range(n)):
        more = min(width, n - k)
        x[:, k] = (y[:, k] - (u[:, k, 1:more] * x[:, k + 1 : k + more]).sum(1)) / u[:, k, 0]
    return x


def still_series(band: np.ndarray, rhs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Series that fit the sums while few months differ from the one before: absolute differences by reweighting, from `start`."""
    n, x = band.shape[1], start
    strength = SMOOTH * np.maximum(band[:, :, 0].sum(1) / n, 1e-6)
    for _ in range(INNER):
        u = strength[:, None] / np.maximum(np.abs(np.diff(x, axis=1)), STILL)
        m = band.copy()
        m[:, :-1, 0] += u
        m[:, 1:, 0] += u
        m[:, :-1, 1] -= u
        m[:, :, 0] += 1e-6 * np.maximum(1.0, m[:, :, 0].sum(1) / n)[:, None]
        x = eliminate(m, rhs)
    return x


def _series(months: int):
    """Column function: of the sums of a cell (as arrays of m, k, a, x, y) and its last series to the next series."""

    @F.pandas_udf("x array<double>, y array<double>")
    def solve(m: pd.Series, k: pd.Series, a: pd.Series, bx: pd.Series, by: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = {"x": [], "y": []}
        for at in range(0, len(m), BLOCK):
            part = slice(at, at + BLOCK)
            sizes = [len(v) for v in m[part]]
            flat = lambda s, t=float: np.concatenate([np.asarray(v, t) for v in s[part]])  # noqa: B023, E731
            cell, mm, kk = np.repeat(np.arange(len(sizes)), sizes), flat(m, int), flat(k, int)
            band = np.zeros((len(sizes), months, max(2, int(kk.max(initial=0)) + 1)))
            band[cell, mm, kk] = flat(a)
            for name, b, before in (("x", bx, x), ("y", by, y)):
                rhs = np.zeros((len(sizes), months))
                rhs[cell[kk == 0], mm[kk == 0]] = flat(b)[kk == 0]
                out[name] += list(still_series(band, rhs, np.stack([np.asarray(v, float) for v in before[part]])))
        return pd.DataFrame(out)

    return solve


def _longest(o: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cap): where longer pairs stop being admissible, as their median speed falls under the shortest bin's by more than its spread; infinite if nowhere."""
    nth = reduce(lambda x, e: F.when(F.col("dt") >= e[1], e[0]).otherwise(x), list(enumerate(BINS))[1:], F.lit(0))
    speeds = o.select(*keys, nth.alias("bin"), F.hypot("vx", "vy").alias("speed"))
    medians = percentiles(speeds, [*keys, "bin"], "speed", [0.5]).where(F.col("m") >= LEAST_IN_BIN).select(*keys, "bin", F.get("at", F.lit(0)).alias("median"))
    off = speeds.join(medians, [*keys, "bin"]).select(*keys, "bin", "median", F.abs(F.col("speed") - F.col("median")).alias("off"))
    stats = percentiles(off, [*keys, "bin", "median"], "off", [0.5]).select(*keys, "bin", "median", F.greatest(F.get("at", F.lit(0)) * MAD, F.lit(TOL_FLOOR / 2)).alias("mad"))
    return first_bin_below(stats, keys, "bin").where("cap is not null").select(*keys, F.greatest(F.lit(CAP_LEAST), F.get(F.array(*map(F.lit, BINS)), F.col("cap"))).alias("cap"))


def monthly_series(pairs: DataFrame, cell: Sequence[str], since: float, months: int, step: float = 1 / 12) -> DataFrame:
    """(cell, vx array, vy array, used, resid) by month, of the cells with 30 admissible pairs of pairs (cell, id, t1, t2, dt days, vx, vy, w).

    Pairs with a null take no part, those that suspect surroundings have ruled
    out (timeseries.context_screen) are the caller's to leave out; ids only
    deal pairs out. used counts pairs with over a twentieth of the cell's
    largest weight, resid is the weighted mean residual. A cell that three
    rounds leave with under 30 pairs keeps the series it had then. A month
    that no pair touches is held by its neighbours. A row's array of shares
    has as many entries as its interval has months.
    """
    keys = list(cell)
    some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("t1", "t2", "dt", "vx", "vy", "w")]) & (F.col("w") > 0)
    o = pairs.where(some).select(*keys, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), *[F.col(c).cast("double").alias(c) for c in ("vx", "vy", "w", "dt")], month_shares("t1", "t2", since, months, step).alias("shares"))
    o = o.repartition(*keys, "salt")

    def met(state: DataFrame) -> DataFrame:
        return o.join(state.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), [*keys, "salt"])

    counted = o.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= LEAST_PAIRS).drop("n_")
    caps = settled(counted.join(_longest(o, keys), keys, "left").withColumn("cap", F.coalesce("cap", F.lit(float("inf")))))
    least = met(caps).where(F.col("dt") <= F.col("cap")).groupBy(*keys, "cap").agg(F.count(F.lit(1)).alias("n_"), F.max("w").alias("most")).where(F.col("n_") >= LEAST_PAIRS).drop("n_")
    flat = F.array_repeat(F.lit(0.0), months)
    state = settled(least.withColumns({"x": flat, "y": flat}))

    at = lambda v: F.aggregate("shares", F.lit(0.0), lambda t, s: t + s["s"] * F.get(F.col(v), s["m"]))
    speed = F.hypot("px", "py") + 1e-9
    rx, ry = F.col("vx") - F.col("px"), F.col("vy") - F.col("py")
    tol = F.greatest(F.lit(TOL_FLOOR), TOL_SHARE * speed)
    u = F.least(F.lit(1.0), F.hypot((rx * F.col("px") + ry * F.col("py")) / speed / (ALONG * tol), (ry * F.col("px") - rx * F.col("py")) / speed / tol) / TUKEY)

    def weighed(first: bool) -> DataFrame:
        seen = met(state).where(F.col("dt") <= F.col("cap")).withColumns({"px": at("x"), "py": at("y")})
        return seen.withColumns({"t": F.col("w") if first else F.col("w") * F.pow(1 - u * u, 2), "r2": rx * rx + ry * ry})

    entry = lambda m, k, p, s: F.struct(m.alias("m"), k.alias("k"), p.alias("p"), s.alias("s"))
    right = lambda a, i: F.transform(F.slice("shares", i + 1, F.size("shares")), lambda b: entry(a["m"], b["m"] - a["m"], a["s"] * b["s"], F.when(b["m"] == a["m"], a["s"]).otherwise(0.0)))
    products = F.concat(F.array(entry(F.lit(-1), F.lit(0), F.lit(0.0), F.lit(0.0))), F.flatten(F.transform("shares", right)))  # the first entry counts the pair itself
    kept = [*keys, "cap", "most"]
    for r in range(OUTER):
        terms = weighed(r == 0).select(*keys, "t", "vx", "vy", F.explode(products).alias("e"))
        sums = terms.groupBy(*keys, F.col("e.m").alias("m"), F.col("e.k").alias("k")).agg(F.sum(F.col("t") * F.col("e.p")).alias("a"), *[F.sum(F.col("t") * F.col("e.s") * F.col(v)).alias(b) for v, b in (("vx", "bx"), ("vy", "by"))], F.count_if(F.col("t") > 0).alias("n"))
        whole = sums.groupBy(*keys).agg(F.max(F.when(F.col("m") < 0, F.col("n"))).alias("n"), F.collect_list(F.when(F.col("m") >= 0, F.struct("m", "k", "a", "bx", "by"))).alias("e"))
        both = state.join(whole, keys).withColumn("s", _series(months)(*[F.col(f"e.{c}") for c in ("m", "k", "a", "bx", "by")], F.col("x"), F.col("y")))
        state = settled(both.select(*kept, *[F.when(F.col("n") >= LEAST_PAIRS, F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in ("x", "y")]))
    final = weighed(False).groupBy(*keys).agg(F.count_if(F.col("t") > 0.05 * F.col("most")).alias("used"), F.sqrt(F.sum(F.col("t") * F.col("r2")) / F.nullif(F.sum("t"), F.lit(0.0))).alias("resid"))
    return state.join(final, keys).select(*keys, F.col("x").alias("vx"), F.col("y").alias("vy"), "used", "resid")
