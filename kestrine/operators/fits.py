"""Robust fits of velocity pairs per cell, as rounds of sums.

A pair measures a mean velocity over [t1, t2]; the model of a cell is level,
trend and season of both components. Nothing gathers a cell: each round joins
the cell's coefficients back to its pairs, weighs them by their residuals and
sums new normal equations, which tasks combine before the shuffle. Pairs are
shuffled once for all rounds, by cell and a salt, so that a cell with very
many pairs is in many tasks; only sums and coefficients move between rounds.
Medians come from ranks over ranges of values, never from a cell's values in
one buffer. A cell that is refused drops out of the rounds that follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .relational import percentiles
from .timeseries import MAD, YEAR, first_bin_below, interval_design, ridge_solve, season_of

# Results must equal those of the method.
SEED_DAYS, SEED_DAYS_WIDE = 64.0, 128.0
MIN_SEED, MIN_TOTAL, MIN_BIN, MIN_HALF = 12, 25, 8, 12
CAP_LEAST = 32.0
BINS = (0.0, 16.0, 32.0, 64.0, 128.0, 256.0)
TUKEY, ROUNDS = 3.0, 4
TOL_FLOOR, TOL_SHARE, ALONG = 25.0, 0.35, 1.6
RIDGE, SEASON_RIDGE = 1e-6, 4e-3
AMP_FLOOR, TREND_FLOOR, LIKE_COS, LIKE_RATIO = 5.0, 1.0, 0.5, 3.0
KEEP_SHARE = 0.05
RECENT_YEARS, MIN_RECENT, STALE_YEARS = 3.5, 5, 1.0
TOO_FAST = 20_000.0

K = 4
#: Tasks among which the pairs of one cell are dealt.
SALTS = 16


def solved(df: DataFrame, a: str, rhs: dict[str, str], k: int = K, damping: Sequence[float] = ()) -> DataFrame:
    """df with columns {out}0.. for each rhs {prefix: out}: solutions of the symmetric equations {a}ij (i <= j) x = {prefix}i, null if singular.

    damping times the mean of the diagonal (1 at least) is added to the diagonal.
    """
    m = lambda i, j: F.col(f"{a}{min(i, j)}{max(i, j)}")
    scale = F.greatest(F.lit(1.0), reduce(lambda x, y: x + y, [m(i, i) for i in range(k)]) / k)
    df = df.withColumn("ata", F.array(*[m(i, j) + scale * damping[i] if damping and i == j else m(i, j) for i in range(k) for j in range(k)]))
    for b, out in rhs.items():
        df = ridge_solve(df.withColumn("atb", F.array(*[f"{b}{i}" for i in range(k)])), ridge=0.0)
        df = df.withColumns({f"{out}{i}": F.get("coef", F.lit(i)) for i in range(k)}).drop("coef", "atb")
    return df.drop("ata")


DAMPING = (RIDGE, RIDGE, RIDGE + SEASON_RIDGE, RIDGE + SEASON_RIDGE)
_A = [f"a{i}{j}" for i in range(K) for j in range(i, K)]
_B = [f"{c}{i}" for c in "xy" for i in range(K)]
COEF = [f"{c}{i}" for c in ("cx", "cy") for i in range(K)]


def _sums(w: Column) -> list[Column]:
    """The sums of the normal equations of both components under a weight."""
    c = lambda i: F.lit(1.0) if i == 0 else F.col(f"c{i}")
    return [F.sum(w * c(i) * c(j)).alias(f"a{i}{j}") for i in range(K) for j in range(i, K)] + [F.sum(w * c(i) * F.col(v)).alias(f"{n}{i}") for n, v in (("x", "vx"), ("y", "vy")) for i in range(K)]


def _at(coef: str) -> Column:
    """A component of the model at a pair."""
    return F.col(f"{coef}0") + F.col("c1") * F.col(f"{coef}1") + F.col("c2") * F.col(f"{coef}2") + F.col("c3") * F.col(f"{coef}3")


def _tukey() -> Column:
    """Weight of a pair by its residuals along and across the model's flow."""
    px, py = _at("cx"), _at("cy")
    speed = F.hypot(px, py) + 1e-9
    rx, ry = F.col("vx") - px, F.col("vy") - py
    along, across = (rx * px + ry * py) / speed, (ry * px - rx * py) / speed
    tol = F.greatest(F.lit(TOL_FLOOR), TOL_SHARE * speed)
    u = F.least(F.lit(1.0), F.hypot(along / (ALONG * tol), across / tol) / TUKEY)
    return F.col("w") * F.pow(1 - u * u, 2)


def seed_days(scenes: DataFrame, dt: str = "dt") -> float:
    """Longest separation, in days, of pairs that define a cell's reference: wider if there are few short ones. scenes has one row per pair of scenes."""
    return SEED_DAYS if scenes.where(F.col(dt) <= SEED_DAYS).limit(3 * MIN_SEED + 1).count() > 3 * MIN_SEED else SEED_DAYS_WIDE


def robust_fit(pairs: DataFrame, cell: Sequence[str], reference: float, seed: float = SEED_DAYS) -> DataFrame:
    """(cell, cx0..3, cy0..3, n, resid, t_first, t_last) of the cells whose pairs (cell, id, t1, t2, dt days, vx, vy, w) support a fit.

    Seeds (short pairs) give a first fit; the longest admissible separation is
    where binned medians along its flow fall under the first bin's by more than
    its spread; four rounds reweigh what is left; season and trend stay if even
    and odd years agree on them. Pairs with a null take no part; ids need not
    be unique, they only deal the pairs out.
    """
    keys = list(cell)
    c1, c2, c3 = interval_design("t1", "t2", reference)
    usable = (F.abs("vx") < TOO_FAST) & (F.abs("vy") < TOO_FAST) & F.col("w").isNotNull() & c1.isNotNull() & F.col("dt").isNotNull()
    o = pairs.where(usable).select(*keys, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), c1.alias("c1"), c2.alias("c2"), c3.alias("c3"), *[F.col(c).cast("double").alias(c) for c in ("vx", "vy", "w", "dt")]).withColumn("is_seed", F.col("dt") <= seed)
    o = o.repartition(*keys, "salt")

    def met(state: DataFrame) -> DataFrame:
        """The pairs with their cell's state."""
        return o.join(state.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), [*keys, "salt"])

    seeds = F.when(F.col("is_seed"), F.col("w")).otherwise(F.lit(0.0))
    first = o.groupBy(*keys).agg(*_sums(seeds), F.count_if("is_seed").alias("n_seed"), F.count(F.lit(1)).alias("n_all")).where((F.col("n_seed") >= MIN_SEED) & (F.col("n_all") >= MIN_TOTAL))
    state = settled(solved(first, "a", {"x": "cx", "y": "cy"}, damping=DAMPING).select(*keys, *COEF).dropna())

    # the longest admissible separation
    speed = F.hypot("cx0", "cy0")
    ux, uy = F.when(speed > 1e-6, F.col("cx0") / speed).otherwise(1.0), F.when(speed > 1e-6, F.col("cy0") / speed).otherwise(0.0)
    nth = reduce(lambda x, e: F.when(F.col("dt") >= e[1], e[0]).otherwise(x), list(enumerate(BINS))[1:], F.lit(0))
    binned = met(state).select(*keys, nth.alias("bin"), (F.col("vx") * ux + F.col("vy") * uy).alias("along"))
    medians = percentiles(binned, [*keys, "bin"], "along", [0.5]).where(F.col("m") >= MIN_BIN).select(*keys, "bin", F.get("at", F.lit(0)).alias("median"))
    apart = binned.join(medians, [*keys, "bin"]).select(*keys, "bin", "median", F.abs(F.col("along") - F.col("median")).alias("off"))
    spread = percentiles(apart, [*keys, "bin", "median"], "off", [0.5])
    stats = spread.select(*keys, "bin", "median", F.greatest(F.get("at", F.lit(0)) * MAD, F.lit(TOL_FLOOR / 2)).alias("mad"))
    cap = first_bin_below(stats, keys, "bin").where("cap is not null").select(*keys, F.greatest(F.lit(CAP_LEAST), F.get(F.array(*map(F.lit, BINS)), F.col("cap"))).alias("cap"))
    state = state.join(cap, keys, "left").withColumn("cap", F.coalesce("cap", F.lit(float("inf"))))
    few = met(state).groupBy(*keys, *COEF, "cap").agg((F.count_if(F.col("dt") <= F.col("cap")) < MIN_TOTAL).alias("few"))
    state = settled(few)
    admitted = F.when(F.col("few"), F.col("is_seed")).otherwise(F.col("dt") <= F.col("cap"))

    for _ in range(ROUNDS - 1):
        sums = met(state).where(admitted).withColumn("t_", _tukey()).groupBy(*keys, "cap", "few").agg(*_sums(F.col("t_")), F.sum("t_").alias("all_")).where("all_ > 0")
        state = solved(sums, "a", {"x": "cx", "y": "cy"}, damping=DAMPING).select(*keys, *COEF, "cap", "few").dropna(subset=COEF)
    state = settled(state)

    # the last round by even and odd years: their sums give both halves and, added, the whole
    odd = F.pmod(F.floor(F.col("c1") + reference), F.lit(2)).alias("odd")
    halves = met(state).where(admitted).withColumn("t_", _tukey()).groupBy(*keys, odd).agg(*_sums(F.col("t_")), F.count_if(F.col("t_") > 0).alias("n_half"), F.max("w").alias("most_w"))
    half = solved(halves, "a", {"x": "cx", "y": "cy"}, damping=DAMPING)
    side = lambda c, h: F.max(F.when((F.col("odd") == h) & (F.col("n_half") >= MIN_HALF), F.col(c)))
    whole = half.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*_A, *_B)], F.max("most_w").alias("most_w"), *[side(c, h).alias(f"{c}_{h}") for c in COEF for h in (0, 1)])
    whole = solved(whole.where("a00 > 0"), "a", {"x": "cx", "y": "cy"}, damping=DAMPING).dropna(subset=COEF)

    def alike(names: Sequence[str], floor: float) -> Column:
        of = lambda h: [F.col(f"{c}_{h}") for c in names]
        size = lambda v: F.sqrt(reduce(lambda x, y: x + y, [c * c for c in v]))
        na, nb = size(of(0)), size(of(1))
        cos = reduce(lambda x, y: x + y, [p * q for p, q in zip(of(0), of(1), strict=True)]) / F.nullif(na * nb, F.lit(0.0))
        return F.coalesce((na >= floor) & (nb >= floor) & (cos > LIKE_COS) & (F.greatest(na, nb) / F.greatest(F.least(na, nb), F.lit(1e-9)) < LIKE_RATIO), F.lit(False))

    whole = whole.withColumns({"season": alike(["cx2", "cx3", "cy2", "cy3"], AMP_FLOOR), "trend": alike(["cx1", "cy1"], TREND_FLOOR)})
    plain = {}
    for c, b in (("cx", "x"), ("cy", "y")):
        det = F.col("a00") * F.col("a11") - F.col("a01") * F.col("a01")
        det = F.when(det > 1e-12 * F.col("a00") * F.col("a11"), det)
        # without a season; all pairs at one time: the mean alone
        level = F.coalesce((F.col(f"{b}0") * F.col("a11") - F.col(f"{b}1") * F.col("a01")) / det, F.col(f"{b}0") / F.col("a00"))
        slope = F.coalesce((F.col(f"{b}1") * F.col("a00") - F.col(f"{b}0") * F.col("a01")) / det, F.lit(0.0))
        plain |= {f"{c}0": F.when(F.col("season"), F.col(f"{c}0")).otherwise(level), f"{c}1": F.when(F.col("trend"), F.when(F.col("season"), F.col(f"{c}1")).otherwise(slope)).otherwise(0.0)}
        plain |= {f"{c}{i}": F.when(F.col("season"), F.col(f"{c}{i}")).otherwise(0.0) for i in (2, 3)}
    final = whole.select(*keys, "most_w", *[v.alias(f"f{k}") for k, v in plain.items()])
    both = state.join(final, keys)

    rx, ry = F.col("vx") - _at("fcx"), F.col("vy") - _at("fcy")
    kept = settled(met(both).where(admitted).withColumn("t_", _tukey()).where(F.col("t_") > KEEP_SHARE * F.col("most_w")).select(*keys, "t_", (F.col("c1") + reference).alias("tm"), (rx * rx + ry * ry).alias("r2")))
    told = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.col("t_") * F.col("r2")) / F.sum("t_")).alias("resid")).where(F.col("n") >= MIN_TOTAL)
    span = percentiles(kept, keys, "tm", [0.05, 0.95]).select(*keys, F.get("at", F.lit(0)).alias("t_first"), F.get("at", F.lit(1)).alias("t_last"))
    return final.select(*keys, *[F.col(f"f{c}").alias(c) for c in COEF]).join(told, keys).join(span, keys)


def flow(fits: DataFrame) -> DataFrame:
    """fits with v0, amp, phase and trend along the flow."""
    speed = F.hypot("cx0", "cy0") + 1e-9
    along = lambda i: (F.col(f"cx{i}") * F.col("cx0") + F.col(f"cy{i}") * F.col("cy0")) / speed
    amp, _ = season_of(along(2), along(3))
    phase = F.pmod(F.degrees(F.atan2(along(3), along(2))), F.lit(360.0)) / 360 * YEAR
    return fits.withColumns({"v0": speed, "amp": amp, "phase": phase, "trend": along(1)})


def tiered_fit(pairs: DataFrame, cell: Sequence[str], reference: float, since: float, seed: float = SEED_DAYS) -> DataFrame:
    """One row per cell of pairs: v0, amp, phase, trend, n, resid, t_first, t_last, recent, source.

    Source 1: the pairs since a time. 2: what those refuse, from all pairs, if
    the cell has recent evidence; else 4, and 0 if all pairs refuse it too.
    5: kept pairs end too long before the reference; their time span stays,
    what they'd say of the reference goes.
    """
    keys = list(cell)
    mid = (F.col("t1") + F.col("t2")) / 2
    recent = settled(pairs.groupBy(*keys).agg(F.count_if((mid >= reference - RECENT_YEARS) & F.col("vx").isNotNull()).alias("recent")))
    one = settled(flow(robust_fit(pairs.where(mid >= since), keys, reference, seed)))
    refused = recent.where(F.col("recent") >= MIN_RECENT).join(one, keys, "left_anti")
    two = flow(robust_fit(pairs.join(refused.select(*keys), keys, "left_semi"), keys, reference, seed))
    found = one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2)))
    stale = F.coalesce(F.col("t_last") < reference - STALE_YEARS, F.lit(False))
    source = F.when(stale, 5).when(F.col("tier").isNotNull(), F.col("tier")).when(F.col("recent") < MIN_RECENT, 4).otherwise(0)
    return recent.join(found, keys, "left").select(*keys, *[F.when(~stale, F.col(c)).alias(c) for c in ("v0", "amp", "phase", "trend")], "n", "resid", "t_first", "t_last", "recent", source.alias("source"))
