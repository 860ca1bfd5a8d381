"""Queries on fits of velocity pairs, with their SQL: rounds unrolled, equations solved column by column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits as T
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


REFERENCE, SINCE = 2024.5, 2018.0


def pairs(spark, d):
    """events as velocity pairs: a cell per user, flow by cell, noise from the values; long pairs of some cells lock, some cells have little of late."""
    e = table(spark, d, "events").selectExpr("event_id as id", "user_id as cell", "event_id * 37 % 3650 / 3650D as u", "cast(4 + pmod(event_id * 13, 17) * pmod(event_id * 13, 17) as double) as dt", "value", "event_type")
    e = e.selectExpr("*", "case pmod(cell, 4) when 0 then 2012 + 9.5D * u when 1 then 2013 + 11.5D * u when 2 then 2006 + 18.7D * u else 2015 + 9.9D * u end as tm")
    e = e.selectExpr("id", "cell", "dt", "tm - dt / 730.5D as t1", "tm + dt / 730.5D as t2", "tm", "value", "event_type", "case when pmod(cell, 3) = 0 and dt > 130 then 0.4D else 1D end as lock", "case when pmod(id, 23) = 0 then 8 else 1 end as wild")
    return e.selectExpr(
        "id", "cell", "dt", "t1", "t2", "lock * (120 + 10 * pmod(cell, 5) + 5 * (tm - 2020) + 25 * cos(2 * pi() * tm)) + wild * (value - 15) * 0.4D as vx",
        "case when pmod(id, 31) <> 0 then lock * (60 - 8 * pmod(cell, 7) + 3 * (tm - 2020) + 10 * sin(2 * pi() * tm)) - wild * (value - 15) * 0.3D end as vy",
        "power(greatest(8D, 25.5D * 365.25D / greatest(dt, 1)), -2) * case when event_type = 'error' then 0.25D when event_type like 'p%' then 0.45D else 1D end as w",
    )


_PAIRS = """e0 as (select event_id as id, user_id as cell, event_id * 37 % 3650 / 3650.0::double as u, cast(4 + (event_id * 13 % 17) * (event_id * 13 % 17) as double) as dt, value, event_type from events),
e1 as (select *, case cell % 4 when 0 then 2012 + 9.5::double * u when 1 then 2013 + 11.5::double * u when 2 then 2006 + 18.7::double * u else 2015 + 9.9::double * u end as tm from e0),
e2 as (select *, tm - dt / 730.5::double as t1, tm + dt / 730.5::double as t2, case when cell % 3 = 0 and dt > 130 then 0.4::double else 1.0::double end as lock, case when id % 23 = 0 then 8 else 1 end as wild from e1),
pairs as materialized (select id, cell, dt, t1, t2, lock * (120 + 10 * (cell % 5) + 5 * (tm - 2020) + 25 * cos(2 * pi() * tm)) + wild * (value - 15) * 0.4::double as vx,
  case when id % 31 <> 0 then lock * (60 - 8 * (cell % 7) + 3 * (tm - 2020) + 10 * sin(2 * pi() * tm)) - wild * (value - 15) * 0.3::double end as vy,
  power(greatest(8.0::double, 25.5 * 365.25 / greatest(dt, 1.0::double)), -2) * case when event_type = 'error' then 0.25::double when event_type like 'p%' then 0.45::double else 1.0::double end as w from e2)"""

_K = range(4)


def _sums_sql(w: str) -> str:
    c = lambda i: "1.0::double" if i == 0 else f"c{i}"
    return ", ".join([f"sum({w} * {c(i)} * {c(j)}) as a{i}{j}" for i in _K for j in _K if i <= j] + [f"sum({w} * {c(i)} * v{b}) as {b}{i}" for b in "xy" for i in _K])


def _solve_sql(name: str, source: str, keep: str) -> str:
    """CTEs that end in `name`: keep, x0.. and y0.. of source's equations, by elimination from the first column to the last."""
    damp = ("1e-6", "1e-6", "4.001e-3", "4.001e-3")
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    rows = ", ".join([f"{a(i, j)}" + (f" + {damp[i]} * greatest(1.0::double, (a00 + a11 + a22 + a33) / 4)" if i == j else "") + f" as m{i}{j}" for i in _K for j in _K] + [f"{b}{i} as {b}r{i}" for b in "xy" for i in _K])
    out = [f"{name}_0 as (select {keep}, {rows} from {source})"]
    for p in _K:
        cells = [(f"m{i}{j}", f"m{i}{j} - m{i}{p} / m{p}{p} * m{p}{j}" if i != p else f"m{i}{j}") for i in _K for j in _K] + [(f"{b}r{i}", f"{b}r{i} - m{i}{p} / m{p}{p} * {b}r{p}" if i != p else f"{b}r{i}") for b in "xy" for i in _K]
        out.append(f"{name}_{p + 1} as (select {keep}, {', '.join(f'{e} as {n}' for n, e in cells)} from {name}_{p})")
    return ",\n".join([*out, f"{name} as materialized (select {keep}, {', '.join(f'{b}r{i} / m{i}{i} as c{b}{i}' for b in 'xy' for i in _K)} from {name}_4)"])


def _fit_sql(p: str, source: str) -> str:
    """CTEs that end in {p}_fit: the robust fit of pairs, with all names under a prefix."""
    at = lambda b, t="": " + ".join([f"{t}c{b}0", *[f"c{i} * {t}c{b}{i}" for i in (1, 2, 3)]])
    out = [f"{p}_o as materialized (select cell, id, dt, vx, vy, w, dt <= 64 as seed, (t1 + t2) / 2 - {REFERENCE} as c1, (sin(2 * pi() * t2) - sin(2 * pi() * t1)) / (2 * pi() * (t2 - t1)) as c2, (cos(2 * pi() * t1) - cos(2 * pi() * t2)) / (2 * pi() * (t2 - t1)) as c3 from {source} where abs(vx) < 20000 and abs(vy) < 20000)"]
    out.append(f"{p}_s as (select cell, {_sums_sql('case when seed then w else 0 end')} from {p}_o group by cell having count(*) filter (where seed) >= 12 and count(*) >= 25)")
    out.append(_solve_sql(f"{p}_k0", f"{p}_s", "cell"))
    edges = (16, 32, 64, 128, 256)
    nth = "case " + " ".join(f"when dt >= {e} then {i}" for i, e in reversed(list(enumerate(edges, 1)))) + " else 0 end"
    out.append(f"{p}_b as (select cell, {nth} as bin, (vx * cx0 + vy * cy0) / sqrt(cx0 * cx0 + cy0 * cy0) as v from {p}_o join {p}_k0 using (cell))")
    out.append(f"{p}_m as (select cell, bin, median(v) as med from {p}_b group by 1, 2 having count(*) >= 8)")
    out.append(f"{p}_d as (select cell, bin, med, greatest(12.5::double, 1.4826 * median(abs(v - med))) as mad from {p}_b join {p}_m using (cell, bin) group by 1, 2, 3)")
    out.append(f"{p}_f as (select cell, bin, med, first_value(med - mad) over (partition by cell order by bin) as low from {p}_d)")
    out.append(f"{p}_c as (select k.cell, greatest(32.0::double, coalesce(min(case f.bin {' '.join(f'when {i} then {e}' for i, e in enumerate(edges, 1))} end) filter (where med < low), 'infinity'::double)) as cap from {p}_k0 k left join {p}_f f on k.cell = f.cell group by 1)")
    out.append(f"{p}_n as (select cell, cap, count(*) filter (where dt <= cap) < 25 as few from {p}_o join {p}_c using (cell) group by 1, 2)")
    out.append(f"{p}_a as materialized (select o.* from {p}_o o join {p}_n using (cell) where case when few then seed else dt <= cap end)")

    def weighed(name: str, k: str, more: str = "") -> str:
        px, py = at("x"), at("y")
        inner = f"select o.*{more}, {px} as px, {py} as py from {p}_a o join {k} k using (cell)"
        z = "sqrt(pow(((vx - px) * px + (vy - py) * py) / s / (1.6 * greatest(25.0::double, 0.35 * s)), 2) + pow(((vy - py) * px - (vx - px) * py) / s / greatest(25.0::double, 0.35 * s), 2))"
        return f"{name} as materialized (select *, w * pow(1 - pow(least(1.0::double, {z} / 3), 2), 2) as tw from (select *, sqrt(px * px + py * py) + 1e-9 as s from ({inner})))"

    for r in (1, 2, 3):
        out += [weighed(f"{p}_w{r}", f"{p}_k{r - 1}"), f"{p}_s{r} as (select cell, {_sums_sql('tw')} from {p}_w{r} group by cell having sum(tw) > 0)", _solve_sql(f"{p}_k{r}", f"{p}_s{r}", "cell")]
    out.append(weighed(f"{p}_w4", f"{p}_k3"))
    out.append(f"{p}_h as materialized (select cell, floor(c1 + {REFERENCE}) % 2 as odd, count(*) filter (where tw > 0) as nh, max(w) as most, {_sums_sql('tw')} from {p}_w4 group by 1, 2)")
    names = [f"a{i}{j}" for i in _K for j in _K if i <= j] + [f"{b}{i}" for b in "xy" for i in _K]
    out.append(f"{p}_t as (select cell, max(most) as most, {', '.join(f'sum({n}) as {n}' for n in names)} from {p}_h group by cell having sum(a00) > 0)")
    out += [_solve_sql(f"{p}_kh", f"{p}_h", "cell, odd, nh"), _solve_sql(f"{p}_k4", f"{p}_t", "cell, most, a00, a01, a11, x0, x1, y0, y1")]

    def alike(cs: tuple[str, ...], floor: int) -> str:
        dot = lambda s, t: " + ".join(f"{s}.{c} * {t}.{c}" for c in cs)
        na, nb = f"sqrt({dot('e', 'e')})", f"sqrt({dot('q', 'q')})"
        return f"coalesce({na} >= {floor} and {nb} >= {floor} and ({dot('e', 'q')}) / ({na} * {nb}) > 0.5 and greatest({na}, {nb}) / least({na}, {nb}) < 3, false)"

    out.append(f"{p}_g as (select k.*, {alike(('cx2', 'cx3', 'cy2', 'cy3'), 5)} as season, {alike(('cx1', 'cy1'), 1)} as trend from {p}_k4 k left join {p}_kh e on e.cell = k.cell and e.odd = 0 and e.nh >= 12 left join {p}_kh q on q.cell = k.cell and q.odd = 1 and q.nh >= 12)")
    cols = []
    for b in "xy":
        cols += [f"case when season then c{b}0 else ({b}0 * a11 - {b}1 * a01) / (a00 * a11 - a01 * a01) end as c{b}0", f"case when not trend then 0 when season then c{b}1 else ({b}1 * a00 - {b}0 * a01) / (a00 * a11 - a01 * a01) end as c{b}1"]
        cols += [f"case when season then c{b}{i} else 0 end as c{b}{i}" for i in (2, 3)]
    out.append(f"{p}_final as materialized (select cell, most, {', '.join(cols)} from {p}_g)")
    out.append(f"{p}_r as (select o.cell, o.tw, o.c1 + {REFERENCE} as tm, pow(vx - ({at('x', 'f.')}), 2) + pow(vy - ({at('y', 'f.')}), 2) as r2 from {p}_w4 o join {p}_final f using (cell) where o.tw > 0.05 * f.most)")
    out.append(f"{p}_fit as materialized (select f.*, r.n, r.resid, r.t_first, r.t_last from {p}_final f join (select cell, count(*) as n, sqrt(sum(tw * r2) / sum(tw)) as resid, quantile_cont(tm, 0.05) as t_first, quantile_cont(tm, 0.95) as t_last from {p}_r group by cell having count(*) >= 25) r using (cell))")
    return ",\n".join(out)


_COEF = [f"c{b}{i}" for b in "xy" for i in range(4)]


@query(f"with {_PAIRS}, {_fit_sql('r', 'pairs')} select cell, {', '.join(f'round({c}, 4) as {c}' for c in _COEF)}, n, round(resid, 4) as resid, round(t_first, 6) as t_first, round(t_last, 6) as t_last from r_fit")
def robust_fit(spark, d):
    """Seeds, longest admissible separation by binned medians, four reweighted rounds, season and trend if both halves agree."""
    p = pairs(spark, d)
    got = T.robust_fit(p, ["cell"], REFERENCE, T.seed_days(p))
    return got.select("cell", *[F.round(c, 4).alias(c) for c in _COEF], "n", F.round("resid", 4).alias("resid"), F.round("t_first", 6).alias("t_first"), F.round("t_last", 6).alias("t_last"))


_FLOW = "sqrt(cx0 * cx0 + cy0 * cy0) + 1e-9"


@query(f"""with {_PAIRS}, late as (select * from pairs where (t1 + t2) / 2 >= {SINCE}), recent as (select cell, count(*) filter (where (t1 + t2) / 2 >= {REFERENCE - 3.5} and vx is not null) as recent from pairs group by 1),
{_fit_sql('one', 'late')}, again as (select * from pairs where cell in (select cell from recent where recent >= 5) and cell not in (select cell from one_fit)), {_fit_sql('two', 'again')},
found as (select *, 1 as tier from one_fit union all select *, 2 as tier from two_fit), s as (select *, {_FLOW} as v0 from found),
l as (select *, (cx2 * cx0 + cy2 * cy0) / v0 as ac, (cx3 * cx0 + cy3 * cy0) / v0 as sc, (cx1 * cx0 + cy1 * cy0) / v0 as trend, t_last < {REFERENCE} - 1 as stale from s)
select r.cell, round(case when not stale then v0 end, 4) as v0, round(case when not stale then sqrt(ac * ac + sc * sc) end, 4) as amp, round(case when not stale then (degrees(atan2(sc, ac)) + 360) % 360 / 360 * 365.25 end, 2) as phase,
  round(case when not stale then trend end, 4) as trend, n, round(resid, 4) as resid, round(t_first, 6) as t_first, round(t_last, 6) as t_last, recent,
  case when stale then 5 when tier is not null then tier when recent < 5 then 4 else 0 end as source from recent r left join l using (cell)""")
def tiered_fit(spark, d):
    """T4: recent pairs first, all pairs where those refuse and there is recent evidence; cells whose pairs end early are marked."""
    p = pairs(spark, d)
    got = T.tiered_fit(p, ["cell"], REFERENCE, SINCE)
    return got.select("cell", *[F.round(c, 2 if c == "phase" else 4).alias(c) for c in ("v0", "amp", "phase", "trend")], "n", F.round("resid", 4).alias("resid"), F.round("t_first", 6).alias("t_first"), F.round("t_last", 6).alias("t_last"), "recent", "source")


def monthly(spark, d):
    """orders as monthly series of seven years: a cell per two nations, a month by order key, noise from mean prices, seasons and their overtones by cell."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.floor(F.col("c_nationkey") / 2).alias("cell"), (F.col("o_orderkey") % 84).alias("at")).agg(F.avg("o_totalprice").alias("p"), F.avg(F.col("o_custkey") % 101).alias("q"))
    g = g.withColumn("t", 1992 + (F.col("at") + 0.5) / 12)
    return g.selectExpr("cell", "at", "t", "150 + 3 * (t - 1995) + 12 * (cell % 3) * cos(2 * pi() * t) + 7 * (cell % 2) * sin(4 * pi() * t) + 3.5D * (cell % 5) * cos(6 * pi() * t) + p / 60000D as vx", "60 + 9 * (cell % 3) * sin(2 * pi() * t) - 4 * (cell % 2) * cos(4 * pi() * t) + q / 25D as vy")


def _harmonics_sql() -> str:
    out = ["""g as (select c_nationkey // 2 as cell, o_orderkey % 84 as mo, avg(o_totalprice) as p, avg(o_custkey % 101) as q from orders join customer on o_custkey = c_custkey group by 1, 2),
v as (select cell, mo, 1992 + (mo + 0.5::double) / 12 as t, p, q from g),
f as (select cell, mo, t, 150 + 3 * (t - 1995) + 12 * (cell % 3) * cos(2 * pi() * t) + 7 * (cell % 2) * sin(4 * pi() * t) + 3.5::double * (cell % 5) * cos(6 * pi() * t) + p / 60000.0::double as vx, 60 + 9 * (cell % 3) * sin(2 * pi() * t) - 4 * (cell % 2) * cos(4 * pi() * t) + q / 25.0::double as vy from v),
w as (select cell, sqrt(pow(avg(vx), 2) + pow(avg(vy), 2)) as speed, min(mo) as lo, max(mo) as hi from f group by 1 having count(*) = (select count(distinct mo) from f)),
e as (select f.cell, f.mo, f.t, f.vx - (select avg(b.vx) from f b, (select unnest(range(-6, 7)) as h) x where b.cell = f.cell and b.mo = greatest(w.lo, least(w.hi, f.mo + x.h))) as rx, f.vy - (select avg(b.vy) from f b, (select unnest(range(-6, 7)) as h) x where b.cell = f.cell and b.mo = greatest(w.lo, least(w.hi, f.mo + x.h))) as ry from f join w using (cell)),
r0 as materialized (select cell, t, rx, ry, floor(t) % 2 as odd from e), s0 as (select w.cell, speed, sum(rx * rx + ry * ry) as whole, 'infinity'::double as amp_before, 0.0::double as total from w join r0 using (cell) group by 1, 2)"""]
    keep = "cell, speed, whole"
    for k in (1, 2, 3):
        c, s = f"cos({2 * k} * pi() * t)", f"sin({2 * k} * pi() * t)"
        parts = {"xc": f"rx * {c}", "xs": f"rx * {s}", "yc": f"ry * {c}", "ys": f"ry * {s}"}
        aggs = ", ".join([f"sum({v}) / sum({c} * {c}) as {p}" for p, v in parts.items()] + [f"sum({v}) filter (where odd = {h}) / sum({c} * {c}) filter (where odd = {h}) as {p}{h}" for p, v in parts.items() for h in (0, 1)])
        norm = lambda h: "sqrt(" + " + ".join(f"{p}{h} * {p}{h}" for p in parts) + ")"
        gate = f"dot / greatest(n0 * n1, 1e-9) > {(0.60, 0.78, 0.88)[k - 1]} and greatest(n0, n1) / greatest(least(n0, n1), 1e-9) < 2.5 and amp > 3"
        if k > 1:
            gate += f" and kept_{k - 1} and amp < 0.7 * amp_before and total + amp < greatest(6.0, 0.6 * speed)"
        before = "".join(f", kept_{j}, " + ", ".join(f"{p}_{j}" for p in parts) + f", explained_{j}" for j in range(1, k))
        out.append(f"""h{k} as (select cell, {aggs} from r{k - 1} group by 1), a{k} as (select *, {norm(0)} as n0, {norm(1)} as n1, {norm('')} as amp, {' + '.join(f'{p}0 * {p}1' for p in parts)} as dot from h{k}),
k{k} as (select s.*, {', '.join(f'a.{p}' for p in parts)}, amp, {gate} as kept_{k} from s{k - 1} s join a{k} a using (cell)),
c{k} as materialized (select {keep}{before}, kept_{k}, {', '.join(f'case when kept_{k} then {p} else 0 end as {p}_{k}' for p in parts)}, case when kept_{k} then amp else amp_before end as amp_before, total + case when kept_{k} then amp else 0 end as total from k{k}),
r{k} as materialized (select cell, t, rx - xc_{k} * {c} - xs_{k} * {s} as rx, ry - yc_{k} * {c} - ys_{k} * {s} as ry, odd from r{k - 1} join c{k} using (cell)),
s{k} as materialized (select c.*, 1 - rest / whole as explained_{k} from c{k} c join (select cell, sum(rx * rx + ry * ry) as rest from r{k} group by 1) using (cell))""")
    return ",\n".join(out)


_HARMONIC = [f"{p}_{k}" for k in (1, 2, 3) for p in ("xc", "xs", "yc", "ys", "explained")]


@query(f"with {_harmonics_sql()} select cell, round(speed, 6) as speed, kept_1, kept_2, kept_3, {', '.join(f'round({c}, 6) as {c}' for c in _HARMONIC)} from s3")
def harmonic_cycle(spark, d):
    """Harmonics of monthly series, each fitted to what those before leave, kept if even and odd years agree."""
    from ..operators.harmonics import harmonics

    got = harmonics(monthly(spark, d), ["cell"], "at", "t")
    return got.select("cell", F.round("speed", 6).alias("speed"), "kept_1", "kept_2", "kept_3", *[F.round(c, 6).alias(c) for c in _HARMONIC])
