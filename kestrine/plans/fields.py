"""Queries on surfaces and fields: documents in order of their ids fill tiles, and their lengths are what a cell has."""

from __future__ import annotations

from pyspark.sql import functions as F

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


def surface(spark, d):
    """Tiles of 64 by 64 cells: rough floors between walls two cells thick, and holes."""
    k = F.col("doc_id")
    cell = table(spark, d, "documents").select(F.floor(k / 4096).alias("tile"), (F.floor(k / 64) % 64).alias("i"), (k % 64).alias("j"), F.col("n_chars").cast("long").alias("n"))
    wall = F.when((F.col("i") % 10 < 2) | (F.col("j") % 10 < 2), 12).otherwise(0)
    return cell.select("tile", "i", "j", F.when(F.col("n") % 211 != 0, F.col("n") % 12 + wall).cast("double").alias("v"))


_SURFACE = """g as (select doc_id // 4096 as tile, doc_id // 64 % 64 as i, doc_id % 64 as j, n_chars as n from documents),
s as materialized (select tile, i, j, n % 12 + case when i % 10 < 2 or j % 10 < 2 then 12 else 0 end as v from g where n % 211 <> 0)"""


@query(f"""with recursive {_SURFACE}, e as (select tile, i, j, v, 4 - (select count(*) from s b where b.tile = s.tile and abs(b.i - s.i) + abs(b.j - s.j) = 1) > 0 as drains from s),
t as (select unnest(range(24)) as t), r as (select t, tile, i, j from t, e where drains and v <= t union
  select r.t, s.tile, s.i, s.j from r, (select unnest([-1, 0, 1]) as di) a, (select unnest([-1, 0, 1]) as dj) b, s where s.tile = r.tile and s.i = r.i + di and s.j = r.j + dj and s.v <= r.t),
f as (select tile, i, j, min(t) as filled from r group by 1, 2, 3)
select tile, i, j, cast(v as double) as v, cast(filled as double) as filled, case when filled - v >= 3 then cast(filled - v as double) else 0.0::double end as depth from s join f using (tile, i, j)""")
def overdeepening(spark, d):
    """Cells filled to the height at which water leaves them; what lies three or more below it is a basin."""
    from ..operators.basins import overdeepened

    return overdeepened(surface(spark, d), 3.0, size=16)


SINCE, MONTHS = 2020.0, 24


def month_pairs(spark, d):
    """64 documents a cell as pairs over 5 to 105 days: a step in mid-series, noise and blunders by length, long pairs that lock in some cells."""
    p = table(spark, d, "documents").selectExpr("doc_id as id", "floor(doc_id / 64) as cell", "cast(n_chars as bigint) as n", "cast(5 + pmod(doc_id * 7, 11) * pmod(doc_id * 7, 11) as double) as dt", "2019.98D + pmod(doc_id * 37 + n_chars, 720) / 365.25D as t1")
    p = p.selectExpr("*", "t1 + dt / 365.25D as t2", "case when pmod(cell, 3) = 0 and dt > 60 then 0.4D else 1D end as lock", "case when t1 > 2021 then 90D else 0D end as rise")
    return p.selectExpr(
        "id", "cell", "t1", "t2", "dt", "lock * (200 + rise) + pmod(n, 41) - 20 + case when pmod(n, 17) = 0 then 700 else 0 end as vx", "case when pmod(id, 31) <> 0 then lock * (80 - rise / 3) + pmod(n, 29) - 14 end as vy",
        "power(greatest(120D, 25.5D * 365.25D / dt), -2) as w",
    )


_MONTH_PAIRS = """p0 as (select doc_id as id, doc_id // 64 as cell, n_chars as n, cast(5 + (doc_id * 7 % 11) * (doc_id * 7 % 11) as double) as dt, 2019.98::double + (doc_id * 37 + n_chars) % 720 / 365.25::double as t1 from documents),
p1 as (select *, t1 + dt / 365.25::double as t2, case when cell % 3 = 0 and dt > 60 then 0.4::double else 1.0::double end as lock, case when t1 > 2021 then 90.0::double else 0.0::double end as rise from p0),
p as materialized (select id, cell, t1, t2, dt, lock * (200 + rise) + n % 41 - 20 + case when n % 17 = 0 then 700 else 0 end as vx, lock * (80 - rise / 3) + n % 29 - 14 as vy, power(greatest(120.0::double, 25.5::double * 365.25::double / dt), -2) as w from p1 where id % 31 <> 0)"""


def _solve_sql(name: str, source: str, before: str) -> str:
    """CTEs that end in `name` (cell, c, x list): six reweighted solutions of the full equations, by Gauss and Jordan over lists."""
    n, out = MONTHS, []
    for r in range(6):
        last = before if r == 0 else f"{name}_{r - 1}"
        diag = "list_sum(list_transform(range(1, {n} + 1), lambda i: {m}[i][i]))"
        out.append(f"""{name}_u{r} as (select s.cell, s.c, s.m, s.b, list_transform(range(1, {n}), lambda i: 0.35 * greatest({diag.format(n=n, m='s.m')} / {n}, 1e-6) / greatest(abs(l.x[i + 1] - l.x[i]), 5)) as u from {source} s join {last} l on s.cell = l.cell and s.c = l.c)""")
        out.append(f"""{name}_t{r} as (select cell, c, b, list_transform(m, lambda row, i: list_transform(row, lambda v, j: v + case when i = j then coalesce(u[i], 0) + case when i > 1 then u[i - 1] else 0 end when j = i + 1 then -u[i] when i = j + 1 then -u[j] else 0 end)) as m from {name}_u{r})""")
        out.append(f"""{name}_g{r} as (select cell, c, 0 as k, list_transform(m, lambda row, i: list_append(list_transform(row, lambda v, j: v + case when i = j then 1e-6 * greatest(1, {diag.format(n=n, m='m')} / {n}) else 0 end), b[i])) as m from {name}_t{r}
  union all select cell, c, k + 1, list_transform(m, lambda row, i: case when i = k + 1 then row else list_transform(row, lambda v, j: v - row[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) end) from {name}_g{r} where k < {n})""")
        out.append(f"{name}_{r} as materialized (select cell, c, list_transform(m, lambda row, i: row[{n + 1}] / row[i]) as x from {name}_g{r} where k = {n})")
    return ",\n".join(out)


def _inversion_sql() -> str:
    lo, hi = f"({SINCE} + m / 12.0::double)", f"({SINCE} + (m + 1) / 12.0::double)"
    bins = "case when dt >= 256 then 256 when dt >= 128 then 128 when dt >= 64 then 64 when dt >= 32 then 32 when dt >= 16 then 16 else 0 end"
    out = [f"""sp as (select cell, {bins} as bin, sqrt(vx * vx + vy * vy) as s from p where cell in (select cell from p group by 1 having count(*) >= 30)),
md as (select cell, bin, median(s) as med from sp group by 1, 2 having count(*) >= 8), sd as (select cell, bin, med, greatest(12.5::double, 1.4826::double * median(abs(s - med))) as mad from sp join md using (cell, bin) group by 1, 2, 3),
lw as (select *, first_value(med - mad) over (partition by cell order by bin) as low from sd), cp as (select cell, greatest(32, min(bin)) as cap from lw where med < low group by 1),
o0 as (select p.* from p left join cp using (cell) where cell in (select cell from sp) and dt <= coalesce(cap, 1e9)),
o as materialized (select * from o0 where cell in (select cell from o0 group by 1 having count(*) >= 30)), mo as (select unnest(range({MONTHS})) as m),
sh as materialized (select id, cell, m, (least(t2, {hi}) - greatest(t1, {lo})) / (t2 - t1) as s from o, mo where least(t2, {hi}) - greatest(t1, {lo}) > 1e-9),
st0 as (select cell, c, list_transform(range({MONTHS}), lambda i: 0.0::double) as x from (select distinct cell from o), (select unnest(['x', 'y']) as c)), w0 as (select id, cell, w as t from o)"""]
    for r in (1, 2, 3):
        out.append(f"""aa{r} as (select a.cell, a.m as i, b.m as j, sum(t * a.s * b.s) as v from sh a join sh b on a.id = b.id join w{r - 1} w on w.id = a.id group by 1, 2, 3),
bb{r} as (select sh.cell, m, c, sum(t * s * case c when 'x' then vx else vy end) as v from sh join w{r - 1} using (id) join o using (id), (select unnest(['x', 'y']) as c) group by 1, 2, 3),
mr{r} as (select k.cell, i.m as i, list(coalesce(v, 0) order by j.m) as row from (select distinct cell from o) k cross join mo i cross join mo j left join aa{r} a on a.cell = k.cell and a.i = i.m and a.j = j.m group by 1, 2),
eq{r} as materialized (select m.cell, b.c, m.m, b.b from (select cell, list(row order by i) as m from mr{r} group by 1) m join (select k.cell, k.c, list(coalesce(v, 0) order by mo.m) as b from st0 k cross join mo left join bb{r} b on b.cell = k.cell and b.c = k.c and b.m = mo.m group by 1, 2) b using (cell)),
{_solve_sql(f'f{r}', f'eq{r}', f'st{r - 1}')},
st{r} as materialized (select cell, c, case when (select count(*) from w{r - 1} w where w.cell = f.cell and t > 0) >= 30 then f.x else s.x end as x from f{r}_5 f join st{r - 1} s using (cell, c)),
pr{r} as (select o.id, o.cell, o.w, o.vx, o.vy, coalesce(sum(s * x.x[m + 1]), 0) as px, coalesce(sum(s * y.x[m + 1]), 0) as py from o left join sh on sh.id = o.id join st{r} x on x.cell = o.cell and x.c = 'x' join st{r} y on y.cell = o.cell and y.c = 'y' group by 1, 2, 3, 4, 5),
q{r} as (select *, sqrt(px * px + py * py) + 1e-9 as sp, pow(vx - px, 2) + pow(vy - py, 2) as r2 from pr{r}),
w{r} as materialized (select id, cell, w, r2, w * pow(1 - pow(least(1, sqrt(pow(((vx - px) * px + (vy - py) * py) / sp / (1.6 * greatest(25, 0.35 * sp)), 2) + pow(((vy - py) * px - (vx - px) * py) / sp / greatest(25, 0.35 * sp), 2)) / 3), 2), 2) as t from q{r})""")
    return ",\n".join(out)


@query(f"""with recursive {_MONTH_PAIRS}, {_inversion_sql()}, fin as (select cell, count(*) filter (where t > 0.05 * most) as used, sqrt(sum(t * r2) / sum(t)) as resid from w3 join (select cell, max(w) as most from o group by 1) using (cell) group by 1)
select x.cell, mo.m as month, round(x.x[mo.m + 1], 3) as vx, round(y.x[mo.m + 1], 3) as vy, used, round(resid, 3) as resid from st3 x join st3 y on x.cell = y.cell and x.c = 'x' and y.c = 'y' join fin on fin.cell = x.cell cross join mo""")
def monthly_inversion(spark, d):
    """Monthly series from means over intervals, months that differ held down, pairs reweighted in three rounds."""
    from ..operators.inversion import monthly_series

    got = monthly_series(month_pairs(spark, d), ["cell"], SINCE, MONTHS)
    each = got.select("cell", "used", F.round("resid", 3).alias("resid"), F.posexplode(F.arrays_zip("vx", "vy")).alias("month", "v"))
    return each.select("cell", F.col("month").cast("long").alias("month"), F.round("v.vx", 3).alias("vx"), F.round("v.vy", 3).alias("vy"), "used", "resid")
