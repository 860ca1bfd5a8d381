"""Queries on overlaps of concave shapes with holes, in the equal-area projection, with their SQL over all pairs of edges."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import merge as M
from ..operators import overlay as O
from ..operators import relational as R
from ..session import settled, table
from .shapes import _albers_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_UNIT = [(math.cos(2 * math.pi * j / 10), math.sin(2 * math.pi * j / 10)) for j in range(10)]
_HOLE = [(-0.004, -0.004), (0.004, -0.004), (0.004, 0.004), (-0.004, 0.004)]
CELL = 6000.0


def stars(spark, d, shift: float = 0.0):
    """A star of ten points per part, some with a hole, eight to a place; moved east by shift where the key isn't divisible by 3. In metres, with boxes."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey").repartition(R.tasks(spark)).select(k.alias("id"), (F.lit(-165.0) + F.floor(k / 8) % 250 * 0.1 + k % 8 * 0.004 + F.when(k % 3 == 0, 0.0).otherwise(shift)).alias("lon"), (F.lit(55.0) + F.floor(k / 2000) % 60 * 0.2 + k % 5 * 0.003).alias("lat"))
    ring = lambda points: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])
    reach = lambda j: 0.01 * (1 + (F.col("id") * 3 + j * 5) % 7 / F.lit(3.0))
    outer = ring([(F.col("lon") + reach(j) * cx, F.col("lat") + reach(j) * cy) for j, (cx, cy) in enumerate(_UNIT)])
    hole = ring([(F.col("lon") + x, F.col("lat") + y) for x, y in _HOLE])
    geom = F.array(F.when(F.col("id") % 4 == 0, F.array(outer, hole)).otherwise(F.array(outer)))
    flat = rows.select("id", geom.alias("g")).select("id", O.flat("g", geo.albers).alias("geom"))
    return flat.select("id", "geom", (F.col("id") % 11).alias("name"), geo.box_of("geom").alias("b")).select("id", "geom", "name", "b.*")


def _stars_sql(name: str, shift: float) -> str:
    """CTEs {name}_e (id, edges with a sign) and {name}_s (id, area, low, box) of the stars."""
    outer = ", ".join(f"{{'r': 0, 'j': {j}, 'x': lon + 0.01 * (1 + (id * 3 + {j * 5}) % 7 / 3.0::double) * {cx!r}::double, 'y': lat + 0.01 * (1 + (id * 3 + {j * 5}) % 7 / 3.0::double) * {cy!r}::double}}" for j, (cx, cy) in enumerate(_UNIT))
    hole = ", ".join(f"{{'r': 1, 'j': {j}, 'x': lon + {x}::double, 'y': lat + {y}::double}}" for j, (x, y) in enumerate(_HOLE))
    px, py = _albers_sql("p.x", "p.y")
    return f"""{name}_p as (select p_partkey as id, -165.0::double + p_partkey // 8 % 250 * 0.1::double + p_partkey % 8 * 0.004::double + case when p_partkey % 3 = 0 then 0 else {shift}::double end as lon, 55.0::double + p_partkey // 2000 % 60 * 0.2::double + p_partkey % 5 * 0.003::double as lat from part),
{name}_v as (select id, unnest(case when id % 4 = 0 then [{outer}, {hole}] else [{outer}] end) as p from {name}_p), {name}_m as (select id, p.r as r, p.j as j, {px} as x, {py} as y from {name}_v),
{name}_r as materialized (select id, r, x as px, y as py, coalesce(lead(x) over w, first_value(x) over w) as qx, coalesce(lead(y) over w, first_value(y) over w) as qy from {name}_m window w as (partition by id, r order by j)),
{name}_o as (select id, r, sum((qx - px) * (qy + py)) / -2 as a from {name}_r group by 1, 2),
{name}_e as materialized (select e.id, least(px, qx) as x0, greatest(px, qx) as x1, case when px < qx then py else qy end as y0, case when px < qx then qy else py end as y1, sign(px - qx) * sign(o.a) * case when e.r = 0 then 1 else -1 end as s from {name}_r e join {name}_o o on o.id = e.id and o.r = e.r where px <> qx),
{name}_s as materialized (select id, (select sum(abs(a) * case when r = 0 then 1 else -1 end) from {name}_o o where o.id = m.id) as area, min(y) as low, min(x) as x0, max(x) as x1, max(y) as y1 from {name}_m m group by id)"""


def _pairs_sql(a: str, b: str, where: str) -> str:
    """CTE i (a_id, b_id, area_a, area_b, shared) of shapes whose boxes meet."""
    return f"""n as materialized (select a.id as a_id, b.id as b_id, a.area as area_a, b.area as area_b, least(a.low, b.low) as base from {a}_s a join {b}_s b on {where} and a.x0 <= b.x1 and b.x0 <= a.x1 and a.low <= b.y1 and b.low <= a.y1),
t as (select n.*, e.s * f.s as s, greatest(e.x0, f.x0) as lo, least(e.x1, f.x1) as hi, e.x0 as ex, e.y0 as ey, (e.y1 - e.y0) / (e.x1 - e.x0) as em, f.x0 as fx, f.y0 as fy, (f.y1 - f.y0) / (f.x1 - f.x0) as fm from n join {a}_e e on e.id = n.a_id join {b}_e f on f.id = n.b_id where e.x0 < f.x1 and f.x0 < e.x1),
u as (select *, ey + em * (lo - ex) - base as e0, ey + em * (hi - ex) - base as e1, fy + fm * (lo - fx) - base as f0, fy + fm * (hi - fx) - base as f1 from t),
i as (select n.a_id, n.b_id, n.area_a, n.area_b, greatest(0.0::double, coalesce(sum(s * (hi - lo) * case when (e0 <= f0) = (e1 <= f1) then (least(e0, f0) + least(e1, f1)) / 2
  else (least(e0, f0) + (e0 * f1 - e1 * f0) / (e0 - e1 - f0 + f1)) / 2 * ((e0 - f0) / (e0 - f0 - e1 + f1)) + (least(e1, f1) + (e0 * f1 - e1 * f0) / (e0 - e1 - f0 + f1)) / 2 * (1 - (e0 - f0) / (e0 - f0 - e1 + f1)) end), 0)) as shared from n left join u using (a_id, b_id) group by 1, 2, 3, 4)"""


@query(f"with {_stars_sql('a', 0.0)}, {_pairs_sql('a', 'a', 'a.id < b.id')} select a_id, b_id, cast(round(shared) as bigint) as shared, round(shared / (area_a + area_b - shared), 6) as iou from i where round(shared) > 0")
def concave_overlaps(spark, d):
    """Shared area, in square metres of the equal-area projection, and overlap of concave shapes with holes; candidates by cells of their boxes."""
    s = settled(O.outlined(stars(spark, d).drop("name")))
    got = O.shared_areas(R.meeting_boxes(s, s, CELL).where("a_id < b_id"))
    return got.select("a_id", "b_id", F.round("both").cast("long").alias("shared"), F.round("iou", 6).alias("iou")).where("shared > 0")


@query(f"with {_stars_sql('a', 0.0)}, {_stars_sql('u', 0.001)}, {_pairs_sql('u', 'a', 'true')}, v as (select *, round(shared / (area_a + area_b - shared), 9) as iou from i) select a_id as u_id, b_id, case when iou >= 0.999 then 'update' when a_id % 11 = b_id % 11 then 'block' when a_id % 11 % 3 = b_id % 11 % 3 or iou > 0.8 then 'review' end as class from v")
def shape_collisions(spark, d):
    """What to do with an upload whose outline meets a stored one, by their exact overlap: same shape, same name, or to be looked at."""
    stored, new = settled(O.outlined(stars(spark, d))), settled(O.outlined(stars(spark, d, 0.001)))
    iou = F.round("iou", 9)
    got = O.shared_areas(R.meeting_boxes(new, stored, CELL))
    return got.select(F.col("a_id").alias("u_id"), "b_id", M.collision(iou, F.col("a_name") % 3, F.col("b_name") % 3, F.col("a_name"), F.col("b_name")).alias("class"))
