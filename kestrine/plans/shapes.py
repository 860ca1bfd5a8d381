"""Queries on geometry, links and editing, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, links as L
from ..operators import editing as E
from ..session import table
from .roles import PARTS, parts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ring(*points):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _box(x0, y0, x1, y1):
    return _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def _albers_sql(lon: str, lat: str) -> tuple[str, str]:
    """The equal-area conic of the Alaska grid as SQL, on GRS80."""
    a, e2 = 6_378_137.0, 0.00669438002290
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    p0, p1, p2 = map(math.radians, (50.0, 55.0, 65.0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(math.sin(p2)) - q(math.sin(p1)))
    c = m(p1) ** 2 + n * q(math.sin(p1))
    rho0 = a * math.sqrt(c - n * q(math.sin(p0))) / n
    s = f"sin(radians({lat}))"
    qs = f"({1 - e2}::double * ({s} / (1 - {e2}::double * {s} * {s}) - ln((1 - {e}::double * {s}) / (1 + {e}::double * {s})) / {2 * e}::double))"
    rho, theta = f"({a}::double * sqrt({c}::double - {n}::double * {qs}) / {n}::double)", f"({n}::double * radians({lon} + 154))"
    return f"{rho} * sin({theta})", f"{rho0}::double - {rho} * cos({theta})"


_PLACE = "p as (select o_orderkey as id, -165 + o_orderkey % 300 / 10.0::double as lon, 55 + o_orderkey % 130 / 10.0::double as lat, 0.001::double * (1 + o_custkey % 20) as w from orders)"
_CORNERS = ", ".join(f"{_albers_sql(x, y)[i]} as {'xy'[i]}{k}" for k, (x, y) in enumerate((("lon - w", "lat - w"), ("lon + w", "lat - w"), ("lon + w", "lat + w"), ("lon - w", "lat + w"))) for i in (0, 1))


def _albers_inverse_sql(x: str, y: str) -> str:
    """CTEs i0 to i6 over a table m (id, cx, cy): longitude, and latitude in radians by six steps."""
    a, e2 = 6_378_137.0, 0.00669438002290
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    p0, p1, p2 = map(math.radians, (50.0, 55.0, 65.0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(math.sin(p2)) - q(math.sin(p1)))
    c = m(p1) ** 2 + n * q(math.sin(p1))
    rho0 = a * math.sqrt(c - n * q(math.sin(p0))) / n
    first = f"i0 as (select *, degrees(atan2({x}, {rho0}::double - {y})) / {n}::double - 154 as lon, ({c}::double - (pow({x}, 2) + pow({rho0}::double - {y}, 2)) * {n * n / (a * a)}::double) / {n}::double as qq from m), j0 as (select *, asin(qq / 2) as p from i0)"
    t = f"(1 - {e2}::double * pow(sin(p), 2))"
    step = f"p + pow({t}, 2) / (2 * cos(p)) * (qq / {1 - e2}::double - sin(p) / {t} + ln((1 - {e}::double * sin(p)) / (1 + {e}::double * sin(p))) / {2 * e}::double)"
    return ", ".join([first, *(f"j{k} as (select * replace ({step} as p) from j{k - 1})" for k in range(1, 7))])


_FLAT = f"c as (select id, {_CORNERS} from p), o as (select id, x0, y0, x1 - x0 as x1, y1 - y0 as y1, x2 - x0 as x2, y2 - y0 as y2, x3 - x0 as x3, y3 - y0 as y3 from c), r as (select *, (x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2) / 2 as a from o), m as (select id, a, x0 + ((x1 + x2) * (x1 * y2 - x2 * y1) + (x2 + x3) * (x2 * y3 - x3 * y2)) / (6 * a) as cx, y0 + ((y1 + y2) * (x1 * y2 - x2 * y1) + (y2 + y3) * (x2 * y3 - x3 * y2)) / (6 * a) as cy from r)"


@query(f"with {_PLACE}, {_FLAT}, {_albers_inverse_sql('cx', 'cy')} select id, round(a)::bigint as area, round(cx)::bigint as cx, round(cy)::bigint as cy, round(lon, 6) as lon, round(degrees(p), 6) as lat from j6")
def equal_area_shapes(spark, d):
    """Area and centroid of shapes in degrees, in the equal-area projection (whole metres), and where that is (six digits)."""
    k, w = F.col("o_orderkey"), F.lit(0.001) * (1 + F.col("o_custkey") % 20)
    lon, lat = F.lit(-165) + k % 300 / F.lit(10.0), F.lit(55) + k % 130 / F.lit(10.0)
    rows = table(spark, d, "orders").select(k.alias("id"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), w.alias("w"))
    corner = lambda sx, sy: geo.albers(F.col("lon") + sx * F.col("w"), F.col("lat") + sy * F.col("w"))
    flat = rows.select("id", F.array(F.array(_ring(*(corner(sx, sy) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)))))).alias("g"))
    # moved to the first corner, where sums of products keep their digits
    first = F.get(F.get(F.get("g", F.lit(0)), F.lit(0)), F.lit(0))
    moved = flat.select("id", first.alias("o"), F.transform("g", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct((q["x"] - first["x"]).alias("x"), (q["y"] - first["y"]).alias("y"))))).alias("g"))
    c = moved.select("id", "o", geo.area("g").alias("a"), geo.centroid("g").alias("c")).select("id", "a", (F.col("o.x") + F.col("c.x")).alias("x"), (F.col("o.y") + F.col("c.y")).alias("y"))
    lon, lat = geo.albers_inverse("x", "y")
    return c.select("id", F.round("a").cast("long").alias("area"), F.round("x").cast("long").alias("cx"), F.round("y").cast("long").alias("cy"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_BOXES = "b as (select s_suppkey as id, s_nationkey as g, s_suppkey % 40 / 10.0::double as x0, s_suppkey % 40 / 10.0::double + 1 + s_suppkey % 3 as x1, s_suppkey % 7 / 10.0::double as y0, s_suppkey % 7 / 10.0::double + 2 as y1 from supplier)"


def boxes(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_nationkey as g", "cast(s_suppkey % 40 / 10.0 as double) as x0", "cast(s_suppkey % 40 / 10.0 + 1 + s_suppkey % 3 as double) as x1", "cast(s_suppkey % 7 / 10.0 as double) as y0", "cast(s_suppkey % 7 / 10.0 + 2 as double) as y1")


@query(f"with {_BOXES}, j as (select a.id as a_id, b.id as b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as s from b a join b on a.g = b.g and a.id < b.id) select a_id, b_id, round(i / (s - i), 6) as iou from j where i > 0")
def convex_overlaps(spark, d):
    """Overlaps of convex shapes of a group, by clipping, or from their sides if both are upright boxes; equal shapes are compared as one, candidates come by cells of their boxes."""
    from ..operators import relational as R

    b = R.alike(boxes(spark, d), "id").withColumn("ring", _box(*map(F.col, ("x0", "y0", "x1", "y1"))))
    b = b.withColumns({"upright": geo.is_upright("ring"), "first": F.array_min("ids")})
    at = lambda s: {k: F.col(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1")}
    # each two kinds of shapes once: overlap is the same both ways
    pairs = R.meeting_boxes(b, b, 2.0, ["g"], spread=8).where("a_first <= b_first")
    iou = F.when(F.col("a_upright") & F.col("b_upright"), geo.box_iou(at("a"), at("b"))).otherwise(geo.convex_iou(F.col("a_ring"), F.col("b_ring")))
    met = pairs.select((F.col("a_first") == F.col("b_first")).alias("own"), "a_ids", "b_ids", F.filter(F.array(iou), lambda x: x > 0).alias("iou")).select("own", "a_ids", "b_ids", F.explode("iou").alias("iou"))
    each = met.select("own", "b_ids", F.round("iou", 6).alias("iou"), F.explode("a_ids").alias("a")).select("own", "a", "iou", F.explode("b_ids").alias("b"))
    return each.where("a.id <> b.id and (not own or a.id < b.id)").select(F.least("a.id", "b.id").alias("a_id"), F.greatest("a.id", "b.id").alias("b_id"), "iou")


@query(f"with {_BOXES}, p as (select c_custkey as id, c_nationkey as g, c_custkey % 97 / 10.0::double as x, c_custkey % 53 / 10.0::double as y from customer) select p.id, min(round(sqrt(pow(greatest(b.x0 - p.x, 0, p.x - b.x1), 2) + pow(greatest(b.y0 - p.y, 0, p.y - b.y1), 2)), 6)) as nearest from p join b using (g) group by p.id")
def distance_to_shapes(spark, d):
    """Distance of points from the nearest shape of their group, 0 inside; by cells, in turns of doubling reach."""
    from ..operators import relational as R

    b = boxes(spark, d).select("g", F.array(F.array(_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))).alias("geom"))
    p = table(spark, d, "customer").selectExpr("c_custkey as id", "c_nationkey as g", "cast(c_custkey % 97 / 10.0 as double) as x", "cast(c_custkey % 53 / 10.0 as double) as y")
    return R.nearest_shapes(p, b, "id", 1.0, ["g"]).select("id", F.round("nearest", 6).alias("nearest")).where("nearest is not null")


@query("with p as (select c_custkey, c_custkey % 3600 / 10.0::double - 180 as lon, c_custkey % 1200 / 10.0::double - 60 as lat from customer) select c_custkey, printf('https://maps.example/#mapCenter=%.5f%%2C%.5f%%2C%d', lon, lat, greatest(10, least(19, cast(round_even(least(log2(156543.03392 * 1280.0 / 111320.0 / 0.04), log2(156543.03392 * 900.0 / 111320.0 * greatest(0.01, cos(radians(lat))) / 0.02)), 0) as int)))) || '&mode=explore' || case when c_custkey % 3 = 0 then '&active=' || c_custkey else '' end as url from p")
def link_conversion(spark, d):
    """Links that frame a box, made into links that are centred."""
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3600 / F.lit(10.0) - 180).alias("lon"), (F.col("c_custkey") % 1200 / F.lit(10.0) - 60).alias("lat"))
    box = F.concat_ws(",", *[L.fixed(x, 2) for x in (F.col("lon") - 0.02, F.col("lat") - 0.01, F.col("lon") + 0.02, F.col("lat") + 0.01)])
    old = F.concat(F.lit("https://maps.example/#"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("active="), F.col("c_custkey").cast("string"), F.lit("&"))).otherwise(""), F.lit("ext="), box)
    return p.select("c_custkey", L.converted(old).alias("url"))


@query("select c_custkey, c_custkey % 30 <= 24 as ok, case when c_custkey % 30 <= 24 then cast(c_custkey % 30 as double) end as zoom, case when c_custkey % 2 = 0 then 'sat' end as base from customer")
def view_states(spark, d):
    """a view's hash written and read; a zoom out of range is no view."""
    k = F.col("c_custkey")
    h = table(spark, d, "customer").select("c_custkey", L.encoded(k % 30, k % 90, k % 180, F.when(k % 2 == 0, "sat")).alias("h"))
    v = L.view_state("h")
    return h.select("c_custkey", v["zoom"].isNotNull().alias("ok"), v["zoom"].alias("zoom"), v["base"].alias("base"))


@query("select doc_id, min(doc_id) over (partition by sha256(text)) as photo_id, min(doc_id) over (partition by sha256(text)) <> doc_id as dedupe from documents")
def content_dedupe(spark, d):
    """Uploads with equal content are one."""
    up = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return E.photos_by_content(up, "text", ["id"]).select(F.col("id").alias("doc_id"), "photo_id", "dedupe")


@query(f"""with {PARTS}, k as (select parent_id, parent_id || '-' || line || '-' || pkey || '-' || skey as id, area, line from parts), u as (select case when line = 7 then -parent_id else parent_id end as parent_id, case when line = 6 then 'new-' else '' end || parent_id || '-' || line || '-' || pkey || '-' || skey as id, area + case when line = 5 then 1 else 0 end as area from parts where line > 2)
select coalesce(k.id, u.id) as id, case when u.parent_id is not null and u.parent_id not in (select parent_id from k) then 'no parent' when k.id is null then 'insert' when u.id is null then 'missing' when k.area <> u.area or k.parent_id <> u.parent_id or k.line = 4 then 'update' else 'unchanged' end as status from k full join u on k.id = u.id""")
def part_diff(spark, d):
    """D3: parts compared with an upload, by shape, columns and parent. Rings that start elsewhere and turn the other way are the same."""
    p = parts(spark, d)
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("parent_id", "line", "pkey", "skey")])
    n, zero = F.col("line"), F.lit(0)
    shape, turned, wider = _box(zero, zero, n, n + 1), _ring((n, n + 1), (n, zero), (zero, zero), (zero, n + 1)), _box(zero, zero, n + 1, n + 1)
    cur = p.select("parent_id", key.alias("id"), "area", shape.alias("geom"))
    up = p.where("line > 2").select(F.when(n == 7, -F.col("parent_id")).otherwise(F.col("parent_id")).alias("parent_id"), F.concat(F.when(n == 6, "new-").otherwise(""), key).alias("id"), (F.col("area") + F.when(n == 5, 1).otherwise(0)).alias("area"), F.when(n == 3, turned).when(n == 4, wider).otherwise(shape).alias("geom"))
    return E.part_diff(cur, up, "id", "parent_id", cur.select("parent_id"), geo.same_shape(F.col("a.geom"), F.col("b.geom")))


@query(f"""with {PARTS}, p as (select parent_id, parent_id * 10 + line as id, min(area) as area, max(pkey) as pkey from parts group by 1, 2), n as (select *, count(*) over (partition by parent_id) as n, pkey % 3 = 0 as leaves from p),
g as (select *, count(*) filter (where leaves) over (partition by parent_id) as g from n), m as (select *, leaves and g < n and pkey % 7 <> 0 as moves from g) select id, case when moves then 'staged' else 'kept' end as place from m""")
def detached_parts(spark, d):
    """Parts moved to staging; a record keeps one part at least, and a name that is taken stays."""
    p = parts(spark, d).groupBy("parent_id", (F.col("parent_id") * 10 + F.col("line")).alias("id")).agg(F.min("area").alias("area"), F.max("pkey").alias("pkey"))
    name = F.concat(F.lit("Part "), F.col("pkey").cast("string"))
    who = p.where("pkey % 3 = 0").select("parent_id", "id", name.alias("name"))
    taken = p.where("pkey % 7 = 0").select(F.upper(name).alias("name")).distinct()
    kept, staged = E.detached(p, p.select("id", "area", "pkey", F.lit("").alias("name")).limit(0), who, "parent_id", "id", taken, "name")
    return kept.select("id", F.lit("kept").alias("place")).unionByName(staged.select("id", F.lit("staged").alias("place")))


@query(f"""with {PARTS}, p as (select parent_id, parent_id * 10 + line as id, min(area) as area, max(line) as line from parts group by 1, 2) select id, case when line = 2 and abs(area / 2 - area) > 20000 then area / 2 else area end as area from p where line <> 3 union all select -id, area - 30000 from p where line = 4 and area - 30000 >= 1""")
def saved_parts(spark, d):
    """A record's parts after an edit: some go, changes below a floor are none, and new ones need an area."""
    p = parts(spark, d).groupBy("parent_id", (F.col("parent_id") * 10 + F.col("line")).alias("id")).agg(F.min("area").alias("area"), F.max("line").alias("line"))
    up = p.where("line = 2").select("id", (F.col("area") / 2).alias("new_area"))
    new = p.where("line = 4").select("parent_id", (-F.col("id")).alias("id"), (F.col("area") - 30000).alias("area"), "line")
    return E.saved(p, up, p.where("line = 3"), new, "id", F.abs(F.col("new_area") - F.col("area")) > 20000, F.col("area") >= 1).select("id", "area")


@query("select c_custkey as key, case when o.v is not null then o.v else c_name end as value from customer left join (select o_custkey, 'order ' || max(o_orderkey) as v from orders group by 1) o on o_custkey = c_custkey")
def settings_update(spark, d):
    """Known keys take the posted value; posted keys that aren't known are left out."""
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    posted = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.concat(F.lit("order "), F.max("o_orderkey").cast("string")).alias("value"))
    return E.settings(current, posted.unionByName(posted.select((-F.col("key") - 1).alias("key"), "value")))


@query("select distinct o_custkey as key from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def not_cached_keys(spark, d):
    """Distinct keys that the cache has not."""
    cached = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return E.not_cached(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), cached, "key")


@query("select c_custkey, case when c_custkey % 4 < 2 then 'story-' || c_custkey || '_a' end as slug from customer")
def story_slugs(spark, d):
    """F8: a story's name from its link, null where it isn't one."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("story-"), k.cast("string"), F.lit("_a"))
    prefix = "https://stories.example/s/"
    link = F.when(k % 4 == 0, F.concat(F.lit(f" {prefix}"), name, F.lit("/?q=1#x "))).when(k % 4 == 1, F.concat(F.lit(prefix), name)).when(k % 4 == 2, F.concat(F.lit(prefix), F.lit("../"), name)).otherwise(F.concat(F.lit("http://other.example/"), name))
    return table(spark, d, "customer").select("c_custkey", L.story_slug(link, prefix).alias("slug"))


@query(f"""with {PARTS}, s as (select pkey, row_number() over (partition by pkey order by parent_id, line) as id, role, parent_id % 100 * 100.0::double as x, skey % 10 * 100.0::double as y from parts), e as (select p_partkey as k, p_size % 50 * 200.0::double as ex, p_size * 100.0::double as ey from part where p_size > 25),
a as (select s.pkey, max(sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2))) as span from s join s t on s.pkey = t.pkey and s.id < t.id group by 1), g as (select pkey, count(*) as n_parts, count(distinct role) as roles, avg(x) as sx, avg(y) as sy from s group by 1)
select g.pkey, n_parts, e.k as attach_to, n_parts > 4 as many, roles < n_parts as repeated, e.k is null and coalesce(span, 0) > 5000 as dispersed, coalesce(sqrt(pow(sx - ex, 2) + pow(sy - ey, 2)) > 5000, false) as far from g left join a using (pkey) left join e on e.k = g.pkey""")
def staging_preview(spark, d):
    """Staged parts by name, the record they would be added to, and what to be warned of."""
    w = Window.partitionBy("pkey").orderBy("parent_id", "line")
    s = parts(spark, d).withColumn("id", F.row_number().over(w)).select(F.col("pkey").cast("string").alias("name"), "id", "role", (F.col("parent_id") % 100 * 100).cast("double").alias("x"), (F.col("skey") % 10 * 100).cast("double").alias("y"))
    known = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") % 50 * 200).cast("double").alias("x"), (F.col("p_size") * 100).cast("double").alias("y"))
    p = E.preview(s, known, "name", "role", lambda a, b, c, e: F.hypot(F.col(a) - F.col(c), F.col(b) - F.col(e)))
    has = lambda w: F.array_contains("warnings", w)
    return p.select(F.col("name").cast("long").alias("pkey"), "n_parts", "attach_to", has("many parts").alias("many"), has("repeated roles").alias("repeated"), has("parts far apart").alias("dispersed"), has("far from that record").alias("far"))


@query("with q as (select l_orderkey, 'base name of ''' || p_name || ''' - look' as reason from lineitem join part on l_partkey = p_partkey) select q.l_orderkey, min(p.p_partkey) as ref_id from q join part p on q.reason = 'base name of ''' || p.p_name || ''' - look' group by q.l_orderkey, q.reason")
def reason_lookup(spark, d):
    """The record that a reason names, found by its exact name."""
    from ..operators import relational as R

    p = table(spark, d, "part")
    l = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.concat(F.lit("base name of '"), "p_name", F.lit("' - look")).alias("reason"))
    return R.named_in(l.distinct(), "reason", "'(.*)'", p, "p_name", "p_partkey").select("l_orderkey", "ref_id")


@query("select c_custkey, c_name, o_orderkey, o_totalprice from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) o on o_custkey = c_custkey and rn = 1")
def listing(spark, d):
    """A page's rows, with what another table has of them."""
    newest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    c = table(spark, d, "customer")
    return c.join(newest, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o.o_orderkey", "o.o_totalprice")


@query(f"with {PARTS} select parent_id, round(sum(area * (pkey % 100)) / sum(area), 6) as x, round(sum(area * (skey % 100)) / sum(area), 6) as y from parts group by 1")
def gathered_centres(spark, d):
    """Centre of a record's parts, by area."""
    from ..operators import relational as R

    p = parts(spark, d).select("parent_id", "area", (F.col("pkey") % 100).cast("double").alias("x"), (F.col("skey") % 100).cast("double").alias("y"))
    return R.gathered_centre(p, "parent_id", "x", "y", "area").select("parent_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("select event_id, case when abs(v) <= 300 then v end as v from (select event_id, coalesce(case when event_id % 3 = 0 then value end, value * 2 + coalesce(case when event_id % 2 = 0 then 5.0::double end, 0)) as v from events)")
def field_values(spark, d):
    """Recent where present, else annual with its season, within bounds."""
    from ..functions import scalars as S

    e = table(spark, d, "events")
    k, v = F.col("event_id"), F.col("value")
    return e.select("event_id", S.field_value(F.when(k % 3 == 0, v), v * 2, F.when(k % 2 == 0, F.lit(5.0)), 300.0).alias("v"))


@query(f"""with {PARTS} select parent_id || '-' || line || '-' || pkey || '-' || skey as id, case when line % 4 = 0 then 'sides cross' when line % 4 = 1 and pkey % 2 = 0 then 'no area' when line % 4 = 2 and pkey % 2 = 0 then 'too few points' end as problem from parts""")
def shape_problems(spark, d):
    """why a shape isn't valid."""
    n, zero = F.col("line"), F.lit(0)
    box, bow = _box(zero, zero, n, n + 1), _ring((zero, zero), (n, n), (n, zero), (zero, n))
    flat, few = _ring((zero, zero), (n, n), (n + 1, n + 1)), _ring((zero, zero), (n, n), (zero, zero))
    shape = F.when(n % 4 == 0, bow).when((n % 4 == 1) & (F.col("pkey") % 2 == 0), flat).when((n % 4 == 2) & (F.col("pkey") % 2 == 0), few).otherwise(box)
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("parent_id", "line", "pkey", "skey")])
    return parts(spark, d).select(key.alias("id"), geo.problem(F.array(F.array(shape))).alias("problem"))


@query("""with p as (select c_custkey as id, c_custkey % 300 - 150.0::double as lon, c_custkey % 40 + 45.0::double as lat, 0.5::double + c_custkey % 7 as w from customer),
h as (select *, 2 * 6371008.8::double * asin(sqrt(pow(sin(radians(w) / 2), 2))) as north, 2 * 6371008.8::double * asin(sqrt(pow(cos(radians(lat)) * sin(radians(w) / 2), 2))) as east from p),
t as (select *, tan(pi() / 4 - radians(lat) / 2) / pow((1 - sqrt(0.00669437999014::double) * sin(radians(lat))) / (1 + sqrt(0.00669437999014::double) * sin(radians(lat))), sqrt(0.00669437999014::double) / 2) as t,
  tan(pi() / 4 - radians(70) / 2) / pow((1 - sqrt(0.00669437999014::double) * sin(radians(70))) / (1 + sqrt(0.00669437999014::double) * sin(radians(70))), sqrt(0.00669437999014::double) / 2) as tc, cos(radians(70)) / sqrt(1 - 0.00669437999014::double * pow(sin(radians(70)), 2)) as mc from h),
m as (select *, id % 100 / 100.0::double as row_, atan((exp(pi() * (1 - 2 * (id % 100 / 100.0::double))) - exp(-pi() * (1 - 2 * (id % 100 / 100.0::double)))) / 2) as ml from t)
select id, round(north + east, 2) as path, round(radians(w) * (sin(radians(lat + w)) - sin(radians(lat))) * pow(6378137.0::double, 2) / 1e6, 3) as km2, round(6378137.0::double * mc / tc * t * sin(radians(lon + 45)), 2) as x, round(-6378137.0::double * mc / tc * t * cos(radians(lon + 45)), 2) as y,
  round(0.5 - ln(tan(pi() / 4 + ml / 2) * pow((1 - 0.0818191908426215::double * sin(ml)) / (1 + 0.0818191908426215::double * sin(ml)), 0.0818191908426215::double / 2)) / (2 * pi()), 9) as shifted from m""")
def map_measures(spark, d):
    """Length of a drawn line and area of a drawn cell on a sphere, polar map coordinates, and rows of the ellipsoidal map."""
    from ..functions import scalars as S

    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (k % 300 - 150).cast("double").alias("lon"), (k % 40 + 45).cast("double").alias("lat"), (F.lit(0.5) + k % 7).alias("w"))
    lon, lat, w = F.col("lon"), F.col("lat"), F.col("w")
    line = _ring((lon, lat + w), (lon, lat), (lon + w, lat))
    x, y = geo.polar_stereographic("lon", "lat")
    return p.select("id", F.round(geo.ring_length(line, lambda a, b, c, e: S.haversine(a, b, c, e, 6_371_008.8)), 2).alias("path"), F.round(geo.spherical_area(_box(lon, lat, lon + w, lat + w)) / 1e6, 3).alias("km2"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(L.mercator_shift(F.col("id") % 100 / F.lit(100.0)), 9).alias("shifted"))


@query("with p as (select c_custkey, c_custkey % 3600 / 10.0::double - 180 as lon, c_custkey % 100 / 10.0::double as lat from customer) select c_custkey, '{\"a\": \"https://maps.example/#mapCenter=' || printf('%.5f%%2C%.5f%%2C%d', lon, lat, greatest(10, least(19, cast(round_even(least(log2(156543.03392 * 1280.0 / 111320.0 / 0.04), log2(156543.03392 * 900.0 / 111320.0 * greatest(0.01, cos(radians(lat))) / 0.02)), 0) as int)))) || '&mode=explore\", \"b\": \"https://o.example/?ext=1 ' || c_name || '\"}' as doc, 1 as n from p join customer using (c_custkey)")
def patched_documents(spark, d):
    """Links inside frozen documents, converted in place and counted; the rest stays."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select("c_custkey", "c_name", (k % 3600 / F.lit(10.0) - 180).alias("lon"), (k % 100 / F.lit(10.0)).alias("lat"))
    box = F.concat_ws(",", *[L.fixed(x, 2) for x in (F.col("lon") - 0.02, F.col("lat") - 0.01, F.col("lon") + 0.02, F.col("lat") + 0.01)])
    doc = F.concat(F.lit('{"a": "https://maps.example/#ext='), box, F.lit('", "b": "https://o.example/?ext=1 '), F.col("c_name"), F.lit('"}'))
    return p.select("c_custkey", L.patched(doc).alias("doc"), L.n_patched(doc).cast("int").alias("n"))


@query(f"""with {PARTS}, l as (select distinct parent_id as rec, pkey as photo from parts), g as (select distinct parent_id as rec, pkey as photo from parts where role = 'deposit'), k as (select * from l except select * from g), o as (select rec, photo, row_number() over (partition by rec order by photo) - 1 as pos from k)
select 'link' as what, rec, photo, case when rec % 3 = 0 then pos else -1 end as sort_order from o union all select 'photo', null, photo, null from (select distinct photo from l) p where photo not in (select photo from g) or photo in (select photo from k)""")
def photo_links(spark, d):
    """Links taken off, photos that lose their last link with them, and a record's photos put in a posted order."""
    p = parts(spark, d)
    links = p.select(F.col("parent_id").alias("rec"), F.col("pkey").alias("photo")).distinct().withColumn("sort_order", F.lit(-1))
    gone = p.where("role = 'deposit'").select(F.col("parent_id").alias("rec"), F.col("pkey").alias("photo")).distinct()
    left, photos = E.unlinked(links, gone, links.select("photo").distinct(), "rec", "photo")
    wanted = left.where("rec % 3 = 0").groupBy("rec").agg(F.sort_array(F.collect_list("photo")).alias("photos"))
    out = E.reordered(left, wanted, "rec", "photo").select(F.lit("link").alias("what"), "rec", "photo", "sort_order")
    return out.unionByName(photos.select(F.lit("photo").alias("what"), F.lit(None).cast("long").alias("rec"), "photo", F.lit(None).cast("int").alias("sort_order")))


@query("select o_orderkey as id, coalesce(case when o_orderkey % 3 <> 0 then cast(o_orderdate as date) end, date '2000-01-01') as reviewed_at, case when o_orderkey % 5 = 0 then 'by hand' else 'order of ' || o_custkey end as story from orders")
def backfill(spark, d):
    """Dates where there are none, and stamps but where someone has set them."""
    from ..operators import merge as M

    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("id"), F.when(k % 3 != 0, F.col("o_orderdate").cast("date")).alias("reviewed_at"), F.when(k % 5 == 0, "by hand").alias("story"), F.when(k % 5 == 0, True).alias("manual"), "o_custkey")
    out = M.backfilled(o, {"reviewed_at": F.lit("2000-01-01").cast("date")})
    return M.backfilled(out, {"story": F.concat(F.lit("order of "), F.col("o_custkey").cast("string"))}, "manual").select("id", "reviewed_at", "story")
