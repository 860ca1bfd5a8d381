"""Queries on the relational operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, predicates as P, scalars as S
from ..operators import merge as M, relational as R, rules as U
from ..session import table
from .roles import DATED, PARTS, RECORDS, YEAR_CODE, dated, parts, records

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ROLES = ("body", "source", "deposit")


@query(f"""with {PARTS}, {RECORDS}, s as (select r.kind, r.cls, sum(area) filter (where role = 'body') as b, sum(area) filter (where role = 'source') as s, sum(area) filter (where role = 'deposit') as d
  from records r left join parts p on p.parent_id = r.id where reviewed_at is not null and deprecated_at is null group by r.id, r.kind, r.cls)
select kind, coalesce(cls, '__unclassified__') as cls, count(*) as n, count(*) filter (where case kind when 'slow' then coalesce(b, 0) >= 50000 when 'catastrophic' then coalesce(s, 0) >= 50000 or coalesce(d, 0) >= 100000 end) as n_large from s group by 1, 2""")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """Public records by kind and class, and how many are large by the areas of their parts."""
    sums = R.role_sums(parts(spark, d), "parent_id", "role", "area", ROLES)
    live = records(spark, d).where(P.is_public())
    all_ = live.join(sums, live["id"] == sums["parent_id"], "left").withColumn("large", U.size_inclusion(limits=(50_000.0, 50_000.0, 100_000.0)))
    return all_.groupBy("kind", P.or_unclassified("cls").alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.count_if("large").alias("n_large"))


@query(f"with {RECORDS} select count(*) filter (where cls is null) as unclassified, count(*) filter (where coalesce(flagged, false)) as flagged, count(*) filter (where reviewed_at is null and deprecated_at is null) as pending, count(*) as n from records")
def status_totals(spark, d):
    """A2 A4 P9 P26."""
    return records(spark, d).agg(F.count_if(F.col("cls").isNull()).alias("unclassified"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"), F.count_if(P.is_pending()).alias("pending"), F.count(F.lit(1)).alias("n"))


@query(f"with {RECORDS} select s.status, count(*) as n from records, (values ('pending'), ('active'), ('deprecated'), ('all'), ('')) s(status) where case s.status when 'pending' then reviewed_at is null and deprecated_at is null when 'active' then reviewed_at is not null and deprecated_at is null when 'deprecated' then deprecated_at is not null when 'all' then true else deprecated_at is null end group by 1")
def status_buckets(spark, d):
    """Records in each status."""
    names = ("pending", "active", "deprecated", "all", "")
    return records(spark, d).select(F.explode(F.filter(F.array(*[F.when(P.in_status(s), F.lit(s)) for s in names]), lambda x: x.isNotNull())).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("with p as (select p_partkey, p_name from part) select p_partkey, p_name from p where p_name ilike '%l_ r%' or p_name ilike '%widget%'")
def name_search(spark, d):
    """P4."""
    return table(spark, d, "part").where(P.name_like("p_name", "L_ R") | P.name_like("p_name", "widget")).select("p_partkey", "p_name")


@query(f"with {DATED} select id, {YEAR_CODE} as year_code, coalesce(year(seismic_at), case when regexp_full_match(trim(year_text), '[0-9]{{4}}') then cast(trim(year_text) as int) end, case when year_text ilike '%holocene%' then -1 end, case when year_text ilike '%modern%' then 0 end, year(date_min)) as era from dated")
def year_codes(spark, d):
    """P6 and the era of the rules, which differ on purpose (Q-era)."""
    return dated(spark, d).select("id", P.year_code().alias("year_code"), U.era().alias("era"))


@query(f"""with {DATED} select id, kind, case when kind = 'slow' then volume end as area_src, case when kind = 'catastrophic' then volume end as area_dep, cls is not null as has_class, date_min is not null and date_max is not null as has_bracket, seismic_at is not null as has_seismic,
  date_diff('day', date_min, date_max) + 1 as span, dayofyear(date_min) as doy, coalesce(flagged, false) as is_flagged from dated where reviewed_at is not null and deprecated_at is null""")
def filter_projection(spark, d):
    """The columns that filters on points and shapes share."""
    x = dated(spark, d).where(P.is_public())
    return x.select("id", "kind", F.when(F.col("kind") == "slow", F.col("volume")).alias("area_src"), F.when(F.col("kind") == "catastrophic", F.col("volume")).alias("area_dep"), F.col("cls").isNotNull().alias("has_class"), (F.col("date_min").isNotNull() & F.col("date_max").isNotNull()).alias("has_bracket"), F.col("seismic_at").isNotNull().alias("has_seismic"), S.span_days("date_min", "date_max").alias("span"), F.dayofyear("date_min").alias("doy"), F.coalesce("flagged", F.lit(False)).alias("is_flagged"))


@query(f"""with {PARTS}, {RECORDS}, s as (select parent_id, sum(area) filter (where role = 'source') as s, sum(area) filter (where role = 'deposit') as d from parts group by parent_id)
select id, kind from records left join s on id = parent_id where s >= 20000 and s <= 90000 and (kind = 'slow' or d >= 10000)""")
def dual_range_filter(spark, d):
    """Ranges on source and deposit; slow records pass the second."""
    r = records(spark, d)
    s = R.role_sums(parts(spark, d), "parent_id", "role", "area", ("source", "deposit"))
    return r.join(s, r["id"] == s["parent_id"], "left").where(P.dual_range("area_source", "area_deposit", "kind", 20_000, 90_000, 10_000, None)).select("id", "kind")


@query(f"with {RECORDS} select kind, count(*) filter (where case when id % 6 <> 0 then volume end >= 20000 and case when id % 6 <> 0 then volume end <= 200000 and lat <= 50) as n_in, count(*) filter (where lat >= 0) as n_north, count(*) as n from records group by kind")
def box_counts(spark, d):
    """P25: records in a box of two values, whose unset sides let all pass and whose set sides fail null."""
    r = records(spark, d).withColumn("v", F.when(F.col("id") % 6 != 0, F.col("volume")))
    return r.groupBy("kind").agg(F.count_if(P.in_box("v", "lat", 20_000, 200_000, None, 50)).alias("n_in"), F.count_if(P.in_box("v", "lat", y0=0)).alias("n_north"), F.count(F.lit(1)).alias("n"))


@query(f"with {RECORDS} select id, (case when coalesce(flagged, false) then 1 else 0 end) + (case when cls is null then 2 else 0 end) + (case when seismic_at is not null then 4 else 0 end) as bits, (seismic_at is not null and coalesce(flagged, false)) as both from records")
def flag_bitmask(spark, d):
    """P13 P14."""
    r = records(spark, d).withColumn("bits", P.packed_bits(["flagged", F.col("cls").isNull(), F.col("seismic_at").isNotNull()]))
    return r.select("id", "bits", P.has_bits("bits", 5).alias("both"))


@query(f"with {RECORDS} select kind, count(*) as n from records where ((lon >= 174 or lon <= -176)) and lat between -60 and 60 group by kind")
def in_view_counts(spark, d):
    """A view over the antimeridian."""
    return R.counts_by(records(spark, d).where(P.in_view("lon", "lat", 174, -60, 184, 60)), "kind")


@query(f"with {DATED} select id, case when seismic_at is null then case when date_max is not null and date_min is null then 'only a last date' when date_min is not null and date_max is null then 'only a first date' when date_min is null and date_max is null and regexp_full_match(year_text, '[0-9]{{4}}') then 'year without bracket' end end as weak, ({YEAR_CODE}) is null as undated, (seismic_at is not null or date_max >= date_min) as is_dated from dated")
def timing_scans(spark, d):
    """P17 P18 P19."""
    return dated(spark, d).select("id", P.weak_timing().alias("weak"), P.is_undated().alias("undated"), P.is_dated().alias("is_dated"))


@query(f"with {RECORDS} select id, case cls when '1-URGENT' then 0 when '2-HIGH' then 1 when '4-NOT SPECIFIED' then 2 else 3 end as draw from records")
def draw_order(spark, d):
    """P27 P28."""
    return records(spark, d).select("id", P.draw_order("cls", ("1-URGENT", "2-HIGH", "4-NOT SPECIFIED")).alias("draw"))


@query("select event_id, case when value between 5 and 400 then value end as value, case when value > 100 then true when value is not null then false end as fast from events")
def plausibility(spark, d):
    """P21 P23 P29."""
    e = table(spark, d, "events")
    return e.select("event_id", P.plausible("value", 5, 400).alias("value"), (F.col("value") > 100).alias("fast"))


# joins

@query(f"with {PARTS}, {RECORDS} select kind, role, count(*) as n, round(sum(area), 2) as area from parts join records on id = parent_id group by kind, role")
def inner_join(spark, d):
    """J1."""
    p = parts(spark, d)
    return p.join(records(spark, d), F.col("id") == F.col("parent_id")).groupBy("kind", "role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 2).alias("area"))


@query(f"with {PARTS}, {RECORDS} select id, round(sum(area) filter (where role = 'body'), 2) as area_body, round(sum(area) filter (where role = 'source'), 2) as area_source, round(sum(area) filter (where role = 'deposit'), 2) as area_deposit, count(parent_id) as n_parts from records left join parts on id = parent_id group by id")
def left_join_role_sums(spark, d):
    """Records without parts are kept, with null sums."""
    p = parts(spark, d).groupBy("parent_id").agg(*[F.round(F.sum(F.when(F.col("role") == r, F.col("area"))), 2).alias(f"area_{r}") for r in ROLES], F.count(F.lit(1)).alias("n_parts"))
    r = records(spark, d)
    return r.join(p, r["id"] == p["parent_id"], "left").select("id", "area_body", "area_source", "area_deposit", F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


@query(f"with {PARTS}, {RECORDS} select n.n_name as subset, count(*) as n from records join (select distinct parent_id, skey from parts) b on b.parent_id = id join supplier s on s.s_suppkey = b.skey join nation n on n.n_nationkey = s.s_nationkey where reviewed_at is not null group by 1")
def bridge_join(spark, d):
    """Many to many; a record counts once for each bridge row."""
    b = parts(spark, d).select("parent_id", "skey").distinct()
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("subset"))
    return records(spark, d).where("reviewed_at is not null").join(b, F.col("id") == F.col("parent_id")).join(s, F.col("skey") == F.col("s_suppkey")).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PARTS}, {RECORDS} select id, exists (select 1 from parts where parent_id = id and role = 'deposit') as has_deposit, not exists (select 1 from parts where parent_id = id) as empty_ from records where exists (select 1 from parts where parent_id = id and area > 60000) or id not in (select parent_id from parts)")
def semi_anti_exists(spark, d):
    """One aggregate per parent tells what exists, and one left join."""
    p = parts(spark, d).groupBy(F.col("parent_id").alias("id")).agg(F.bool_or(F.col("area") > 60000).alias("large"), F.bool_or(F.col("role") == "deposit").alias("deposit"))
    both = records(spark, d).join(p, "id", "left").where("large is null or large")
    return both.select("id", F.coalesce("deposit", F.lit(False)).alias("has_deposit"), F.col("large").isNull().alias("empty_"))


@query(f"with {PARTS} select parent_id, role, line, pkey, skey, area from (select *, row_number() over (partition by parent_id order by case role when 'deposit' then 0 when 'source' then 1 else 2 end, is_primary desc nulls last, line, pkey, skey) as rn from parts) where rn = 1")
def lateral_top_one(spark, d):
    """One representative part per record."""
    return R.representative(parts(spark, d), "parent_id", "role", "is_primary", ("deposit", "source"), ("line", "pkey", "skey")).select("parent_id", "role", "line", "pkey", "skey", "area")


@query(f"""with {PARTS}, {RECORDS} select id, cast(coalesce(n, 0) as bigint) as n, slugs from records left join (select parent_id, count(*) as n, array_to_string(list_sort(list(distinct role)), ',') as slugs from parts group by parent_id) on id = parent_id""")
def scalar_aggregates(spark, d):
    """Aggregates per outer row, computed once per key and joined."""
    p = parts(spark, d).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("slugs"))
    r = records(spark, d)
    return r.join(p, r["id"] == p["parent_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "slugs")


@query(f"""with {RECORDS}, box as (select n_nationkey as k, n_name as name, cast(n_nationkey * 14 - 180 as double) as x0, cast(n_nationkey * 14 - 160 as double) as x1, cast(-80 + n_nationkey * 3 as double) as y0, cast(n_nationkey * 3 as double) as y1 from nation)
select r.id, min(b.name) as country, count(b.name) as n_covering from records r left join box b on r.lon between b.x0 and b.x1 and r.lat between b.y0 and b.y1 and not (r.lon > b.x0 + 5 and r.lon < b.x0 + 10 and r.lat > b.y0 + 20 and r.lat < b.y0 + 40) group by r.id""")
def point_in_polygon(spark, d):
    """The country that covers a point; boundaries count, holes don't, the first name wins. Shapes are cut into cells of five degrees."""
    c = lambda x: x.cast("double")
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    x0, x1, y0, y1 = c(k * 14 - 180), c(k * 14 - 160), c(k * 3 - 80), c(k * 3)
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = lambda a, b, e, f: F.array(pt(a, b), pt(e, b), pt(e, f), pt(a, f), pt(a, b))
    shapes = n.select(F.col("n_name").alias("name"), F.array(F.array(ring(x0, y0, x1, y1), ring(x0 + 5, y0 + 20, x0 + 10, y0 + 40))).alias("geom"))
    r = records(spark, d).select("id", "lon", "lat")
    hit = R.covering_shapes(r, shapes, 5.0, "lon", "lat").groupBy("id").agg(F.min("name").alias("country"), F.count("name").alias("n_covering"))
    return r.select("id").join(hit, "id", "left").select("id", "country", F.coalesce("n_covering", F.lit(0)).alias("n_covering"))


_HAV = "case when a.lon is not null and b.lon is not null then 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) end"
_SITES = """sites as (select s_suppkey as id, s_suppkey * 7919 % 36000 / 100.0 - 180 as lon, s_suppkey * 104729 % 16000 / 100.0 - 80 as lat from supplier),
  pts as (select c_custkey as id, c_custkey * 7907 % 36000 / 100.0 - 180 as lon, c_custkey * 104723 % 16000 / 100.0 - 80 as lat from customer)"""


@query(f"with {_SITES} select a.id as lid, b.id as rid, round({_HAV}, 1) as metres from sites a join pts b on abs(a.lat - b.lat) < 1 where {_HAV} <= 50000")
def distance_join(spark, d):
    """Pairs within 50 km, by grid cells and then the distance."""
    a = table(spark, d, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 7919 % 36000 / 100.0 - 180 as double) as lon", "cast(s_suppkey * 104729 % 16000 / 100.0 - 80 as double) as lat")
    b = table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_custkey * 7907 % 36000 / 100.0 - 180 as double) as lon", "cast(c_custkey * 104723 % 16000 / 100.0 - 80 as double) as lat")
    return R.near_pairs(a, b, "id", "id", 50_000, S.haversine).select("lid", "rid", F.round("metres", 1).alias("metres"))


@query(f"with {RECORDS} select a.owner_id, count(*) as n_pairs, round(max({_HAV})) as widest from records a join records b on a.owner_id = b.owner_id and a.id < b.id where a.cls = b.cls group by 1")
def ordered_self_join(spark, d):
    """Pairs of one owner and class, a before b."""
    a = records(spark, d).select("owner_id", "cls", F.col("id").alias("ida"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    b = records(spark, d).select("owner_id", "cls", F.col("id").alias("idb"), F.col("lon").alias("blon"), F.col("lat").alias("blat"))
    return a.join(b, ["owner_id", "cls"]).where("ida < idb").groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.max(S.haversine("alon", "alat", "blon", "blat"))).alias("widest"))


@query(f"with {RECORDS}, a as (select owner_id, avg(lon) as lon, avg(lat) as lat from records where kind = 'slow' group by 1), b as (select owner_id, avg(lon) as lon, avg(lat) as lat from records where kind = 'catastrophic' group by 1) select a.owner_id, round({_HAV}) as apart from a left join b using (owner_id)")
def group_distance(spark, d):
    """How far two groups of a name lie apart; both sides are aggregated before the join."""
    side = lambda kind, x: records(spark, d).where(F.col("kind") == kind).groupBy("owner_id").agg(F.avg("lon").alias(f"{x}lon"), F.avg("lat").alias(f"{x}lat"))
    return side("slow", "a").join(side("catastrophic", "b"), "owner_id", "left").select("owner_id", F.round(S.haversine("alon", "alat", "blon", "blat")).alias("apart"))


@query("""with n as (select distinct p_name || ' ' || lower(p_type) as name from part union select distinct p_name from part union select distinct p_name || ' ' || lower(p_type) || ' a b c d e f' from part where p_size > 25) select a.name as short_id, b.name as long_id from n a join n b on starts_with(b.name, a.name || ' ')""")
def token_prefix_join(spark, d):
    """Names that begin another, word by word."""
    p = table(spark, d, "part")
    long = F.concat_ws(" ", "p_name", F.lower("p_type"))
    names = p.select(long.alias("name")).union(p.select("p_name")).union(p.where("p_size > 25").select(F.concat(long, F.lit(" a b c d e f")))).distinct()
    return R.token_prefix_pairs(names, "name", "name")


_NAMES = "names as (select distinct p_name || case p_size % 10 when 0 then '' when 1 then ' ' || (2000 + p_size) when 2 then ' Holocene' when 3 then ' ' || p_size when 4 then ' ~ x' when 5 then ' A' when 6 then ' Holocene A' when 7 then ' trib' when 8 then ' X' else ' upper' end as name from part)"


def names(spark, d):
    tail = "case p_size % 10 when 0 then '' when 1 then concat(' ', 2000 + p_size) when 2 then ' Holocene' when 3 then concat(' ', p_size) when 4 then ' ~ x' when 5 then ' A' when 6 then ' Holocene A' when 7 then ' trib' when 8 then ' X' else ' upper' end"
    return table(spark, d, "part").selectExpr(f"concat(p_name, {tail}) as name").distinct()


@query(f"""with {_NAMES}, t as (select name, lower(name) as k, string_split(lower(name), ' ') as t from names),
p as (select a.name, b.name as longer, b.t[len(a.t) + 1] as extra, a.t[len(a.t)] as tail from t a join t b on starts_with(b.k, a.k || ' ')),
q as (select name, case when regexp_full_match(extra, '[a-z]') and regexp_full_match(tail, '([0-9]{{4}}|holocene|modern)([.][0-9]+)?') then 'first of repeats' else 'base of another name' end as r, row_number() over (partition by name order by longer) as rn from p where not regexp_full_match(extra, '([0-9]{{4}}|holocene|modern)([.][0-9]+)?') and not regexp_full_match(extra, '[0-9]+') and extra <> '~')
select t.name, coalesce(case when regexp_matches(t.name, '(?i)\\b(trib(utary)?|neighbou?r)\\b') then 'weakly tied' end, case when list_contains(t.t, 'x') then 'lone x' end, q.r, case when regexp_matches(t.k, ' ([0-9]{{4}}|holocene|modern)([.][0-9]+)? [a-z]( |$)') then 'letter after a time' end) as reason from t left join q on q.name = t.name and q.rn = 1""")
def name_scan(spark, d):
    """Reasons to look at a name, the first of four scans wins."""
    return M.name_reasons(names(spark, d), "name", "name").select("name", "reason")


@query("with a as (select r_name, n_name, lower(regexp_replace(trim(n_name), '\\s+', ' ', 'g')) as k from nation join region on n_regionkey = r_regionkey) select k, count(*) as n, min(r_name) as region from a join supplier on s_nationkey = (select n_nationkey from nation where nation.n_name = a.n_name) group by k")
def name_key_join(spark, d):
    """A join on normalised names; the small side is found small at run time."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(S.name_key("n_name").alias("k"), F.col("r_name"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(S.name_key("n_name").alias("k"))
    return s.join(n, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("r_name").alias("region"))


@query(f"with {RECORDS} select k.kind, r.r_name, count(x.id) as n from (select distinct kind from records) k cross join region r left join (select records.id, records.kind, n_regionkey from records join customer on c_custkey = owner_id join nation on n_nationkey = c_nationkey) x on x.kind = k.kind and x.n_regionkey = r.r_regionkey group by 1, 2")
def counts_for_every_pair(spark, d):
    """Counts for every kind and region, 0 where none; the dimension is 5 regions by the kinds."""
    r = records(spark, d)
    regions = table(spark, d, "region").select("r_name", "r_regionkey")
    where = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    x = r.join(where, F.col("owner_id") == F.col("c_custkey"))
    dim = r.select("kind").distinct().join(regions.select("r_name"), how="cross")
    return R.counts_with_zeros(x, dim, "kind", "r_name")


@query("""with r as (select user_id, epoch_us(ts) as at, min(value) as value from events where event_type = 'purchase' group by 1, 2),
x as (select e.event_id, r.value, row_number() over (partition by e.event_id order by abs(r.at - epoch_us(e.ts)), r.at) as rn from events e left join r on r.user_id = e.user_id where e.event_type = 'error')
select event_id, value from x where rn = 1""")
def nearest_in_time(spark, d):
    """For each error the value of the nearest purchase of the same cell in time."""
    e = table(spark, d, "events").select(F.col("user_id").alias("cell"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value", "event_id")
    left, right = e.where("event_type = 'error'").select("event_id", "cell", "at"), e.where("event_type = 'purchase'").groupBy("cell", "at").agg(F.min("value").alias("value"))
    return R.nearest(left, right, "cell", "at", "value").select("event_id", "value")


@query(f"with {PARTS}, {RECORDS}, iv as (select parent_id, min(day) as d0, max(day) as d1 from parts group by 1) select r.day as at, count(*) as n from iv join (select distinct day from records) r on r.day between d0 and d1 group by 1")
def interval_stab(spark, d):
    """P20: intervals that hold a day, by buckets of the start."""
    iv = parts(spark, d).groupBy("parent_id").agg(F.unix_date(F.min("day")).alias("d0"), F.unix_date(F.max("day")).alias("d1"))
    at = records(spark, d).select(F.unix_date("day").alias("at")).distinct()
    return R.stab(iv, at, "d0", "d1", "at", 366).groupBy(F.date_from_unix_date("at").alias("at")).agg(F.count(F.lit(1)).alias("n"))


# order-dependent picks, top-k, sets

@query(f"with {PARTS}, {RECORDS}, k as (select p.*, case when kind = 'catastrophic' then 'source' else 'body' end as want from parts p join records on id = parent_id), w as (select *, row_number() over (partition by parent_id, role order by is_primary desc nulls last, line, pkey, skey) as rn from k) select parent_id, line, pkey, skey, role = want and rn = 1 as new_primary, coalesce(is_primary, false) <> (role = want and rn = 1) as changed from w")
def primary_normalisation(spark, d):
    """Of the parts with the kind's primary role the first is primary, all others aren't."""
    kinds = records(spark, d).select(F.col("id").alias("parent_id"), F.when(F.col("kind") == "catastrophic", "source").otherwise("body").alias("want"))
    p = parts(spark, d).join(kinds, "parent_id")
    return R.primary_flags(p, "parent_id", "role", "is_primary", ("line", "pkey", "skey"), F.col("want")).select("parent_id", "line", "pkey", "skey", "new_primary", "changed")


@query("with s as (select p_partkey, lower(trim(regexp_replace(p_type || ' ' || p_brand, '[^A-Za-z0-9]+', '-', 'g'), '-')) as slug from part), w as (select *, row_number() over (partition by slug order by p_partkey) as rn from s) select p_partkey, case when slug = '' or rn = 1 then slug else slug || '-' || p_partkey end as slug from w")
def slug_disambiguation(spark, d):
    """W2 F2."""
    return R.disambiguated(table(spark, d, "part"), S.slug(F.concat_ws(" ", "p_type", "p_brand")), "p_partkey").select("p_partkey", "slug")


@query("with w as (select event_id, user_id, value, row_number() over (partition by user_id, round_even(value / 10, 0) order by ts, event_id) as rn from events) select event_id, user_id, value from w where rn = 1")
def first_seen_dedupe(spark, d):
    """One row per cell of a grid, the first seen; halves go to even."""
    e = table(spark, d, "events").withColumn("g_", F.bround(F.col("value") / 10, 0))
    return R.pick_first(e, ["user_id", "g_"], [F.col("ts"), F.col("event_id")], ["event_id", "user_id", "value"])


@query("with w as (select user_id, year(ts) as y, month(ts) as m, event_id, row_number() over (partition by user_id, event_type order by md5('12345:' || user_id || ':' || event_id), user_id, event_id) as rn from events) select user_id, event_id from w where rn <= 3")
def stratified_sample(spark, d):
    """A seeded sample of each stratum, the same on every run."""
    return R.stratified_sample(table(spark, d, "events"), ["user_id", "event_type"], ["user_id", "event_id"], 3).select("user_id", "event_id")


@query(f"with {RECORDS} select id, kind, cls, day from records order by kind, cls nulls last, day desc, id limit 50 offset 100")
def page_three(spark, d):
    """A page of a total order."""
    return records(spark, d).orderBy("kind", F.col("cls").asc_nulls_last(), F.col("day").desc(), "id").offset(100).limit(50).select("id", "kind", "cls", "day")


@query(f"with {RECORDS}, w as (select owner_id, id, row_number() over (partition by owner_id order by day desc, id desc) as rn, count(*) over (partition by owner_id) as n from records where reviewed_at is null) select owner_id, id as newest, n from w where rn = 1")
def newest_pending(spark, d):
    """O2 O3: the newest of each owner, by max_by, without a sort."""
    return records(spark, d).where("reviewed_at is null").groupBy("owner_id").agg(F.max_by("id", F.struct("day", "id")).alias("newest"), F.count(F.lit(1)).alias("n"))


@query("with w as (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part) select p_brand, p_partkey, p_retailprice from w where rn <= 5")
def top_k_per_group(spark, d):
    """O7 O8 O9."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("p_brand", "p_partkey", "p_retailprice")


@query(f"with {PARTS}, c as (select distinct parent_id, skey from parts where role = 'source'), w as (select distinct parent_id, skey from parts where role = 'deposit') select parent_id, skey, 'add' as action from (select * from w except select * from c) union all select parent_id, skey, 'remove' from (select * from c except select * from w)")
def membership_delta(spark, d):
    """What to add and what to remove."""
    p = parts(spark, d)
    return R.delta(p.where("role = 'source'"), p.where("role = 'deposit'"), ["parent_id", "skey"])


@query("select c_custkey as id from customer where c_custkey not in (select o_custkey from orders) union select s_suppkey from supplier where s_acctbal < 0")
def union_distinct(spark, d):
    """U1 U6."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti")
    return c.union(table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


# aggregates

@query(f"with {PARTS} select parent_id, max(case when role = 'source' then area end) as display_area, count(distinct skey) as n_sources, count(distinct role) as n_roles from parts group by parent_id having max(area) > 40000")
def max_case_having(spark, d):
    """A5 A9 A11."""
    return parts(spark, d).groupBy("parent_id").agg(F.max(F.when(F.col("role") == "source", F.col("area"))).alias("display_area"), F.countDistinct("skey").alias("n_sources"), F.countDistinct("role").alias("n_roles"), F.max("area").alias("m_")).where("m_ > 40000").drop("m_")


@query(f"""with {PARTS} select parent_id, string_agg(role || ':' || line || ':' || cast(cast(area as decimal(18, 2)) as varchar), '|' order by line, pkey, skey) as members from parts group by parent_id""")
def ordered_aggregation(spark, d):
    """An ordered list per group."""
    item = F.concat_ws(":", "role", F.col("line").cast("string"), F.col("area").cast("decimal(18,2)").cast("string"))
    packed = F.sort_array(F.collect_list(F.struct("line", "pkey", "skey", item.alias("item"))))
    return parts(spark, d).groupBy("parent_id").agg(F.array_join(F.transform(packed, lambda s: s["item"]), "|").alias("members"))


@query("select (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select count(*) from lineitem join orders on l_orderkey = o_orderkey where o_custkey = c_custkey) as n_lines, c_custkey from customer")
def delete_impact(spark, d):
    """What goes with each owner."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    n = o.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.coalesce("k", F.lit(0))).alias("n_lines"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("with s as (select p_brand, list_sort(list(p_retailprice)) as v from part group by 1) select p_brand, array_to_string([cast(cast(v[1 + least(len(v) - 1, cast(floor(i / 5.0 * len(v)) as int))] as decimal(18, 2)) as varchar) for i in [0, 1, 2, 3, 4, 5]], ',') as edges from s")
def quantile_binner(spark, d):
    """Edges at exact positions, from counts per value."""
    q = R.quantile_edges(table(spark, d, "part"), "p_retailprice", 5, "p_brand")
    return q.select("p_brand", F.array_join(F.transform("edges", lambda x: x.cast("decimal(18,2)").cast("string")), ",").alias("edges"))


@query("with s as (select user_id, list_sort(list(value)) as v from events group by 1) select user_id, v[1] as v_min, v[1 + cast(floor(0.1 * (len(v) - 1)) as int)] as p10, v[1 + cast(floor(0.5 * (len(v) - 1)) as int)] as p50, v[1 + cast(floor(0.9 * (len(v) - 1)) as int)] as p90, v[len(v)] as v_max from s")
def percentile_summary(spark, d):
    """Values at positions int(p * (n - 1)), not interpolated."""
    s = R.summary(table(spark, d, "events"), "value", (0.0, 0.1, 0.5, 0.9, 1.0), "user_id")
    return s.select("user_id", *[F.get("at", F.lit(i)).alias(n) for i, n in enumerate(("v_min", "p10", "p50", "p90", "v_max"))])


@query("select case when value is null then null when value <= 0 then 0 else greatest(0, least(9, cast(floor((ln(greatest(value, 1e-9)) - ln(1.0)) / (ln(1000.0) - ln(1.0)) * 10) as int))) end as bin, count(*) as n from events group by 1")
def log_binner(spark, d):
    """A21 P12."""
    return table(spark, d, "events").groupBy(R.log_bin("value", 1.0, 1000.0, 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("with g as (select p_size % 10 as n10, cast(floor(p_retailprice / 100) as int) as lw, count(*) as n from part group by 1, 2) select n10, lw, n, round(n * 1000 / 0.0081::double / sum(n) over (partition by n10), 3) as density from g")
def joint_grid(spark, d):
    """Counts over two axes, and their density against all cells of the first."""
    p = table(spark, d, "part").select((F.col("p_size") % 10).alias("n10"), F.floor(F.col("p_retailprice") / 100).cast("int").alias("lw"))
    total = p.groupBy("n10").agg(F.count(F.lit(1)).alias("m"))
    return p.groupBy("n10", "lw").agg(F.count(F.lit(1)).alias("n")).join(total, "n10").select("n10", "lw", "n", F.round(F.col("n") * 1000 / F.lit(0.0081) / F.col("m"), 3).alias("density"))


@query("""with a as (select l_partkey as k, max(cast(l_quantity as int)) as v from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey as k, max(cast(l_quantity as int)) as v from lineitem where l_returnflag = 'R' group by 1)
select a.v as asc_v, b.v as desc_v, count(*) as n, case when a.v is null then 'desc only' when b.v is null then 'asc only' when a.v in (1, 50) or b.v in (1, 50) then 'clipped' else 'both' end as state from a full join b using (k) group by a.v, b.v""")
def joint_raster_histogram(spark, d):
    """Two layers by cell, outer joined, counted by value pair."""
    l = table(spark, d, "lineitem")
    side = lambda f, n: l.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.col("l_quantity").cast("int")).alias(n))
    return R.joint_counts(side("A", "asc_v"), side("R", "desc_v"), ["k"], "asc_v", "desc_v", 1, 50)


# rules

_REC6 = """select id, kind, id % 17 = 0 as permafrost, case when id % 5 = 0 then volume end as volume_site, case when id % 5 = 0 then 'survey' end as volume_method, year_text, seismic_at, date_min,
  case when id % 3 = 0 then true when id % 3 = 1 then false end as insar_a, case when id % 4 = 0 then false end as insar_b, cast(null as boolean) as insar_c, case when id % 9 = 0 then true end as insar_d,
  case when id % 19 = 0 then true end as patchy, case when id % 23 = 0 then true end as plain, case when id % 6 = 0 then true end as geomorph, case when id % 10 = 0 then ' ' when id % 14 = 0 then 'slow' end as subtle_text, id % 2 = 0 as evaluated from dated"""
_RULES = f"""with {DATED}, rec as ({_REC6}),
pv as (select p.*, cast(round_even(case when permafrost then area * 20 when (kind = 'slow' and role = 'body') or (kind = 'catastrophic' and role = 'source') then 0.1 * pow(area, 1.5) when kind = 'catastrophic' and role = 'deposit' then area * 2 end, 0) as bigint) as pvol from parts p join rec on id = parent_id),
s as (select parent_id, sum(area) filter (where role = 'body') as area_body, sum(area) filter (where role = 'source') as area_source, sum(area) filter (where role = 'deposit') as area_deposit,
  cast(sum(pvol) filter (where role = 'body') as bigint) as volume_body, cast(sum(pvol) filter (where role = 'source') as bigint) as volume_source, cast(sum(pvol) filter (where role = 'deposit') as bigint) as volume_deposit from pv group by 1),
a as (select rec.*, s.*, case kind when 'slow' then coalesce(area_body, 0) >= 50000 when 'catastrophic' then coalesce(area_source, 0) >= 50000 or coalesce(area_deposit, 0) >= 500000 end as size_inclusion,
  case kind when 'slow' then volume_body when 'catastrophic' then nullif(greatest(coalesce(volume_source, 0), coalesce(volume_deposit, 0)), 0) end as volume_estimated,
  case when insar_a or insar_b or insar_c or insar_d then true when not insar_a or not insar_b or not insar_c or not insar_d then false end as insar_creep,
  coalesce(year(seismic_at), case when regexp_full_match(trim(year_text), '[0-9]{{4}}') then cast(trim(year_text) as int) end, case when year_text ilike '%holocene%' then -1 end, case when year_text ilike '%modern%' then 0 end, year(date_min)) as era from rec left join s on id = parent_id),
b as (select *, coalesce(volume_site, volume_estimated) as volume_preferred, case when volume_site is not null then volume_method else 'Automated estimate' end as method,
  case when patchy then 'Patchy obvious creep' when plain then 'Obvious creep' when insar_creep or length(trim(subtle_text)) > 0 then 'Subtle creep' when geomorph then 'Geomorph creep' when evaluated then 'Cryptic' end as creep_behavior from a)
"""


def rule_records(spark, d):
    return dated(spark, d).selectExpr(
        "id", "kind", "id % 17 = 0 as permafrost", "case when id % 5 = 0 then volume end as volume_site", "case when id % 5 = 0 then 'survey' end as volume_method", "year_text", "seismic_at", "date_min",
        "case when id % 3 = 0 then true when id % 3 = 1 then false end as insar_a", "case when id % 4 = 0 then false end as insar_b", "cast(null as boolean) as insar_c", "case when id % 9 = 0 then true end as insar_d",
        "case when id % 19 = 0 then true end as patchy", "case when id % 23 = 0 then true end as plain", "case when id % 6 = 0 then true end as geomorph", "case when id % 10 = 0 then ' ' when id % 14 = 0 then 'slow' end as subtle_text", "id % 2 = 0 as evaluated",
    )


@query(_RULES + """select id, size_inclusion, volume_body, volume_source, volume_deposit, volume_estimated, volume_preferred, method as volume_method, insar_creep, creep_behavior,
  case kind when 'slow' then case when not coalesce(size_inclusion, false) then 'Small slow landslide' else 'Slow ' || creep_behavior end
  when 'catastrophic' then case when not coalesce(size_inclusion, false) then 'Small catastrophic landslide' when era >= 2012 then coalesce('Catastrophic ' || creep_behavior, 'Catastrophic') when era = 0 or era >= 1850 then 'Catastrophic Modern' when era is not null then 'Catastrophic Holocene' end end as record_class from b""")
def rule_cascade(spark, d):
    """All rules in order as one plan."""
    out = U.cascade(rule_records(spark, d), parts(spark, d))
    return out.select("id", "size_inclusion", "volume_body", "volume_source", "volume_deposit", "volume_estimated", "volume_preferred", "volume_method", "insar_creep", "creep_behavior", "record_class")


_STORED = "select id, volume + (id % 3) as volume, case when id % 4 = 0 then '' else cls end as cls, price + (id % 5) * 0.4 as price from records"


def stored(spark, d):
    return records(spark, d).selectExpr("id", "volume + (id % 3) as volume", "case when id % 4 = 0 then '' else cls end as cls", "price + (id % 5) * 0.4 as price")


_COLS = {"volume": "exact", "cls": "string", "price": "double"}
_DIFF = f"""with {RECORDS}, st as ({_STORED}), j as (select r.id, not (s.volume is not distinct from r.volume) as dv, not (nullif(s.cls, '') is not distinct from nullif(r.cls, '')) as dc, not (abs(s.price - r.price) <= 1.0) as dp, s.volume as sv, r.volume as rv, s.cls as sc, r.cls as rc from st s join records r using (id))"""


@query(_DIFF + " select id, 'volume' as column_name, cast(sv as varchar) as old_value, cast(rv as varchar) as new_value from j where dv union all select id, 'cls', sc, rc from j where dc")
def stored_differences(spark, d):
    """Values on which stored and computed don't agree; text and exact columns."""
    return U.differences(stored(spark, d), records(spark, d), "id", {k: v for k, v in _COLS.items() if k != "price"})


@query(_DIFF + " select 'volume' as rule, count(*) filter (where not dv) as agreements, count(*) filter (where dv) as changes from j union all select 'cls', count(*) filter (where not dc), count(*) filter (where dc) from j union all select 'price', count(*) filter (where not dp), count(*) filter (where dp) from j")
def rule_agreement(spark, d):
    """A15 E1 E7."""
    return U.agreement(stored(spark, d), records(spark, d), "id", _COLS)


@query(f"with {RECORDS}, st as ({_STORED}) select id, r.volume as volume, case when nullif(s.cls, '') is not distinct from nullif(r.cls, '') then s.cls else r.cls end as cls, case when abs(s.price - r.price) <= 1.0 then s.price else r.price end as price from st s join records r using (id)")
def batch_apply(spark, d):
    """E5: only what doesn't agree is written."""
    return U.applied(stored(spark, d), records(spark, d), "id", _COLS)


# merge

_UP = "select case when id % 10 = 0 then -id else id end as id, case when id % 4 = 0 then '' else cls end as cls, volume + case when id % 6 = 0 then 1 else 0 end as volume from records where id % 3 <> 0"


def upload(spark, d):
    return records(spark, d).where("id % 3 <> 0").selectExpr("case when id % 10 = 0 then -id else id end as id", "case when id % 4 = 0 then '' else cls end as cls", "volume + case when id % 6 = 0 then 1 else 0 end as volume")


@query(f"""with {RECORDS}, up as ({_UP}) select coalesce(r.id, u.id) as id, case when r.id is null then 'insert' when u.id is null then 'missing' when nullif(r.cls, '') is distinct from nullif(u.cls, '') or r.volume is distinct from u.volume then 'update' else 'unchanged' end as status,
  case when r.id is not null and u.id is not null then (case when nullif(r.cls, '') is distinct from nullif(u.cls, '') then 1 else 0 end) + (case when r.volume is distinct from u.volume then 1 else 0 end) else 0 end as n_changes from records r full join up u on r.id = u.id""")
def upload_diff(spark, d):
    """What an upload would change."""
    return M.diff(records(spark, d), upload(spark, d), "id").select("id", "status", F.greatest(F.lit(0), F.coalesce(F.size("changes"), F.lit(0))).alias("n_changes"))


@query(f"with {RECORDS}, up as ({_UP}) select coalesce(r.id, u.id) as id, coalesce(u.cls, r.cls) as cls, coalesce(u.volume, r.volume) as volume, r.kind from records r full join up u on r.id = u.id")
def upload_merge(spark, d):
    """Update, insert, keep."""
    return M.upsert(records(spark, d).select("id", "cls", "volume", "kind"), upload(spark, d), "id")


@query(f"with {RECORDS} select id, kind, 'delete' as action from records where id % 7 = 0 union all select id, kind, 'keep' from records where id % 7 <> 0 and kind = 'other'")
def history_and_delete(spark, d):
    """Rows that go are copied first."""
    r = records(spark, d).select("id", "kind")
    hist = M.with_history(r.where("kind = 'other' and id % 7 <> 0").withColumns({"action": F.lit("keep"), "changed_at": F.lit(None).cast("date")}), r, r.where("id % 7 = 0"), "id", "delete", F.lit(None).cast("date"))
    return hist.select("id", "kind", "action")


@query(f"""with {PARTS} select pkey, min(line) as line, case when bool_or(role in ('source', 'deposit')) then 'catastrophic' else 'slow' end as kind, count(*) as n_parts, count(distinct role) > 1 as conflict from parts group by pkey""")
def parent_synthesis(spark, d):
    """A parent for each name among the parts, with what they disagree on."""
    p = parts(spark, d)
    got = M.parents_of(p, "pkey", "role", ("line", "parent_id", "skey"), ("line", "role"))
    return got.select("pkey", "line", "kind", "n_parts", F.array_contains("conflicts", "role").alias("conflict"))


@query("""with b as (select s_suppkey as id, s_nationkey as g, s_suppkey % 40 / 10.0 as x0, s_suppkey % 40 / 10.0 + 1 + s_suppkey % 3 as x1, s_suppkey % 7 / 10.0 as y0, s_suppkey % 7 / 10.0 + 2 as y1 from supplier),
j as (select a.id as a_id, b.id as b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as s from b a join b on a.g = b.g and a.id < b.id)
select a_id, max(round(i / (s - i), 6)) as iou from j group by a_id having max(i / (s - i)) > 0.8""")
def iou_pairing(spark, d):
    """Best overlap above 0.8 among candidates of a group."""
    b = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_nationkey as g", "cast(s_suppkey % 40 / 10.0 as double) as x0", "cast(s_suppkey % 40 / 10.0 + 1 + s_suppkey % 3 as double) as x1", "cast(s_suppkey % 7 / 10.0 as double) as y0", "cast(s_suppkey % 7 / 10.0 + 2 as double) as y1")
    pairs = R.meeting_boxes(b, b, 2.0, ["g"]).where("a_id < b_id")
    at = lambda s: {k: F.col(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1")}
    return pairs.select("a_id", geo.box_iou(at("a"), at("b")).alias("iou")).groupBy("a_id").agg(F.max("iou").alias("m")).where(F.col("m") > M.MAYBE_SHAPE).select("a_id", F.round("m", 6).alias("iou"))


@query("""with b as (select s_suppkey as id, s_nationkey as g, s_suppkey % 5 as k, s_suppkey % 40 / 10.0 as x0, s_suppkey % 40 / 10.0 + 1 + s_suppkey % 3 as x1, s_suppkey % 7 / 10.0 as y0, s_suppkey % 7 / 10.0 + 2 as y1 from supplier),
u as (select id, g, k, case when id % 3 = 0 then x0 else x0 + 0.2 end as x0, case when id % 3 = 0 then x1 else x1 + 0.2 end as x1, y0, y1 from b),
j as (select u.id as u_id, b.id as b_id, greatest(0, least(u.x1, b.x1) - greatest(u.x0, b.x0)) * greatest(0, least(u.y1, b.y1) - greatest(u.y0, b.y0)) as i, (u.x1 - u.x0) * (u.y1 - u.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as s, u.k = b.k as same_name, u.k % 3 = b.k % 3 as same_key from u join b on u.g = b.g and u.x0 <= b.x1 and b.x0 <= u.x1 and u.y0 <= b.y1 and b.y0 <= u.y1)
select u_id, b_id, case when round(i / (s - i), 9) >= 0.999 then 'update' when same_name then 'block' when same_key or round(i / (s - i), 9) > 0.8 then 'review' end as class from j""")
def collision_classes(spark, d):
    """What to do with an upload whose box meets a stored one: same shape, same name, or to be looked at. Records of equal boxes and names are compared as one."""
    b = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_nationkey as g", "s_suppkey % 5 as k", "cast(s_suppkey % 40 / 10.0 as double) as x0", "cast(s_suppkey % 40 / 10.0 + 1 + s_suppkey % 3 as double) as x1", "cast(s_suppkey % 7 / 10.0 as double) as y0", "cast(s_suppkey % 7 / 10.0 + 2 as double) as y1")
    moved = lambda c: F.when(F.col("id") % 3 == 0, F.col(c)).otherwise(F.col(c) + 0.2).alias(c)
    u = b.select("id", "g", "k", moved("x0"), moved("x1"), "y0", "y1")
    at = lambda s: {k: F.col(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1")}
    pairs = R.meeting_boxes(R.alike(u, "id"), R.alike(b, "id"), 2.0, ["g"], spread=8).withColumn("iou", F.round(geo.box_iou(at("a"), at("b")), 9))
    each = pairs.select("a_ids", "b_ids", M.collision(F.col("iou"), F.col("a_k") % 3, F.col("b_k") % 3, F.col("a_k"), F.col("b_k")).alias("class"))
    return each.select("b_ids", "class", F.explode("a_ids").alias("u")).select("u", "class", F.explode("b_ids").alias("b")).select(F.col("u.id").alias("u_id"), F.col("b.id").alias("b_id"), "class")


@query(f"with {RECORDS} select id, row_number() over (partition by owner_id order by coalesce(flagged, false) desc, day, id) - 1 as position from records")
def photo_order(spark, d):
    """An owner's pictures: featured first, then by day, then by id."""
    w = Window.partitionBy("owner_id").orderBy(F.coalesce("flagged", F.lit(False)).desc(), "day", "id")
    return records(spark, d).select("id", (F.row_number().over(w) - 1).alias("position"))


@query(f"with {RECORDS}, {PARTS}, g as (select id from records where kind = 'other') select 'parents' as name, count(*) as n, count(*) filter (where id > 0 and (id // 2 * 2) not in (select id from g)) as n_pointers from records where id not in (select id from g) union all select 'parts', count(*), null from parts where parent_id not in (select id from g)")
def cascade_delete(spark, d):
    """Records that go take their parts along, and what points at them points nowhere."""
    r = records(spark, d).select("id", "kind", F.when(F.col("id") > 0, F.floor(F.col("id") / 2) * 2).alias("twin"))
    left = M.without(r, r.where("kind = 'other'"), "id", {"parts": (parts(spark, d).select("parent_id", "line"), "parent_id")}, "twin")
    return left["parents"].agg(F.lit("parents").alias("name"), F.count(F.lit(1)).alias("n"), F.count("twin").alias("n_pointers")).unionByName(left["parts"].agg(F.lit("parts").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("n_pointers")))


@query(f"with {RECORDS}, {PARTS} select parent_id, line, pkey, skey, coalesce(cls, 'record ' || parent_id) || ' (' || role || ')' as label from parts join records on id = parent_id")
def part_labels(spark, d):
    """What a part is called where it is listed: its record's name, and its role."""
    r = records(spark, d).select("id", F.coalesce("cls", F.concat(F.lit("record "), F.col("id").cast("string"))).alias("name"))
    p = parts(spark, d)
    return p.join(r, p["parent_id"] == r["id"]).select("parent_id", "line", "pkey", "skey", U.label("name", "role").alias("label"))


@query(f"""with {RECORDS} select id, kind = 'slow' as chosen, lon + 3 >= -150 and lon <= -100 and lat + 3 >= 40 and lat <= 70 as met, coalesce(starts_with(cls, '2-'), false) as own, lon >= -170 and lon < -120 and lat >= -40 and lat < 33 as tiled, kind = 'slow' and day < date '1996-01-01' - interval 30 minute as stuck from records""")
def scan_predicates(spark, d):
    """One of some kinds, boxes that meet, flags by a scan itself, half-open tiles, stalled jobs."""
    r = records(spark, d)
    status = F.when(F.col("kind") == "slow", "processing").otherwise("done")
    return r.select(
        "id", P.among("kind", ("slow", "other"), "slow").alias("chosen"), P.boxes_meet("lon", "lat", F.col("lon") + 3, F.col("lat") + 3, (-150, 40, -100, 70)).alias("met"), P.own_flag("cls", "2-").alias("own"), P.in_tile("lon", "lat", *map(F.lit, (-170, -40, -120, 33))).alias("tiled"), P.stalled(status, F.col("day").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")).alias("stuck")
    )


@query("""with c as (select c_custkey as id, c_custkey % 100 as deg, c_custkey % 61 as mi, c_custkey % 7 * 8 as sec, c_custkey * 7 % 200 as lodeg, case when c_custkey % 2 = 0 then 'N' else 'S' end as ns, case when c_custkey % 3 = 0 then 'W' else 'e' end as ew, cast(c_custkey * 13 % 500 - 50 as double) as az from customer),
p as (select id, az, (deg + mi / 60.0::double + sec / 3600.0::double) * case when ns = 'S' then -1 else 1 end as lat, (lodeg + mi / 60.0::double + sec / 3600.0::double) * case when ew = 'W' then -1 else 1 end as lon from c),
q as (select *, lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) as ok from p) select id, case when ok then round(lat, 8) end as lat, case when ok then round(lon, 8) end as lon, case when az >= 0 and az < 360 then az end as azimuth from q""")
def camera_places(spark, d):
    """degrees from parts, no place where a camera writes none, and a direction in range."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), S.dms(k % 100, k % 61, k % 7 * 8, F.when(k % 2 == 0, "N").otherwise("S")).alias("y"), S.dms(k * 7 % 200, k % 61, k % 7 * 8, F.when(k % 3 == 0, "W").otherwise("e")).alias("x"), (k * 13 % 500 - 50).cast("double").alias("az"))
    at = S.place("y", "x")
    return c.select("id", F.round(at["lat"], 8).alias("lat"), F.round(at["lon"], 8).alias("lon"), S.azimuth("az").alias("azimuth"))


@query("""with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(case l_linenumber when 1 then ' Source ' when 2 then 'bodies' when 3 then 'DEPOSITS' when 4 then 'head' when 5 then 'de-posit' when 6 then 'sourcess' else '' end) as v, case l_linenumber when 1 then 'source' when 2 then 'body' when 3 then 'deposit' when 4 then 'source' when 5 then 'deposit' end as word from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, word from w""")
def role_words(spark, d):
    """F3, the exact part: words as people write them, to a list; aliases and plurals count."""
    n = F.col("l_linenumber")
    said = F.when(n == 1, " Source ").when(n == 2, "bodies").when(n == 3, "DEPOSITS").when(n == 4, "head").when(n == 5, "de-posit").when(n == 6, "sourcess").otherwise("")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.vocabulary(said, {"bodies": "body", "head": "source"}, ("source", "body", "deposit")).alias("word"))


@query(f"with {RECORDS}, k as (select lower(trim(coalesce(cls, '') || ' ' || owner_id)) as name_key, id from records where deprecated_at is null) select name_key, array_to_string(list_sort(list(id)), ',') as ids from k group by 1 having count(*) > 1")
def unique_name_guard(spark, d):
    """Live records that share a normalised name."""
    got = M.duplicate_names(records(spark, d), "id", S.name_key(F.concat_ws(" ", F.coalesce("cls", F.lit("")), F.col("owner_id").cast("string"))), F.col("deprecated_at").isNull())
    return got.select("name_key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("select p_partkey, coalesce(case when regexp_matches(p_name, '[0-9]{4}') then 'year in name' end, case when regexp_matches(p_name, '1$') then 'ends in one' end) as flag_reason, regexp_matches(p_name, '[0-9]{4}') or regexp_matches(p_name, '1$') as flagged from part")
def flag_scans(spark, d):
    """The first scan that gives a reason wins."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.lit(None).cast("boolean").alias("flagged"), F.lit(None).cast("string").alias("flag_reason"))
    scans = [F.when(F.col("p_name").rlike("[0-9]{4}"), "year in name"), F.when(F.col("p_name").rlike(r"1\z"), "ends in one")]
    return M.flag_updates(p, scans).select("p_partkey", "flagged", "flag_reason")


# scalars

@query("""select doc_id, lower(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')) as name_key, lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '-')) as slug, n_chars % 2 = 0 as even from documents""")
def text_keys(spark, d):
    """F1 F2."""
    return table(spark, d, "documents").select("doc_id", S.name_key("text").alias("name_key"), S.slug("text").alias("slug"), (F.col("n_chars") % 2 == 0).alias("even"))


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then true when o_orderkey % 5 = 1 then false end as b, try_cast(case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then cast(o_orderkey as varchar) || '.5' else 'x' end as double) as x, cast(o_orderdate as date) as day from orders""")
def coercion(spark, d):
    """Words to three-valued booleans, '' and rubbish to null, dates in several formats."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    word = F.when(k % 5 == 0, " Yes").when(k % 5 == 1, "FALSE").when(k % 5 == 2, "maybe").when(k % 5 == 3, "")
    num = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise("x")
    day = F.col("o_orderdate").cast("timestamp")
    text = F.when(k % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    return o.select("o_orderkey", S.to_bool(word).alias("b"), S.number(num).alias("x"), S.to_date(text).alias("day"))


@query("select o_orderkey, year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25::double as dy, year(o_orderdate) + (quarter(o_orderdate) - 1) * 3 / 12.0::double + 0.125::double as q, dayofyear(make_date(year(o_orderdate), 12, 31)) as days, last_day(o_orderdate) as month_end from orders")
def calendar(spark, d):
    """F13 F14 F15."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.decimal_year("o_orderdate").alias("dy"), S.quarter_label("o_orderdate").alias("q"), S.days_in_year(F.year("o_orderdate")).alias("days"), F.last_day(F.col("o_orderdate").cast("date")).alias("month_end"))


_TILE = "cast(greatest(0, least(pow(2, 8) - 1, floor((lon + 180) / 360 * pow(2, 8)))) as int)"
_TILEY = "cast(greatest(0, least(pow(2, 8) - 1, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, 8)))) as int)"


@query(f"with {RECORDS}, t as (select id, {_TILE} as x, {_TILEY} as y from records) select id, x, y, (" + " || ".join(f"cast(((x >> {i}) & 1) + 2 * ((y >> {i}) & 1) as varchar)" for i in range(7, -1, -1)) + ") as quadkey, ['a', 'b', 'c'][(x + y) % 3 + 1] as sub from t")
def tile_math(spark, d):
    """Tile, quadkey and subdomain of a point."""
    t = records(spark, d).select("id", S.tile_x("lon", F.lit(8)).alias("x"), S.tile_y("lat", F.lit(8)).alias("y"))
    return t.select("id", "x", "y", S.quadkey("x", "y", 8).alias("quadkey"), S.subdomain("x", "y", ("a", "b", "c")).alias("sub"))


@query("select event_id, case when value <= 10 then 0.0 when value <= 100 then (value - 10) / 90 * 128 when value <= 400 then 128 + (value - 100) / 300 * 127 else 255.0 end as level, floor(value * 10 + 0.5) / 10 as rounded, round((value * 2) * pow(cast(event_id % 256 as double) / 255.0, 0.7)) as shade from events")
def ramps(spark, d):
    """Linear ramp, rounding as in browsers, colour by shade."""
    e = table(spark, d, "events")
    return e.select("event_id", S.ramp("value", [(10, 0), (100, 128), (400, 255)]).alias("level"), S.half_up("value", 1).alias("rounded"), S.shaded(F.col("value") * 2, (F.col("event_id") % 256).cast("double")).alias("shade"))


@query("select event_id, value + 10 * cos(2 * pi() * (dayofyear(ts) - 200) / 365.25) as seasonal, case when value = 0 then '' else case when abs((50.03719 - value) / abs(value) * 100) < 0.01 then '≈0%' when abs((50.03719 - value) / abs(value) * 100) < 1 then printf('%+.3f%%', (50.03719 - value) / abs(value) * 100) when abs((50.03719 - value) / abs(value) * 100) < 100 then printf('%+.2f%%', (50.03719 - value) / abs(value) * 100) else printf('%+.1f%%', (50.03719 - value) / abs(value) * 100) end end as change from events")
def seasonal_and_change(spark, d):
    """F29 F32."""
    e = table(spark, d, "events")
    return e.select("event_id", S.seasonal("value", F.lit(10.0), F.lit(200), F.dayofyear("ts")).alias("seasonal"), S.percent_change("value", F.lit(50.03719)).alias("change"))


@query("select doc_id, case when regexp_matches(text, '\u221a.') then 1 when regexp_matches(text, '\u201a\u00c4.') then 2 when regexp_matches(text, '\u00c3[\u0080-\u00ff]') then 3 when regexp_matches(text, '\u00e2\u20ac.') then 4 end as sign from documents")
def mojibake_scan(spark, d):
    """signs of wrongly decoded text, in whole texts."""
    return table(spark, d, "documents").select("doc_id", S.mojibake("text").alias("sign"))


@query("""with r as (select l_orderkey as id, sum(l_quantity * (1 + l_linenumber)) as w, min(l_linenumber) as h from lineitem group by 1) select id, round(w * 10 - 2 * 1 * h, 4) as area from r where w * 10 > 40""")
def shoelace_area(spark, d):
    """Area of a rectangle with a rectangular hole, by the shoelace formula."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_quantity") * (1 + F.col("l_linenumber"))).alias("w"), F.min("l_linenumber").cast("double").alias("h"))
    pt = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    outer = F.array(pt(0, 0), pt(F.col("w"), 0), pt(F.col("w"), 10), pt(0, 10))
    hole = F.array(pt(1, 1), pt(1, F.col("h") + 1), pt(3, F.col("h") + 1), pt(3, 1))
    return r.where("w * 10 > 40").select("id", F.round(geo.area(F.array(F.array(outer, hole))), 4).alias("area"))
