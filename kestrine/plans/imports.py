"""Queries on whole imports: documents as records and as their parts, with an upload that changes, adds and leaves orphans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports as I
from ..session import shared_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NEW, LOOSE = 10**9, 3 * 10**9


def now(spark, d) -> I.Tables:
    t = table(spark, d, "documents").selectExpr("doc_id as id", "cast(n_chars as bigint) as n")
    records = t.selectExpr("id", "concat('r', id) as name", "'slow' as kind", "n as size")
    return I.Tables(records, t.selectExpr("id", "floor(id / 3) as record_id", "concat('p', id) as name", "case pmod(n, 3) when 0 then 'source' when 1 then 'body' else 'deposit' end as role", "n as size"))


def upload(spark, d) -> I.Tables:
    t = table(spark, d, "documents").selectExpr("doc_id as id", "cast(n_chars as bigint) as n")
    old = t.where("id % 5 = 0").selectExpr("id", "concat('r', id) as name", "'slow' as kind", "n + case when id % 10 = 0 then 1 else 0 end as size")
    records = old.unionByName(t.where("id % 7 = 0").selectExpr(f"id + {NEW} as id", "concat('new', id) as name", "'fast' as kind", "n as size"))
    kept = t.where("id % 4 = 0").selectExpr("id", "floor(id / 3) as record_id", "concat('p', id) as name", "'body' as role", "n as size")
    parts = kept.unionByName(t.where("id % 7 = 0").selectExpr(f"id + {NEW} as id", f"id + {NEW} as record_id", "concat('q', id) as name", "'source' as role", "n as size"))
    loose = t.where("id % 11 = 0").selectExpr(f"id + {LOOSE} as id", "cast(null as bigint) as record_id", "concat(case when id % 2 = 0 then 'Orphan ' else ' ORPHAN  ' end, floor(id / 50)) as name", "case when n % 4 = 0 then 'source' else 'body' end as role", "case when n % 5 <> 0 then n end as size")
    return I.Tables(records, parts.unionByName(loose))


def checks() -> dict:
    """Refusals, none of which the upload meets."""
    return {"unknown role": ("part", F.col("role").isin("source", "body", "deposit")), "size below zero": ("record", F.col("size") >= 0)}


_UPLOAD = f"""t as (select doc_id as id, n_chars as n from documents), r as (select id, 'r' || id as name, 'slow' as kind, n as size from t),
p as (select id, id // 3 as record_id, 'p' || id as name, case n % 3 when 0 then 'source' when 1 then 'body' else 'deposit' end as role, n as size from t),
lo as (select id + {LOOSE} as id, 'orphan ' || (id // 50) as key, case when id % 2 = 0 then 'Orphan ' else ' ORPHAN  ' end || (id // 50) as name, case when n % 4 = 0 then 'source' else 'body' end as role, case when n % 5 <> 0 then n end as size from t where id % 11 = 0),
ma as (select key, -row_number() over (order by key) as id, case when bool_or(role = 'source') then 'catastrophic' else 'slow' end as kind, arg_min(name, id) as name, arg_min(size, id) filter (where size is not null) as size from lo group by key),
ur as (select id, 'r' || id as name, 'slow' as kind, n + case when id % 10 = 0 then 1 else 0 end as size from t where id % 5 = 0 union all select id + {NEW}, 'new' || id, 'fast', n from t where id % 7 = 0 union all select id, name, kind, size from ma),
up as (select id, id // 3 as record_id, 'p' || id as name, 'body' as role, n as size from t where id % 4 = 0 union all select id + {NEW}, id + {NEW}, 'q' || id, 'source', n from t where id % 7 = 0 union all select lo.id, ma.id, lo.name, lo.role, lo.size from lo join ma using (key))"""


@query(f"""with {_UPLOAD}, c as (select 'record' as kind, case when r.id is null then 'insert' when u.id is null then 'missing' when r.size is distinct from u.size then 'update' else 'unchanged' end as status, case when r.id is not null and u.id is not null and r.size is distinct from u.size then 1 else 0 end as n from r full join ur u on r.id = u.id
  union all select 'part', case when p.id is null then 'insert' when u.id is null then 'missing' when p.role <> u.role then 'update' else 'unchanged' end, case when p.role <> u.role then 1 else 0 end from p full join up u on p.id = u.id)
select kind, status, count(*) as n, cast(sum(n) as bigint) as n_changes, cast(0 as bigint) as n_problems from c group by 1, 2""")
def import_comparison(spark, d):
    """Vocabulary checks, records for orphans, records and parts compared, in one table."""
    c = I.compared(now(spark, d), I.synthesised(upload(spark, d), ["size"]), checks())
    return c.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("changes"), F.lit(0)))).alias("n_changes"), F.sum(F.size("problems")).cast("long").alias("n_problems"))


@query(f"""with {_UPLOAD}, nr as (select id, (select max(id) from r) + row_number() over (order by id) as to_id from ur where id not in (select id from r)),
np as (select id, (select max(id) from p) + row_number() over (order by id) as to_id from up where id not in (select id from p)),
fr as (select r.id, r.name, r.kind, coalesce(u.size, r.size) as size from r left join ur u on u.id = r.id union all select nr.to_id, u.name, u.kind, u.size from ur u join nr using (id)),
fp as (select p.id, p.record_id, coalesce(u.role, p.role) as role, p.name from p left join up u on u.id = p.id union all select np.to_id, coalesce(nr.to_id, u.record_id), u.role, u.name from up u join np using (id) left join nr on nr.id = u.record_id)
select fr.id as record_id, fr.name as record_name, fr.kind, fr.size, fp.id as part_id, fp.name as part_name, fp.role from fr full join fp on fp.record_id = fr.id""")
def whole_import(spark, d):
    """All checks, then both tables as a new version under one pointer, with new ids dense and children pointed at them."""
    root = shared_path(spark, "import")
    I.written(spark, now(spark, d), root)
    I.imported(spark, root, upload(spark, d), checks(), ["size"])
    got = I.stored(spark, root)
    r = got.records.select(F.col("id").alias("record_id"), F.col("name").alias("record_name"), "kind", "size")
    return r.join(got.parts.select("record_id", F.col("id").alias("part_id"), F.col("name").alias("part_name"), "role"), "record_id", "full")
