"""Driver tables in the roles of the inventory: orders are records, line items their parts, customers owners.

The same roles are given as SQL common table expressions. Where a role needs
nulls that the tables don't have, both forms make them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey as parent_id", "l_linenumber as line", "l_partkey as pkey", "l_suppkey as skey",
        "case l_returnflag when 'A' then 'source' when 'N' then 'body' else 'deposit' end as role",
        "case when l_linestatus = 'O' then true when l_linenumber % 3 = 0 then null else false end as is_primary",
        "l_extendedprice as area", "cast(l_shipdate as date) as day", "l_quantity as quantity",
    )


PARTS = """parts as (select l_orderkey as parent_id, l_linenumber as line, l_partkey as pkey, l_suppkey as skey,
  case l_returnflag when 'A' then 'source' when 'N' then 'body' else 'deposit' end as role,
  case when l_linestatus = 'O' then true when l_linenumber % 3 = 0 then null else false end as is_primary,
  l_extendedprice as area, cast(l_shipdate as date) as day, l_quantity as quantity from lineitem)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Without date brackets; see dated()."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "case o_orderstatus when 'F' then 'slow' when 'O' then 'catastrophic' else 'other' end as kind",
        "case when o_orderdate < timestamp'1999-01-01' then cast(o_orderdate as date) end as reviewed_at", "case when o_orderpriority = '5-LOW' then cast(o_orderdate as date) end as deprecated_at",
        "nullif(o_orderpriority, '3-MEDIUM') as cls", "cast(o_totalprice as bigint) as volume", "o_totalprice as price", "o_custkey as owner_id",
        "cast(o_orderkey * 37 % 360 - 180 as double) as lon", "cast(o_orderkey * 53 % 160 - 80 as double) as lat",
        "case when o_orderkey % 11 = 0 then true when o_orderkey % 7 = 0 then null else false end as flagged",
        "case cast(o_orderkey % 8 as int) when 0 then '2014' when 1 then ' 2014 ' when 2 then 'early Holocene' when 3 then 'Modern' when 5 then '1849' when 6 then '2011' when 7 then '' end as year_text",
        "case when o_orderkey % 13 = 0 then cast(o_orderdate as date) end as seismic_at", "cast(o_orderdate as date) as day",
    )


RECORDS = """records as (select o_orderkey as id, case o_orderstatus when 'F' then 'slow' when 'O' then 'catastrophic' else 'other' end as kind,
  case when o_orderdate < timestamp '1999-01-01' then cast(o_orderdate as date) end as reviewed_at, case when o_orderpriority = '5-LOW' then cast(o_orderdate as date) end as deprecated_at,
  nullif(o_orderpriority, '3-MEDIUM') as cls, cast(trunc(o_totalprice) as bigint) as volume, o_totalprice as price, o_custkey as owner_id,
  cast(o_orderkey * 37 % 360 - 180 as double) as lon, cast(o_orderkey * 53 % 160 - 80 as double) as lat,
  case when o_orderkey % 11 = 0 then true when o_orderkey % 7 = 0 then null else false end as flagged,
  case o_orderkey % 8 when 0 then '2014' when 1 then ' 2014 ' when 2 then 'early Holocene' when 3 then 'Modern' when 5 then '1849' when 6 then '2011' when 7 then '' end as year_text,
  case when o_orderkey % 13 = 0 then cast(o_orderdate as date) end as seismic_at, cast(o_orderdate as date) as day from orders)"""


def dated(spark: SparkSession, d: str) -> DataFrame:
    """records with the bracket of their parts' days; records without parts have none."""
    days = parts(spark, d).groupBy("parent_id").agg(F.min("day").alias("date_min"), F.max("day").alias("date_max"))
    r = records(spark, d)
    return r.join(days, r["id"] == days["parent_id"], "left").drop("parent_id")


DATED = f"""{PARTS}, {RECORDS}, dated as (select r.*, p.date_min, p.date_max from records r left join (select parent_id, min(day) as date_min, max(day) as date_max from parts group by parent_id) p on r.id = p.parent_id)"""

YEAR_CODE = """case when seismic_at is not null then year(seismic_at) when regexp_full_match(year_text, '[0-9]{4}') then cast(year_text as int) when year_text ilike '%holocene%' then -1
  when year_text ilike '%modern%' then 0 when cls ilike '%holocene%' then -1 when cls ilike '%modern%' then 0 when date_min is not null then year(date_min) end"""


def traces(spark: SparkSession, d: str) -> DataFrame:
    """events as observations: a cell per user, time, value."""
    return table(spark, d, "events").selectExpr("event_id", "user_id as cell", "cast(ts as timestamp) as ts", "cast(ts as date) as day", "event_type as sensor", "value")


TRACES = "traces as (select event_id, user_id as cell, ts, cast(ts as date) as day, event_type as sensor, value from events)"
