"""Queries on histograms, time series, rasters, particles and windows, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import histograms as H, particles as PT, raster as G, timeseries as T
from ..operators.relational import percentiles
from .roles import DATED, RECORDS, TRACES, YEAR_CODE, dated, records, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# histograms

def event_feed(spark, d):
    """Dated public records: a point by instrument, or the bracket of their parts."""
    x = dated(spark, d).where(P.is_dated())
    is_point = F.col("seismic_at").isNotNull()
    return x.select("id", F.when(is_point, "point").otherwise("range").alias("timing"), F.coalesce(F.dayofyear("seismic_at"), F.dayofyear("date_min")).alias("doy"), F.when(~is_point, F.dayofyear("date_max")).alias("doy_end"), F.when(~is_point, F.datediff("date_max", "date_min") + 1).alias("span"), F.year("date_min").alias("year"), F.when(F.col("id") % 5 != 0, F.col("volume").cast("double")).alias("volume"))


_FEED = f"""{DATED}, feed as (select id, case when seismic_at is not null then 'point' else 'range' end as timing, coalesce(dayofyear(seismic_at), dayofyear(date_min)) as doy, case when seismic_at is null then dayofyear(date_max) end as doy_end,
  case when seismic_at is null then date_diff('day', date_min, date_max) + 1 end as span, year(date_min) as yr, case when id % 5 <> 0 then cast(volume as double) end as volume from dated where seismic_at is not null or date_max >= date_min)"""


@query(f"""with {_FEED}, pc as (select id, span, volume, unnest(case when doy_end >= doy then [[doy, doy_end]] else [[doy, dayofyear(make_date(yr, 12, 31))], [1, doy_end]] end) as p from feed where timing = 'range' and span - 1 <= 90),
b as (select unnest(range(0, 37)) as bin),
w as (select least(36, cast(floor((doy - 1) / 10) as int)) as bin, 1.0::double as w, volume from feed where timing = 'point'
  union all select b.bin, (least(p[2], case when b.bin = 36 then 366 else (b.bin + 1) * 10 end) - greatest(p[1], b.bin * 10 + 1) + 1) / cast(span as double), volume from pc join b on b.bin between least(36, cast(floor((p[1] - 1) / 10) as int)) and least(36, cast(floor((p[2] - 1) / 10) as int))),
g as (select bin, sum(w) as n, sum(w * volume) as volume, max(w * volume) as largest from w group by 1)
select b.bin as bin, round(coalesce(n, 0), 6) as n, round(coalesce(volume, 0), 2) as volume, round(coalesce(largest, 0), 2) as largest from b left join g using (bin)""")
def seasonal_histogram(spark, d):
    """Ten-day bins; an interval is spread over its days, and may run over the year's end."""
    h = H.seasonal(event_feed(spark, d), 90)
    return h.select("bin", F.round("n", 6).alias("n"), F.round("volume", 2).alias("volume"), F.round("largest", 2).alias("largest"))


@query(f"with {_FEED} select count(*) as n, count(*) filter (where volume is null or volume <= 0) as n_unknown from feed where timing = 'point' or span - 1 <= 90")
def seasonal_totals(spark, d):
    """Events in the chart, and those of unknown volume."""
    return H.seasonal_totals(event_feed(spark, d), 90)


_TL = f"""{DATED}, e as (select id, case when seismic_at is not null then seismic_at + to_years(16) end as d, case when id % 3 <> 0 then date_min + to_years(16) end as d0, date_max + to_years(16) as d1, case when id % 4 = 1 then 2000 + id % 20 when id % 4 = 2 then {YEAR_CODE} + 16 else {YEAR_CODE} end as year_num, case when id % 5 <> 0 then volume end as volume from dated)"""


@query(f"""with {_TL}, y as (select *, coalesce(year_num, 0) as y from e where coalesce(year_num, 0) <= 2018), w as (select case when y = -1 then 'H' when y < 2000 then 'M' else cast(y as varchar) end as bin, 1.0::double as w, volume as v from y where y < 2012
  union all select strftime(cast(d as date), '%Y-%m'), 1.0, volume from y where y >= 2012 and d is not null
  union all select strftime(t.mo, '%Y-%m'), (date_diff('day', greatest(d0, t.mo), least(d1, last_day(t.mo))) + 1) / cast(date_diff('day', d0, d1) + 1 as double), volume from (select cast(d0 as date) as d0, cast(d1 as date) as d1, volume, cast(unnest(range(date_trunc('month', d0)::timestamp, d1::timestamp + interval 1 second, interval 1 month)) as date) as mo from y where y >= 2012 and d is null and d0 is not null and d1 >= d0) t where year(t.mo) between 2012 and 2018
  union all select cast(y as varchar) || printf('-%02d', m), 1 / 12.0::double, volume from y, (select unnest(range(1, 13)) as m) where y >= 2012 and d is null and (d0 is null or d1 is null)),
b as (select 'H' as bin union all select 'M' union all select cast(unnest(range(2000, 2012)) as varchar) union all select printf('%04d-%02d', 2012 + m // 12, m % 12 + 1) from (select unnest(range(0, 84)) as m)),
g as (select bin, sum(w) as rate, sum(w * v) as volume_rate, max(w * v) as largest from w group by 1), p as (select b.bin, g.rate, g.volume_rate, g.largest, case when b.bin = 'H' then 120000 when b.bin = 'M' then 1800 when length(b.bin) = 4 then 12 else 1 end as per from b left join g using (bin))
select bin, round(coalesce(rate, 0) / per, 8) as rate, round(coalesce(volume_rate, 0) / per, 4) as volume_rate, round(coalesce(largest, 0) / per, 4) as largest from p""")
def timeline_histogram(spark, d):
    """Eras, years and months, with volumes; intervals spread by days. Days are moved on by 16 years, so that months are met."""
    later = lambda c: F.add_months(F.col(c), 16 * 12)
    year = F.when(F.col("id") % 4 == 1, (2000 + F.col("id") % 20).cast("int")).when(F.col("id") % 4 == 2, P.year_code() + 16).otherwise(P.year_code())
    e = dated(spark, d).select(later("seismic_at").alias("day"), F.when(F.col("id") % 3 != 0, later("date_min")).alias("d0"), later("date_max").alias("d1"), year.alias("year_num"), F.when(F.col("id") % 5 != 0, F.col("volume").cast("double")).alias("volume"))
    return H.timeline(e, 2018).select("bin", F.round("rate", 8).alias("rate"), F.round("volume_rate", 4).alias("volume_rate"), F.round("largest", 4).alias("largest"))


# time series

@query(f"with {TRACES}, g as (select cell, day, count(value) as n, median(value) as m from traces group by 1, 2) select cell, day, n, case when n >= 3 then round(m, 6) end as median from g")
def median_composite(spark, d):
    """Median per cell and period, null below three observations."""
    return T.median_composite(traces(spark, d), ["cell", "day"], "value", 3).select("cell", "day", "n", F.round("median", 6).alias("median"))


@query(f"with {TRACES}, m as (select cell, sensor, median(value) as med, count(*) as n from traces group by 1, 2 having count(*) >= 8) select cell, sensor, round(med, 6) as median, round(greatest(1.0, 1.4826 * median(abs(value - med))), 6) as mad from traces join m using (cell, sensor) group by cell, sensor, med")
def median_and_mad(spark, d):
    """A28."""
    return T.median_and_mad(traces(spark, d), ["cell", "sensor"], "value", 8, 1.0).select("cell", "sensor", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query(f"""with {TRACES}, b as (select cell, cast(day - date '2024-01-01' as int) // 5 as bin, value from traces), m as (select cell, bin, median(value) as med, count(*) as n from b group by 1, 2 having count(*) >= 3),
s as (select b.cell, b.bin, m.med, greatest(0.5, 1.4826 * median(abs(value - med))) as mad from b join m using (cell, bin) group by 1, 2, 3), f as (select *, first_value(med - mad) over (partition by cell order by bin) as low from s) select cell, min(case when med < low then bin end) as cap from f group by cell""")
def first_bin_below(spark, d):
    """Where the median first falls under the reference less its spread."""
    b = traces(spark, d).withColumn("bin", F.floor(F.datediff("day", F.lit("2024-01-01").cast("date")) / 5).cast("int"))
    return T.first_bin_below(T.median_and_mad(b, ["cell", "bin"], "value", 3, 0.5), ["cell"], "bin")


@query(f"with {TRACES} select cell, round((atan2(avg(sin(v)), avg(cos(v))) * 365.25 / (2 * pi()) + 365.25) % 365.25, 5) as phase from (select cell, (value % 365.25) * 2 * pi() / 365.25 as v from traces) group by cell")
def circular_mean(spark, d):
    """Mean day on a circle."""
    return traces(spark, d).groupBy("cell").agg(F.round(T.circular_mean(F.col("value") % 365.25), 5).alias("phase"))


@query(f"""with {TRACES}, g as (select sensor, day, sum(value) as v from traces group by 1, 2), n as (select *, row_number() over (partition by sensor order by day) as i, count(*) over (partition by sensor) as n, first_value(v) over (partition by sensor order by day) as v0, last_value(v) over (partition by sensor order by day rows between unbounded preceding and unbounded following) as v1,
  sum(v) over (partition by sensor order by day rows between 6 preceding and 6 following) as s from g) select sensor, day, round((s + greatest(0, 7 - i) * v0 + greatest(0, 6 - (n - i)) * v1) / 13, 5) as smooth from n""")
def moving_average(spark, d):
    """13 steps, the ends repeated beyond."""
    g = traces(spark, d).groupBy("sensor", "day").agg(F.sum("value").alias("v"))
    return T.moving_average(g, ["sensor"], "day", "v", 6).select("sensor", "day", F.round("smooth", 5).alias("smooth"))


@query(f"with {TRACES} select cell, count(*) filter (where value > 100) as n_fast, round(min(value), 4) as low, round(max(value), 4) as high, min(ts) as t_first, max(ts) as t_last, round(corr(value, hour(ts)), 6) as r from traces where day >= date '2024-01-10' group by cell having count(*) >= 5")
def recent_evidence(spark, d):
    """A30 A31 A32 A37."""
    t = traces(spark, d).where("day >= date'2024-01-10'").groupBy("cell").agg(F.count_if(F.col("value") > 100).alias("n_fast"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), F.min("ts").cast("timestamp_ntz").alias("t_first"), F.max("ts").cast("timestamp_ntz").alias("t_last"), F.round(F.corr("value", F.hour("ts")), 6).alias("r"), F.count(F.lit(1)).alias("n"))
    return t.where("n >= 5").drop("n")


@query(f"with {TRACES}, b as (select case when value < 10 then 'slow' when value < 100 then 'middle' else 'fast' end as band, sensor, value from traces) select band, sensor, count(*) as n, round(median(value), 5) as median, round(sqrt(sum(value * value * value) / sum(value)), 4) as wrms from b group by 1, 2 having count(*) >= 30")
def band_table(spark, d):
    """A33 A36."""
    band = F.when(F.col("value") < 10, "slow").when(F.col("value") < 100, "middle").otherwise("fast")
    v = F.col("value")
    b = traces(spark, d).select(band.alias("band"), "sensor", "value")
    median = percentiles(b, ["band", "sensor"], "value", [0.5]).select("band", "sensor", F.round(F.get("at", F.lit(0)), 5).alias("median"))
    return b.groupBy("band", "sensor").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.sum(v * v * v) / F.sum(v)), 4).alias("wrms")).where("n >= 30").join(median, ["band", "sensor"])


@query(f"""with {TRACES}, y as (select cell, cast(day - date '2024-01-01' as int) as yr, avg(value) as v from traces group by 1, 2), n as (select *, lead(v) over (partition by cell order by yr) as nv, lead(yr) over (partition by cell order by yr) as ny from y) select cell, yr, round(case when ny = yr + 1 then v * 0.75 + nv * 0.25 else v end, 6) as blended, ny = yr + 1 as consecutive from n""")
def adjacent_blend(spark, d):
    """Between the middles of adjacent periods."""
    from pyspark.sql import Window

    y = traces(spark, d).groupBy("cell", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("yr")).agg(F.avg("value").alias("v"))
    out = T.blend(y, ["cell"], "yr", "v", F.col("yr") + 0.75)
    nxt = F.lead("yr").over(Window.partitionBy("cell").orderBy("yr"))
    return out.withColumn("consecutive", nxt == F.col("yr") + 1).select("cell", "yr", F.round("blended", 6).alias("blended"), "consecutive")


@query(f"with {TRACES} select event_id, greatest(8.0::double, 25.5 * 365.25 / (1 + event_id % 120)) * case when sensor = 'error' or event_id % 7 = 0 then 3 when sensor like 'p%' then 2 else 1 end as sigma, case when value is null then 0 when abs(value - 50) <= 3 * 20 then 1 else 2 end as verdict from traces where 1 + event_id % 120 <= 100")
def pair_weights(spark, d):
    """Error of a pair by both of its sensors, and whether it agrees with the model."""
    t = traces(spark, d).withColumns({"dt": (1 + F.col("event_id") % 120).cast("double"), "other": F.when(F.col("event_id") % 7 == 0, "error-2").otherwise("none")}).where("dt <= 100")
    return t.select("event_id", T.pair_sigma("dt", ("sensor", "other"), 8.0, {"error": 3.0, "p": 2.0}).alias("sigma"), T.verdict(F.col("value") - 50, F.lit(20.0)).alias("verdict"))


@query(f"with {TRACES}, y as (select cell, year(day) * 12 + month(day) as year, count(*) as n, avg(sqrt(value)) as m from traces where event_id % 30 <= 16 group by 1, 2) select cell, year, n, case when n >= 3 then round(m, 6) end as mean from y")
def yearly_context(spark, d):
    """Mean of the short pairs of each year (here month), where there are three."""
    t = traces(spark, d).select("cell", F.sqrt("value").alias("value"), (F.col("event_id") % 30).cast("double").alias("dt"), (F.year("day") * 12 + F.month("day")).cast("double").alias("at"))
    return T.yearly_context(t, ["cell"], "at", "value", "dt", 16).select("cell", "year", "n", F.round("mean", 6).alias("mean"))


@query(f"with {TRACES}, c as (select cell, day, quantile_cont(value, 0.75) as context, count(*) as n from traces group by 1, 2) select event_id, not (coalesce(case when n > 3 then context end, 0) >= 60 and value < 0.25 * context) as kept from traces join c using (cell, day)")
def context_screen(spark, d):
    """Slow values among fast ones go; the context is the upper quartile of what is around."""
    t = traces(spark, d)
    c = T.interpolated(t, ["cell", "day"], "value", 0.75).select("cell", "day", F.when(F.col("n") > 3, F.col("at")).alias("context"))
    return t.join(c, ["cell", "day"]).select("event_id", T.context_screen("value", "context", 60.0, 0.25).alias("kept"))


@query(f"with {TRACES}, k as (select event_id, floor(epoch_us(ts) / 3600e6) / 24 as t from traces), g as (select t from k where abs(t * 24 - round(t * 24)) < 1e-6 group by 1 order by abs(t - 19740), t limit 20) select event_id, round(t, 6) as t from k where t in (select t from g)")
def keyframes(spark, d):
    """States at whole hours, the twenty times nearest to now."""
    t = traces(spark, d).select("event_id", (F.floor(F.unix_micros("ts") / F.lit(3600e6)) / 24).alias("t"))
    return PT.keyframes(t, "t", 1 / 24, 20, 19740.0).select("event_id", F.round("t", 6).alias("t"))


@query(f"with {TRACES}, m as (select event_id, value, 2000 + event_id % 400 / 100.0::double as t from traces) select event_id, round(case when t between 2000.5 and 2003.5 then 50 + 2 * (greatest(2001.0::double, least(2003.0::double, t)) - 2002) + 3 * cos(2 * pi() * t) + 4 * sin(2 * pi() * t) end, 6) as at_t, round(value * greatest(0.0::double, 1 - greatest(0.0::double, greatest(2001 - t, t - 2003)) / 1.0), 6) as faded from m")
def model_values(spark, d):
    """Level, trend and season at a time; the trend stands still beyond the support, and beyond its slack there is none; values that fade there."""
    t = F.lit(2000) + F.col("event_id") % 400 / F.lit(100.0)
    at = T.model_value(F.array(*map(F.lit, (50.0, 2.0, 3.0, 4.0))), t, F.lit(2001.0), F.lit(2003.0), 2002.0)
    return traces(spark, d).select("event_id", F.round(at, 6).alias("at_t"), F.round(G.fade("value", F.lit(2001.0), F.lit(2003.0), t), 6).alias("faded"))


def _intervals(spark, d):
    t = traces(spark, d)
    at = F.unix_micros("ts") / F.lit(86_400e6 * 365.25)
    return t.select("cell", (at - 19723 / 365.25).alias("t1"), (at - 19723 / 365.25 + (1 + F.col("event_id") % 30) / 365.25).alias("t2"), F.col("value").alias("v"), F.lit(10.0).alias("sigma"))


_X = """x as (select cell, (epoch_us(ts) / (86400e6 * 365.25) - 19723 / 365.25::double) as t1, (epoch_us(ts) / (86400e6 * 365.25) - 19723 / 365.25::double + (1 + event_id % 30) / 365.25::double) as t2, value as v from traces)"""


@query(f"with {TRACES}, {_X} select cell, count(*) as n, round(sum((t1 + t2) / 2), 5) as t, round(sum((sin(2 * pi() * t2) - sin(2 * pi() * t1)) / (2 * pi() * (t2 - t1))), 5) as c, round(sum((cos(2 * pi() * t1) - cos(2 * pi() * t2)) / (2 * pi() * (t2 - t1))), 5) as s from x group by 1")
def interval_columns(spark, d):
    """Means of time, cosine and sine over each interval, here summed by cell."""
    t, c, s = T.interval_design("t1", "t2", 0.0)
    return _intervals(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(t), 5).alias("t"), F.round(F.sum(c), 5).alias("c"), F.round(F.sum(s), 5).alias("s"))


@query(f"""with {TRACES}, {_X}, a as (select cell, (t1 + t2) / 2 as p, (sin(2 * pi() * t2) - sin(2 * pi() * t1)) / (2 * pi() * (t2 - t1)) as q, v, 1.0::double / power(10 + cell % 5, 2) as w from x),
s as (select cell, count(*) as n, sum(w) as a00, sum(w * p) as a01, sum(w * q) as a02, sum(w * p * p) as a11, sum(w * p * q) as a12, sum(w * q * q) as a22, sum(w * v) as b0, sum(w * p * v) as b1, sum(w * q * v) as b2 from a group by 1),
r as (select cell, n, a00 + 1e-4 * (a00 + a11 + a22) / 3 as x00, a01, a02, a11 + 1e-4 * (a00 + a11 + a22) / 3 as x11, a12, a22 + 1e-4 * (a00 + a11 + a22) / 3 + 0.05 as x22, b0, b1, b2 from s),
d as (select *, x00 * (x11 * x22 - a12 * a12) - a01 * (a01 * x22 - a12 * a02) + a02 * (a01 * a12 - x11 * a02) as det from r)
select cell, n, round((b0 * (x11 * x22 - a12 * a12) - a01 * (b1 * x22 - a12 * b2) + a02 * (b1 * a12 - x11 * b2)) / det, 3) as level, round((x00 * (b1 * x22 - a12 * b2) - b0 * (a01 * x22 - a12 * a02) + a02 * (a01 * b2 - b1 * a02)) / det, 3) as slope,
  round((x00 * (x11 * b2 - b1 * a12) - a01 * (a01 * b2 - b1 * a02) + b0 * (a01 * a12 - x11 * a02)) / det, 3) as season from d""")
def weighted_trend(spark, d):
    """Weighted normal equations summed by Spark and solved per cell with a ridge, and damping on the season; level, trend and cosine."""
    x = _intervals(spark, d)
    t, c, _ = T.interval_design("t1", "t2", 0.0)
    eq = T.normal_equations(x, ["cell"], [t, c], "v", 1 / F.pow(10 + F.col("cell") % 5, 2))
    s = T.ridge_solve(eq, (0.0, 0.0, 0.05), 1e-4)
    return s.select("cell", "n", *[F.round(F.get("coef", F.lit(i)), 3).alias(k) for i, k in enumerate(("level", "slope", "season"))])


# rasters: orders in order of their keys fill tiles of 64 by 64 cells, so tiles grow with the table

def cells(spark, d):
    from ..session import table

    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.floor(k / 4096).alias("tile"), (F.floor(k / 64) % 64).cast("int").alias("i"), (k % 64).cast("int").alias("j"), (F.sqrt("o_totalprice") / 10).alias("m"))
    return o.select("tile", "i", "j", F.when((F.col("i") * 7 + F.col("j") * 3) % 5 != 0, F.col("m")).alias("v"), ((F.col("i") + F.col("j")) % 11 == 0).alias("stale"))


_CELLS = "cells as (select tile, i, j, case when (i * 7 + j * 3) % 5 <> 0 then m end as v, (i + j) % 11 = 0 as stale from (select o_orderkey // 4096 as tile, cast(o_orderkey // 64 % 64 as int) as i, cast(o_orderkey % 64 as int) as j, sqrt(o_totalprice) / 10 as m from orders))"


@query(f"with {_CELLS}, r as (select tile, i // 2 as bi, j // 2 as bj, i % 2 as r, avg(v) as m from cells group by 1, 2, 3, 4) select tile, bi, bj, round(avg(m), 6) as mean from r group by 1, 2, 3")
def block_mean(spark, d):
    """Mean of the means of rows, without nulls."""
    return G.block_mean(cells(spark, d), "v").select("tile", "bi", "bj", F.round("mean", 6).alias("mean"))


@query(f"with {_CELLS} select tile, i // 2 as bi, j // 2 as bj, max(v) as most from cells group by 1, 2, 3")
def block_maximum(spark, d):
    """Largest value of a block."""
    return G.block_max(cells(spark, d), "v")


@query(f"with {_CELLS} select tile, i, j, v from cells where i % 4 = 0 and j % 4 = 0")
def strided_cells(spark, d):
    """T22, the stride only: every fourth cell both ways."""
    from ..operators.relational import strided

    return strided(cells(spark, d), 4).select("tile", "i", "j", "v")


@query(f"with {_CELLS} select a.tile, a.i, a.j, round(sum(b.v * exp(-((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) / 8.0 - pow(b.v - a.v, 2) / 2.0)) / sum(exp(-((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) / 8.0 - pow(b.v - a.v, 2) / 2.0)), 6) as filtered from cells a join cells b on a.tile = b.tile and abs(a.i - b.i) <= 4 and abs(a.j - b.j) <= 4 where a.v is not null and b.v is not null group by 1, 2, 3")
def bilateral_filter(spark, d):
    """Edge-keeping mean."""
    return G.bilateral(cells(spark, d)).where("v is not null").select("tile", "i", "j", F.round("filtered", 6).alias("filtered"))


@query(f"with {_CELLS}, f as (select a.tile, a.i, a.j, case when count(*) >= 3 then sum(b.v / power(greatest(0.5, sqrt(power(a.i - b.i, 2) + power(a.j - b.j, 2))), 2)) / sum(1 / power(greatest(0.5, sqrt(power(a.i - b.i, 2) + power(a.j - b.j, 2))), 2)) end as f from cells a join cells b on a.tile = b.tile and a.i between b.i - 6 and b.i + 6 and a.j between b.j - 6 and b.j + 6 and b.v is not null where a.v is null and not a.stale group by 1, 2, 3) select c.tile, c.i, c.j, round(coalesce(c.v, f.f), 6) as filled from cells c left join f on c.tile = f.tile and c.i = f.i and c.j = f.j")
def idw_fill(spark, d):
    """T5: holes filled from the cells of the square around, but for those that are stale."""
    return G.idw_fill(cells(spark, d), 6, stale="stale").select("tile", "i", "j", F.round("filled", 6).alias("filled"))


@query(f"with {_CELLS} select a.tile, a.i, a.j, case when count(b.v) > 0.15 * 25 then round(quantile_cont(b.v, 0.75), 6) end as context from cells a left join cells b on a.tile = b.tile and abs(a.i - b.i) <= 2 and abs(a.j - b.j) <= 2 and b.v is not null group by 1, 2, 3")
def context_percentile(spark, d):
    """75th percentile of the window."""
    return G.window_percentile(cells(spark, d), 2, 0.75).select("tile", "i", "j", F.round("context", 6).alias("context"))


@query(f"with {_CELLS}, c as (select a.tile, a.i, a.j, a.v, case when count(b.v) > 0.15 * 81 then quantile_cont(b.v, 0.75) end as context from cells a left join cells b on a.tile = b.tile and abs(a.i - b.i) <= 4 and abs(a.j - b.j) <= 4 and b.v is not null group by 1, 2, 3, 4) select tile, i, j, not coalesce(context >= 50 and v < 0.4 * context, false) as kept from c where v is not null")
def windowed_context_screen(spark, d):
    """Slow cells among fast ones go; the context is the upper quartile of the square of four cells around."""
    c = G.window_percentile(cells(spark, d), 4, 0.75).where("v is not null")
    return c.select("tile", "i", "j", T.context_screen("v", "context", 50.0, 0.4).alias("kept"))


@query(f"""with {_CELLS}, p as (select c_custkey as id, c_custkey * 10 // 4096 as tile, c_custkey * 37 % 640 / 10.0::double as x, c_custkey * 53 % 640 / 10.0::double as y from customer),
c as (select p.*, a.a, b.b, case when a.a = 1 then x - floor(x) else 1 - (x - floor(x)) end * case when b.b = 1 then y - floor(y) else 1 - (y - floor(y)) end as w from p, (values (0), (1)) a(a), (values (0), (1)) b(b)),
s as (select id, case when sum(w) > 0.05 then sum(w * v) / sum(w) end as sampled from c join cells g on g.tile = c.tile and g.j = floor(c.x) + c.a and g.i = floor(c.y) + c.b where v is not null group by 1) select p.id, round(s.sampled, 6) as sampled from p left join s using (id)""")
def bilinear_sampling(spark, d):
    """Null-aware mean of four corners."""
    from ..session import table

    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), F.floor(k * 10 / 4096).alias("tile"), (k * 37 % 640 / 10.0).cast("double").alias("x"), (k * 53 % 640 / 10.0).cast("double").alias("y"))
    return G.bilinear(p, cells(spark, d), ["id"]).select("id", F.round("sampled", 6).alias("sampled"))


@query(f"with {_CELLS}, q as (select tile, quantile_cont(v, 0.02) as a, quantile_cont(v, 0.98) as b from cells group by 1) select c.tile, i, j, case when v is not null then round(greatest(0.0, least(255.0, (v - a) / (b - a) * 255))) end as level from cells c join q using (tile)")
def percentile_stretch(spark, d):
    """Levels between two percentiles of a band."""
    return G.stretch(cells(spark, d), ["tile"]).select("tile", "i", "j", "level")


_TX = "cast(greatest(0, least(pow(2, {z}) - 1, floor((lon + 180) / 360 * pow(2, {z})))) as int)"
_TY = "cast(greatest(0, least(pow(2, {z}) - 1, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, {z})))) as int)"


@query(f"with {RECORDS} " + " union all ".join(f"select {z} as z, {_TX.format(z=z)} as x, {_TY.format(z=z)} as y, count(*) as n from records group by 2, 3" for z in range(6)))
def tile_pyramid(spark, d):
    """Counts per tile of every zoom, each summed from the next deeper."""
    return G.tile_pyramid(records(spark, d), "lon", "lat", range(6)).select("z", "x", "y", F.col("n").cast("long").alias("n"))


@query(f"with {TRACES} select cell, sensor, case when count(*) > 13 then 12 else count(*) end as kept, greatest(0, 12 - count(*)) as spawned from traces group by 1, 2")
def density_management(spark, d):
    """12 per cell; the newest surplus retires once there are over 13."""
    p = traces(spark, d).select("cell", "sensor", F.col("event_id").alias("id"), F.col("value").alias("age"))
    m = PT.managed(p, p.select("cell", "sensor").distinct(), ["cell", "sensor"], 12, 12)
    return m.groupBy("cell", "sensor").agg(F.count_if(F.col("id") >= 0).alias("kept"), F.count_if(F.col("id") < 0).alias("spawned"))


# windows over time: batch forms of the streams

@query("select time_bucket(interval '10 days', ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def tumbling_windows(spark, d):
    """Ten-day windows (§2.13)."""
    return traces(spark, d).groupBy(F.window("ts", "10 days").alias("w"), F.col("sensor").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("select s.start, count(*) as n from events e, lateral (select unnest([date_trunc('day', e.ts), date_trunc('day', e.ts) - interval 1 day, date_trunc('day', e.ts) - interval 2 day]) as start) s group by 1")
def sliding_windows(spark, d):
    """Three-day windows, a day apart."""
    return traces(spark, d).groupBy(F.window("ts", "3 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""with l as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 2 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from l) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def session_windows(spark, d):
    """Sessions with gaps of two hours at most; an extension."""
    return traces(spark, d).groupBy("cell", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("cell").alias("user_id"), F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
