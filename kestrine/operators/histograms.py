"""Histograms of events whose date may be an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import col

#: Ten-day bins of a year; the last one is short.
BINS, BIN_DAYS = 37, 10
FIRST_YEAR, MONTHLY_FROM = 2000, 2012
HOLOCENE_YEARS, MODERN_YEARS = 10_000, 150


def bin_of(doy) -> Column:
    return F.least(F.lit(BINS - 1), F.floor((col(doy) - 1) / BIN_DAYS)).cast("int")


def _short(events: DataFrame, most_days: int | None) -> DataFrame:
    return events if most_days is None else events.where((F.col("timing") == "point") | (F.col("span") - 1 <= most_days))


def seasonal_totals(events: DataFrame, most_days: int | None = None) -> DataFrame:
    """(n, n_unknown): events in seasonal(), and those without a positive volume."""
    return _short(events, most_days).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("volume"), F.lit(0.0)) <= 0).alias("n_unknown"))


def seasonal(events: DataFrame, most_days: int | None = None) -> DataFrame:
    """(bin, n, volume, largest): all 37 bins, of events with timing, doy, doy_end, span, year, volume.

    A point adds 1 to its bin. An interval adds to every bin the share of its
    days that lie there; one whose end lies before its start in the year runs
    over the year's end. Intervals of more than most_days are left out. A row
    makes at most 37 rows, combined before the shuffle.
    """
    e = _short(events, most_days).withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")))
    days = F.dayofyear(F.make_date(F.coalesce("year", F.lit(2001)), F.lit(12), F.lit(31)))
    piece = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    pieces = F.when(F.col("doy_end") >= F.col("doy"), F.array(piece(F.col("doy"), F.col("doy_end")))).otherwise(F.array(piece(F.col("doy"), days), piece(F.lit(1), F.col("doy_end"))))
    point = e.where("timing = 'point'").select(bin_of("doy").alias("bin"), F.lit(1.0).alias("w"), "volume")
    spread = e.where("timing = 'range'").select(F.explode(pieces).alias("p"), "span", "volume").withColumn("bin", F.explode(F.sequence(bin_of("p.a"), bin_of("p.b"))))
    last = F.when(F.col("bin") == BINS - 1, 366).otherwise((F.col("bin") + 1) * BIN_DAYS)
    spread = spread.select("bin", ((F.least(F.col("p.b"), last) - F.greatest(F.col("p.a"), F.col("bin") * BIN_DAYS + 1) + 1) / F.col("span")).cast("double").alias("w"), "volume")
    got = point.unionByName(spread).groupBy("bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("volume")).alias("volume"), F.max(F.col("w") * F.col("volume")).alias("largest"))
    dim = events.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return dim.join(got, "bin", "left").select("bin", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n", "volume", "largest")])


def timeline(events: DataFrame, last_year: int) -> DataFrame:
    """(bin, rate, volume_rate, largest): H, M, years 2000 to 2011 and months from 2012 to last_year, all of them.

    Events have year_num, day, d0, d1, volume. The year decides the era or
    year (null and 0 are modern); from 2012 on a day counts in its month, an
    interval in the months it meets by its share of days, and a year alone in
    its twelve months. Everything is per month: eras are divided by their
    years, years by 12. An event makes a row for each month that it meets.
    """
    y = F.coalesce("year_num", F.lit(0))
    e = events.withColumns({"y_": y, "v_": F.when(F.col("volume") > 0, F.col("volume"))}).where(y <= last_year)
    month = lambda d: F.date_format(d, "yyyy-MM")
    entry = lambda b, w: F.struct(b.alias("bin"), w.cast("double").alias("w"))
    era = F.when(y == -1, "H").when(y < FIRST_YEAR, "M").otherwise(y.cast("string"))
    months = F.filter(F.sequence(F.trunc("d0", "MM"), F.trunc("d1", "MM"), F.expr("interval 1 month")), lambda m: F.year(m).between(MONTHLY_FROM, last_year))
    days = lambda m: F.datediff(F.least("d1", F.last_day(m)), F.greatest("d0", m)) + 1
    spread = F.transform(months, lambda m: entry(month(m), days(m) / (F.datediff("d1", "d0") + 1)))
    alone = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: entry(F.format_string("%04d-%02d", F.col("y_"), m), F.lit(1 / 12)))
    # one pass: the bins of an event and its weight in each
    entries = F.when(y < MONTHLY_FROM, F.array(entry(era, F.lit(1.0)))).when(F.col("day").isNotNull(), F.array(entry(month("day"), F.lit(1.0)))).when(F.col("d1") >= F.col("d0"), spread).when(F.col("d0").isNull() | F.col("d1").isNull(), alone)
    got = e.select("v_", F.inline(entries))
    sums = got.groupBy("bin").agg(F.sum("w").alias("rate"), F.sum(F.col("w") * F.col("v_")).alias("volume_rate"), F.max(F.col("w") * F.col("v_")).alias("largest"))
    dim = events.sparkSession.range(1).select(F.explode(F.concat(F.array(F.lit("H"), F.lit("M")), F.transform(F.sequence(F.lit(FIRST_YEAR), F.lit(MONTHLY_FROM - 1)), lambda q: q.cast("string")), F.transform(F.sequence(F.lit(0), F.lit((last_year - MONTHLY_FROM + 1) * 12 - 1)), lambda m: F.format_string("%04d-%02d", (F.lit(MONTHLY_FROM) + F.floor(m / 12)).cast("int"), (m % 12 + 1).cast("int"))))).alias("bin"))
    per = F.when(F.col("bin") == "H", HOLOCENE_YEARS * 12).when(F.col("bin") == "M", MODERN_YEARS * 12).when(F.length("bin") == 4, 12).otherwise(1)
    return dim.join(sums, "bin", "left").select("bin", *[(F.coalesce(c, F.lit(0.0)) / per).alias(c) for c in ("rate", "volume_rate", "largest")])
