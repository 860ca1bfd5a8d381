"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import col

EARTH = 6_371_000.0


def name_key(name) -> Column:
    """Trimmed, white space collapsed, lower-cased: names with equal keys are one name."""
    return F.lower(F.regexp_replace(F.btrim(col(name), F.lit(" \t\n\r")), r"\s+", " "))


def slug(name) -> Column:
    """Runs of anything but ASCII letters and digits become one hyphen."""
    return F.lower(F.btrim(F.regexp_replace(col(name), "[^A-Za-z0-9]+", "-"), F.lit("-")))


def vocabulary(value, aliases: Mapping[str, str], known: Sequence[str]) -> Column:
    """Exact parts of matching to a vocabulary: lower-cased and trimmed, then letters and digits only, then an alias, then the singular; else null."""
    bare = F.regexp_replace(F.lower(F.trim(col(value))), r"[^\p{L}\p{N}]", "")
    out = F.when(bare.isin(*known), bare)
    for a, to in aliases.items():
        out = out.when(bare == a, to)
    single = F.regexp_replace(bare, r"s\z", "")
    return out.when(single.isin(*known), single)


def close_word(df: DataFrame, value: str, known: Sequence[str], name: str, cutoff: float = 0.8) -> DataFrame:
    """df with name: the one word of known that a value is close to by matching blocks, else null.

    The comparison runs once for each different value, and is joined back.
    """
    import difflib

    words = sorted(known)

    def one(v: str) -> str | None:
        got = difflib.get_close_matches(v, words, n=2, cutoff=cutoff)
        return got[0] if len(got) == 1 else None

    def run(vs: pd.Series) -> pd.Series:
        return vs.map(one, na_action="ignore")

    bare = F.regexp_replace(F.lower(F.trim(F.col(value))), r"[^\p{L}\p{N}]", "")
    found = df.select(F.col(value)).where(F.col(value).isNotNull()).distinct().withColumn(name, F.pandas_udf(run, "string")(bare))
    return df.join(found, value, "left")


def repaired(text) -> Column:
    """Text whose UTF-8 was read as Mac Roman or Latin-1, read aright; null if that doesn't work or signs remain."""
    import re

    sign = re.compile("|".join(MOJIBAKE_SIGNS))

    def one(v: str) -> str | None:
        for table in ("mac_roman", "latin-1"):
            try:
                fixed = v.encode(table).decode()
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if not sign.search(fixed):
                return fixed
        return None

    def run(vs: pd.Series) -> pd.Series:
        return vs.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(col(text))


def to_bool(text) -> Column:
    """Three-valued: words that aren't known are null."""
    t = F.lower(F.trim(col(text)))
    return F.when(t.isin("true", "t", "yes", "y", "1"), True).when(t.isin("false", "f", "no", "n", "0"), False)


def to_date(text, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")) -> Column:
    """The first format that fits; '' and what fits none are null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(col(text), F.lit(f))) for f in formats])


def number(text, kind: str = "double") -> Column:
    """'' and what isn't a number are null."""
    return F.trim(col(text)).try_cast(kind)


def span_days(first, last) -> Column:
    """Days of a bracket, both ends included."""
    return F.datediff(col(last), col(first)) + 1


def decimal_year(day) -> Column:
    return F.year(col(day)) + (F.dayofyear(col(day)) - 1) / F.lit(365.25)


def quarter_label(day) -> Column:
    """Middle of the quarter in decimal years."""
    return F.year(col(day)) + ((F.quarter(col(day)) - 1) * 3) / F.lit(12.0) + F.lit(0.125)


def days_in_year(year) -> Column:
    return F.dayofyear(F.make_date(col(year), F.lit(12), F.lit(31)))


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH) -> Column:
    """Metres on a sphere."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return F.when(a.isNotNull(), F.asin(F.sqrt(F.least(F.lit(1.0), a))) * 2 * radius)


def dms(degrees, minutes, seconds, hemisphere) -> Column:
    """Degrees from parts; out of range is null."""
    d = col(degrees) + col(minutes) / 60 + col(seconds) / 3600
    s = F.when(F.upper(col(hemisphere)).isin("S", "W"), -d).otherwise(d)
    most = F.when(F.upper(col(hemisphere)).isin("N", "S"), 90).otherwise(180)
    return F.when(F.abs(s) <= most, s)


def place(lat, lon) -> Column:
    """struct(lat, lon), both null if either is out of range or both are 0, as cameras without a fix write."""
    ok = col(lat).between(-90, 90) & col(lon).between(-180, 180) & ~((col(lat) == 0) & (col(lon) == 0))
    return F.struct(F.when(ok, col(lat)).alias("lat"), F.when(ok, col(lon)).alias("lon"))


def azimuth(degrees) -> Column:
    return F.when((col(degrees) >= 0) & (col(degrees) < 360), col(degrees))


def tile_x(lon, z) -> Column:
    """Column of the web-map tile, clamped to the grid."""
    n = F.pow(F.lit(2.0), col(z))
    return F.when(col(lon).isNotNull(), F.greatest(F.lit(0), F.least(n - 1, F.floor((col(lon) + 180) / 360 * n)))).cast("int")


def tile_y(lat, z) -> Column:
    """Row of the web-map tile; latitudes beyond the projection are clamped."""
    n = F.pow(F.lit(2.0), col(z))
    p = F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), col(lat))))
    return F.when(col(lat).isNotNull(), F.greatest(F.lit(0), F.least(n - 1, F.floor((1 - F.ln(F.tan(p) + 1 / F.cos(p)) / F.pi()) / 2 * n)))).cast("int")


def quadkey(x, y, z: int) -> Column:
    """One digit per level, from the bits of column and row."""
    bit = lambda v, i: F.shiftright(col(v), i).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(x, i) + 2 * bit(y, i)).cast("string") for i in range(z - 1, -1, -1)])


def subdomain(x, y, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(col(x) + col(y), F.lit(len(names))) + 1).cast("int"))


def percent_change(old, new) -> Column:
    """Signed percent, with more digits the smaller it is; '' if it isn't defined."""
    p = (col(new) - col(old)) / F.abs(col(old)) * 100
    shown = F.when(F.abs(p) < 0.01, "≈0%").when(F.abs(p) < 1, F.format_string("%+.3f%%", F.bround(p, 3))).when(F.abs(p) < 100, F.format_string("%+.2f%%", F.bround(p, 2))).otherwise(F.format_string("%+.1f%%", F.bround(p, 1)))
    return F.when(col(old).isNull() | col(new).isNull() | (col(old) == 0), "").otherwise(shown)


def seasonal(level, amplitude, phase, doy) -> Column:
    return col(level) + col(amplitude) * F.cos(2 * F.pi() * (col(doy) - col(phase)) / 365.25)


def half_up(x, digits: int) -> Column:
    """Rounds halves toward plus infinity, as scripts in browsers do."""
    return F.floor(col(x) * 10**digits + 0.5) / 10**digits


def ramp(value, stops: Sequence[tuple[float, float]], log: bool = False) -> Column:
    """Linear between stops (value, level), or linear in the logarithm; constant beyond the ends, null for null."""
    v = F.ln(F.greatest(col(value), F.lit(1e-12))) if log else col(value)
    import math

    xs = [(math.log(x) if log else float(x), float(y)) for x, y in stops]
    out = F.when(v.isNull(), None).when(v <= xs[0][0], xs[0][1])
    for (x0, y0), (x1, y1) in zip(xs, xs[1:], strict=False):
        out = out.when(v <= x1, y0 + (v - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(xs[-1][1])


def shaded(colour, shade) -> Column:
    return F.round(col(colour) * F.pow(col(shade) / 255.0, 0.7))


#: Signs of text decoded with the wrong table, in order of test: fixed values.
MOJIBAKE_SIGNS = ("\u221a.", "\u201a\u00c4.", "\u00c3[\u0080-\u00ff]", "\u00e2\u20ac.")


def mojibake(text) -> Column:
    """Number of the first signature that the text shows, or null."""
    out = F.when(F.lit(False), 0)
    for n, p in enumerate(MOJIBAKE_SIGNS, 1):
        out = out.when(col(text).rlike(p), n)
    return out


def tile_count(west, south, east, north, zooms: range) -> Column:
    """Tiles that a box covers, summed over zooms."""
    out = F.lit(0).cast("long")
    for z in zooms:
        across = tile_x(east, F.lit(z)) - tile_x(west, F.lit(z)) + 1
        down = tile_y(south, F.lit(z)) - tile_y(north, F.lit(z)) + 1
        out = out + across.cast("long") * down.cast("long")
    return out


def zoom_in_budget(west, south, east, north, budget: int = 6000, first: int = 0, last: int = 19) -> Column:
    """Deepest zoom up to which the box covers no more than budget tiles."""
    out = F.lit(first)
    for z in range(first, last + 1):
        out = F.when(tile_count(west, south, east, north, range(first, z + 1)) <= budget, z).otherwise(out)
    return out


def field_value(recent, annual, season, most: float = 25_000.0) -> Column:
    """What is measured recently, else the annual value and its season; null beyond `most`."""
    v = F.coalesce(col(recent), col(annual) + F.coalesce(col(season), F.lit(0.0)))
    return F.when(F.abs(v) <= most, v)
