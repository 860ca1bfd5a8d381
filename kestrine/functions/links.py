"""Links that frame a place: build, convert and take apart. Templates and base addresses are parameters of the functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import col

#: Metres per pixel of a web map at zoom 0, metres per degree, and the viewport that a zoom is chosen for: fixed values.
PIXEL, DEGREE, VIEW = 156543.03392, 111320.0, (1280.0, 900.0)
VIEW_STATE = r"^[A-Za-z0-9_.\-/&=~%,]+\z"


def fixed(x, digits: int) -> Column:
    """A number with so many decimals, rounded as it is stored."""
    return F.format_string(f"%.{digits}f", col(x).cast("double"))


def zoom_for_box(west, south, east, north, least: int = 10, most: int = 19) -> Column:
    """Largest zoom at which the box fits the viewport, within bounds."""
    mid = F.radians((col(south) + col(north)) / 2)
    across = F.log2(F.lit(PIXEL * VIEW[0] / DEGREE) / F.greatest(F.lit(1e-9), F.abs(col(east) - col(west))))
    up = F.log2(F.greatest(F.lit(0.01), F.cos(mid)) * (PIXEL * VIEW[1] / DEGREE) / F.greatest(F.lit(1e-9), F.abs(col(north) - col(south))))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.least(across, up), 0))).cast("int")


def centred(base: str, lon, lat, zoom, active: Column | None = None, mode: Column | str = "explore", extra: Column | None = None) -> Column:
    """base#mapCenter=lon,lat,zoom&mode=...&active=...&extra, with what is null left out."""
    centre = F.concat(F.lit("mapCenter="), fixed(lon, 5), F.lit("%2C"), fixed(lat, 5), F.lit("%2C"), col(zoom).cast("string") if isinstance(zoom, str) else zoom.cast("string"))
    mode = F.lit(mode) if isinstance(mode, str) else mode
    parts = F.concat_ws("&", centre, F.concat(F.lit("mode="), F.nullif(mode, F.lit(""))), F.concat(F.lit("active="), F.nullif(active, F.lit(""))) if active is not None else F.lit(None).cast("string"), F.nullif(extra, F.lit("")) if extra is not None else F.lit(None).cast("string"))
    return F.concat(F.lit(base), F.lit("#"), parts)


def converted(url) -> Column:
    """A link that frames a box (#ext=w,s,e,n) as one that is centred; other parameters stay, other links too."""
    u = col(url)
    fragment = F.substring_index(u, "#", -1)
    pairs = F.filter(F.split(fragment, "&"), lambda p: F.contains(p, F.lit("=")))
    value = lambda key: F.get(F.transform(F.filter(pairs, lambda p: F.startswith(p, F.lit(f"{key}="))), lambda p: F.substring(p, F.lit(len(key) + 2), F.length(p))), F.lit(0))
    box = F.transform(F.split(F.replace(value("ext"), F.lit("%2C"), F.lit(",")), ","), lambda x: x.try_cast("double"))
    n = lambda i: F.get(box, F.lit(i))
    fits = F.contains(u, F.lit("#")) & value("ext").isNotNull() & value("mapCenter").isNull() & (F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull())
    rest = F.array_join(F.filter(pairs, lambda p: ~p.rlike("^(ext|active|mode)=")), "&")
    base = F.substring_index(u, "#", 1)
    new = centred("", (n(0) + n(2)) / 2, (n(1) + n(3)) / 2, zoom_for_box(n(0), n(1), n(2), n(3)), value("active"), F.coalesce(value("mode"), F.lit("explore")), rest)
    return F.when(F.coalesce(fits, F.lit(False)), F.concat(base, new)).otherwise(u)


def filled(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns; null if any is."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def story_slug(url, prefix: str) -> Column:
    """Last part of a link with the prefix, without query and fragment; null if it isn't a plain name."""
    rest = F.regexp_replace(F.regexp_replace(F.substring(F.trim(col(url)), F.lit(len(prefix) + 1), F.length(F.trim(col(url)))), r"[?#].*", ""), r"/+\z", "")
    return F.when(F.startswith(F.trim(col(url)), F.lit(prefix)) & rest.rlike(r"^[A-Za-z0-9_-]+\z"), rest)


def is_view_state(v) -> Column:
    return F.coalesce(col(v).rlike(VIEW_STATE) & F.contains(col(v), F.lit("map=")), F.lit(False))


def view_state(v) -> Column:
    """struct(zoom, lat, lon, base, swipe, sx, extras map) of a hash; what is out of range is null."""
    pairs = F.filter(F.split(F.regexp_replace(col(v), "^#", ""), "&"), lambda p: F.instr(p, F.lit("=")) > 0)
    m = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p)).alias("value")))))
    at = F.split(F.try_element_at(m, F.lit("map")), "/")
    num = lambda i: F.get(at, F.lit(i)).try_cast("double")
    ok = num(0).between(0, 24) & num(1).between(-90, 90) & num(2).between(-540, 540)
    part = lambda i: F.when(ok, num(i))
    text = lambda k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    sx = F.try_element_at(m, F.lit("sx")).try_cast("double")
    known = ("map", "base", "swipe", "sx", "ov")
    return F.struct(part(0).alias("zoom"), part(1).alias("lat"), part(2).alias("lon"), text("base").alias("base"), text("swipe").alias("swipe"), F.when(sx.between(0, 100), sx).alias("sx"), F.map_filter(m, lambda k, _: ~k.isin(*known)).alias("extras"))


def encoded(zoom, lat, lon, base=None, extras: Column | None = None) -> Column:
    """The hash of a view: zoom with 2 decimals, place with 4; parts that are null are left out."""
    place = F.concat(F.lit("map="), fixed(zoom, 2), F.lit("/"), fixed(lat, 4), F.lit("/"), fixed(lon, 4))
    more = F.array_join(F.transform(F.map_entries(F.map_filter(extras, lambda _, v: v != "")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&") if extras is not None else F.lit(None).cast("string")
    return F.concat(F.lit("#"), F.concat_ws("&", place, F.concat(F.lit("base="), F.nullif(col(base), F.lit("")) if base is not None else F.lit(None).cast("string")), F.nullif(more, F.lit(""))))


def nice_length(metres) -> Column:
    """Largest of 1, 2, 5 times a power of ten that isn't longer."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(col(metres))))
    m = col(metres) / p
    return p * F.when(m >= 5, 5).when(m >= 2, 2).otherwise(1)


def mercator_shift(y, ecc: float = 0.0818191908426215) -> Column:
    """Row (0 to 1) of the ellipsoidal Mercator map at the latitude of a row of the spherical one."""
    lat = F.atan(F.sinh(math.pi * (1 - 2 * col(y))))
    s = F.sin(lat)
    return 0.5 - F.ln(F.tan(math.pi / 4 + lat / 2) * F.pow((1 - ecc * s) / (1 + ecc * s), ecc / 2)) / (2 * math.pi)


def patched(text, pattern: str = r"https?://[^\s\"'<>\\]+#[^\s\"'<>\\]*ext=[^\s\"'<>\\]*") -> Column:
    """A document in which every link that fits the pattern is converted(); the rest stays byte for byte."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)), converted)
    parts = F.split(col(text), pattern, -1)
    weave = lambda new: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(new, i), F.lit("")))), "")
    return F.element_at(F.transform(F.array(found), weave), 1)


def n_patched(text, pattern: str = r"#[^\s\"'<>\\]*ext=") -> Column:
    return F.regexp_count(col(text), F.lit(pattern))
