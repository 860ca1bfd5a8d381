"""Filters as columns. Names are parameters, so that any table can play the role."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCLASSIFIED = "__unclassified__"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_public(reviewed="reviewed_at", deprecated="deprecated_at") -> Column:
    """Reviewed and not withdrawn; what every public answer is filtered by."""
    return col(reviewed).isNotNull() & col(deprecated).isNull()


def is_pending(reviewed="reviewed_at", deprecated="deprecated_at") -> Column:
    return col(reviewed).isNull() & col(deprecated).isNull()


def in_status(status: str | None, reviewed="reviewed_at", deprecated="deprecated_at") -> Column:
    """pending, active, deprecated or all; without a status what is withdrawn is hidden."""
    return {"pending": is_pending(reviewed, deprecated), "active": is_public(reviewed, deprecated), "deprecated": col(deprecated).isNotNull(), "all": F.lit(True)}.get(status or "", col(deprecated).isNull())


def among(value, known: Sequence[str], wanted: str | None) -> Column:
    """Equality with wanted if that is a known value; otherwise no filter."""
    return col(value) == wanted if wanted in known else F.lit(True)


def name_like(name, part: str) -> Column:
    """Case-insensitive substring; % and _ in part are wildcards."""
    return col(name).ilike(f"%{part}%")


def year_code(seismic="seismic_at", year_text="year_text", cls="cls", date_min="date_min") -> Column:
    """Year, 0 for modern, -1 for Holocene, null for unknown: the instrument's date, then the text, then the class, then the first date."""
    text = col(year_text)
    return (
        F.when(col(seismic).isNotNull(), F.year(col(seismic)))
        .when(text.rlike(r"^[0-9]{4}\z"), F.expr(f"try_cast({year_text} as int)") if isinstance(year_text, str) else text.try_cast("int"))
        .when(text.ilike("%holocene%"), -1)
        .when(text.ilike("%modern%"), 0)
        .when(col(cls).like("%Holocene%"), -1)
        .when(col(cls).like("%Modern%"), 0)
        .when(col(date_min).isNotNull(), F.year(col(date_min)))
    )


def era(year_text="year_text", seismic="seismic_at", date_min="date_min") -> Column:
    """Year or era of the rule cascade, -1 for Holocene and 0 for modern: text is trimmed, and the class has no say."""
    text = F.trim(col(year_text))
    year = F.when(text.rlike(r"^[0-9]{4}\z"), text.try_cast("int"))
    return F.coalesce(F.year(col(seismic)), year, F.when(text.ilike("%holocene%"), -1), F.when(text.ilike("%modern%"), 0), F.year(col(date_min)))


def or_unclassified(cls) -> Column:
    return F.when(F.coalesce(col(cls), F.lit("")) == "", UNCLASSIFIED).otherwise(col(cls))


def dual_range(source, deposit, kind, low: float | None, high: float | None, dep_low: float | None, dep_high: float | None) -> Column:
    """Ranges on both values; a side that is None is off. Null fails an active range; slow records have no deposit, so that range passes them."""
    def within(x: Column, lo, hi) -> Column:
        parts = ([x >= lo] if lo is not None else []) + ([x <= hi] if hi is not None else [])
        return F.coalesce(parts[0] if len(parts) == 1 else parts[0] & parts[1], F.lit(False)) if parts else F.lit(True)

    return within(col(source), low, high) & (within(col(deposit), dep_low, dep_high) | (col(kind) == "slow"))


def wrapped(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(col(lon) + 180, F.lit(360)) - 180


def in_view(lon, lat, west: float, south: float, east: float, north: float) -> Column:
    """Inside the view; a view over the antimeridian is two arcs, and one of 360 degrees or more is all longitudes."""
    inside = (col(lat) >= south) & (col(lat) <= north)
    if east - west >= 360:
        return inside
    w, e = (west + 180) % 360 - 180, (east + 180) % 360 - 180
    x = wrapped(lon)
    return inside & ((x >= w) & (x <= e) if w < e else (x >= w) | (x <= e))


def boxes_meet(x0, y0, x1, y1, box: tuple[float, float, float, float]) -> Column:
    """Bounding boxes overlap or touch; what a scan can prune by."""
    return (col(x1) >= box[0]) & (col(x0) <= box[2]) & (col(y1) >= box[1]) & (col(y0) <= box[3])


def is_dated(seismic="seismic_at", date_min="date_min", date_max="date_max", lon="lon", lat="lat") -> Column:
    """An instrument's date or a valid bracket, and a place."""
    return (col(seismic).isNotNull() | (col(date_max) >= col(date_min))) & col(lon).isNotNull() & col(lat).isNotNull()


def weak_timing(seismic="seismic_at", year_text="year_text", date_min="date_min", date_max="date_max") -> Column:
    """Why a date is weak, or null: half a bracket, or a year with nothing to support it."""
    low, high = col(date_min).isNotNull(), col(date_max).isNotNull()
    return F.when(col(seismic).isNull(), F.when(high & ~low, "only a last date").when(low & ~high, "only a first date").when(~low & ~high & col(year_text).rlike(r"^[0-9]{4}\z"), "year without bracket"))


def is_undated(seismic="seismic_at", year_text="year_text", cls="cls", date_min="date_min") -> Column:
    """No age from any source. A last date alone gives none."""
    return year_code(seismic, year_text, cls, date_min).isNull()


def has_bits(bits, mask: int) -> Column:
    return col(bits).bitwiseAND(F.lit(mask)) == mask


def packed_bits(flags: Sequence[Column | str]) -> Column:
    """Flags as an append-only bitmask: the n-th flag is bit n, null is off."""
    out = F.lit(0)
    for n, f in enumerate(flags):
        out = out + F.coalesce(col(f).cast("int"), F.lit(0)) * (1 << n)
    return out


def draw_order(cls, order: Sequence[str]) -> Column:
    """Place of a class in a list; the rest comes last."""
    out = F.when(F.lit(False), 0)
    for n, c in enumerate(order):
        out = out.when(col(cls) == c, n)
    return out.otherwise(len(order))


def plausible(value, low: float, high: float) -> Column:
    """value, or null outside the range."""
    return F.when(col(value).between(low, high), col(value))


def own_flag(reason, prefix: str) -> Column:
    """A flag that a scan set itself, by the start of its reason."""
    return F.coalesce(F.startswith(col(reason), F.lit(prefix)), F.lit(False))


def in_tile(x, y, x0, y0, x1, y1) -> Column:
    """In a half-open box: a point on a shared edge is in one tile."""
    return (col(x) >= col(x0)) & (col(x) < col(x1)) & (col(y) >= col(y0)) & (col(y) < col(y1))


def stalled(status, started, now: Column, minutes: int = 30) -> Column:
    return (col(status) == "processing") & (col(started) < now - F.make_dt_interval(mins=F.lit(minutes)))


def in_box(x, y, x0=None, x1=None, y0=None, y1=None) -> Column:
    """Within the sides of a box that are set; null fails a side that is set, and passes one that isn't."""
    out = F.lit(True)
    for value, low, high in ((x, x0, x1), (y, y0, y1)):
        for bound, ok in ((low, lambda v, b: v >= b), (high, lambda v, b: v <= b)):
            if bound is not None:
                out = out & F.coalesce(ok(col(value), F.lit(bound)), F.lit(False))
    return out
