"""Overlap of any polygons: concave, with holes, of several parts. Sums only, no clipping.

The area under an edge, down to a base line, is a trapezoid; a polygon is the
signed sum of the trapezoids of its edges. So the area that two polygons share
is the signed sum, over pairs of their edges above the same stretch of x, of
what their trapezoids share: the integral of the lower of two straight lines.
That holds for crossings, touching and shared edges alike, without a case of
its own for any. Edges are cut at strips of x, so that an edge meets only
those of its strips, and a large shape is many rows, not one (overlaps).
Where shapes are small and pairs many, a pair is one row that has both outlines
(shared_areas): only shapes are shuffled, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def flat(geom, project) -> Column:
    """A multipolygon with its points put through project(x, y) -> (x, y)."""
    def moved(p: Column) -> Column:
        x, y = project(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(geom, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, moved)))


def trapezoids(shapes: DataFrame, key: str, width: float, geom: str = "geom") -> DataFrame:
    """(key, strip, edges): edges (x0, y0, x1, y1, s) of multipolygons, cut at strips of `width`; s is 1 where the inside lies below, -1 where it lies above.

    Outer rings and holes may turn either way. Shapes must be valid: rings
    don't cross themselves or each other. Null and empty shapes have no rows.
    """
    rings = shapes.select(key, F.explode(geom).alias("p_")).select(key, F.posexplode("p_").alias("nth_", "r_"))
    turned = rings.withColumn("o_", F.signum(geo.ring_sums(F.col("r_"))["a"]) * F.when(F.col("nth_") == 0, 1).otherwise(-1))
    e = turned.select(key, "o_", F.explode(geo.edges(F.col("r_"))).alias("e")).select(key, "o_", "e.p", "e.q").where("p.x <> q.x")
    left = F.col("p.x") < F.col("q.x")
    ends = e.select(key, F.when(left, -F.col("o_")).otherwise(F.col("o_")).alias("s"), F.when(left, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(left, F.col("q")).otherwise(F.col("p")).alias("b"))
    cut = ends.withColumn("strip", F.explode(F.sequence(F.floor(F.col("a.x") / width), F.floor(F.col("b.x") / width))))
    x0, x1 = F.greatest(F.col("a.x"), F.col("strip") * width), F.least(F.col("b.x"), (F.col("strip") + 1) * width)
    at = lambda x: F.col("a.y") + (F.col("b.y") - F.col("a.y")) * ((x - F.col("a.x")) / (F.col("b.x") - F.col("a.x")))
    pieces = cut.select(key, "strip", x0.alias("x0"), at(x0).alias("y0"), x1.alias("x1"), at(x1).alias("y1"), "s").where("x0 < x1")
    return pieces.groupBy(key, "strip").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "s")).alias("edges"))


def _shared(e: Column, others: Column, base: Column) -> Column:
    """Signed area above base and below both a piece e and each of the others, summed."""
    above = F.filter(others, lambda f: (f["x0"] < e["x1"]) & (e["x0"] < f["x1"]))
    at = lambda g, x: g["y0"] + (g["y1"] - g["y0"]) * ((x - g["x0"]) / (g["x1"] - g["x0"])) - base
    # one step each, so that nothing is worked out twice
    spans = F.transform(above, lambda f: F.struct(f.alias("f"), F.greatest(e["x0"], f["x0"]).alias("lo"), F.least(e["x1"], f["x1"]).alias("hi")))
    heights = F.transform(spans, lambda x: F.struct((e["s"] * x["f"]["s"] * (x["hi"] - x["lo"])).alias("w"), at(e, x["lo"]).alias("e0"), at(e, x["hi"]).alias("e1"), at(x["f"], x["lo"]).alias("f0"), at(x["f"], x["hi"]).alias("f1")))
    gaps = F.transform(heights, lambda h: F.struct(h["w"].alias("w"), ((h["f0"] + h["f1"]) / 2).alias("mid"), (h["e0"] - h["f0"]).alias("d0"), (h["e1"] - h["f1"]).alias("d1")))

    def add(total: Column, g: Column) -> Column:
        d0, d1 = g["d0"], g["d1"]
        # the mean of the lower line: of f, less where e dips under it
        dip = F.when((d0 <= 0) & (d1 <= 0), (d0 + d1) / 2).when((d0 < 0) & (d1 > 0), d0 * d0 / (d0 - d1) / 2).when((d0 > 0) & (d1 < 0), d1 * d1 / (d1 - d0) / 2).otherwise(0.0)
        return total + g["w"] * (g["mid"] + dip)

    return F.aggregate(gaps, F.lit(0.0), add)


def overlaps(pairs: DataFrame, a: DataFrame, b: DataFrame, width: float, geom: str = "geom") -> DataFrame:
    """pairs (a_id, b_id) with area_a, area_b, both, iou of the multipolygons of a and b (id, geom); pairs without such shapes have no row.

    Strips of `width` should hold a few edges. iou is null if both are without area.
    """
    def side(shapes: DataFrame, n: str) -> tuple[DataFrame, DataFrame]:
        s = shapes.select(F.col("id").alias(f"{n}_id"), F.col(geom).alias("g_")).join(pairs.select(f"{n}_id").distinct(), f"{n}_id", "left_semi")
        return trapezoids(s, f"{n}_id", width, "g_").withColumnRenamed("edges", f"{n}_edges"), s.select(f"{n}_id", geo.area("g_").alias(f"area_{n}"), geo.box_of("g_")["y0"].alias(f"{n}_low"))

    (ta, sa), (tb, sb) = side(a, "a"), side(b, "b")
    known = pairs.join(sa, "a_id").join(sb, "b_id")
    base = F.least("a_low", "b_low")
    met = known.select("a_id", "b_id", base.alias("base")).join(ta, "a_id").join(tb, ["b_id", "strip"])
    own = F.aggregate("a_edges", F.lit(0.0), lambda t, e: t + _shared(e, F.col("b_edges"), F.col("base")))
    sums = met.groupBy("a_id", "b_id").agg(F.sum(own).alias("both"))
    out = known.drop("a_low", "b_low").join(sums, ["a_id", "b_id"], "left").withColumn("both", F.greatest(F.lit(0.0), F.least("area_a", "area_b", F.coalesce("both", F.lit(0.0)))))
    return out.withColumn("iou", F.col("both") / F.nullif(F.col("area_a") + F.col("area_b") - F.col("both"), F.lit(0.0)))


def outlined(shapes: DataFrame, geom: str = "geom") -> DataFrame:
    """shapes with area and, instead of geom, outlines xs and ys: closed rings with the inside on their left, each ended by NaN. Shapes must be valid."""
    def ring(r: Column, i: Column) -> Column:
        # turned the right way, closed and ended
        way = F.signum(geo.ring_sums(r)["a"]) * F.when(i == 0, 1).otherwise(-1)
        end = F.struct(F.lit(float("nan")).alias("x"), F.lit(float("nan")).alias("y"))
        points = F.transform(F.when(way < 0, F.reverse(r)).otherwise(r), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
        return F.flatten(F.transform(F.array(points), lambda q: F.concat(q, F.slice(q, 1, 1), F.array(end))))

    line = F.flatten(F.flatten(F.transform(geom, lambda p: F.transform(p, ring))))
    rest = [c for c in shapes.columns if c != geom]
    return shapes.select(*rest, geo.area(geom).alias("area"), line.alias("l_")).where("l_ is not null").select(*rest, "area", F.col("l_.x").alias("xs"), F.col("l_.y").alias("ys"))


def _edges(xs: pa.Array, ys: pa.Array) -> tuple[np.ndarray, ...]:
    """x0, y0, x1, y1, s of the edges of outlines, how many each has, and where they start."""
    lens = np.asarray(xs.value_lengths(), dtype=np.int64)
    x, y = np.asarray(xs.flatten(), dtype=float), np.asarray(ys.flatten(), dtype=float)
    row = np.repeat(np.arange(len(lens)), lens)
    k = np.flatnonzero((x[:-1] < x[1:]) | (x[:-1] > x[1:]))
    right = x[k] < x[k + 1]
    a, b = np.where(right, k, k + 1), np.where(right, k + 1, k)
    n = np.bincount(row[k], minlength=len(lens))
    return x[a], y[a], x[b], y[b], np.where(right, -1.0, 1.0), n, np.cumsum(n) - n


def _shared_by_row(e: tuple[np.ndarray, ...], f: tuple[np.ndarray, ...], base: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """_shared() of all edges of each row's two outlines, `block` pairs of edges at a time."""
    ex0, ey0, ex1, ey1, es, en, e_at = e
    fx0, fy0, fx1, fy1, fs, fn, f_at = f
    size = en * fn
    to = np.cumsum(size)
    out = np.zeros(len(size))
    for first in range(0, int(to[-1]) if len(to) else 0, block):
        last = min(first + block, int(to[-1]))
        r0, r1 = np.searchsorted(to, (first, last - 1), "right")
        cut = np.minimum(to[r0:r1 + 1], last) - np.maximum(to[r0:r1 + 1] - size[r0:r1 + 1], first)
        row = np.repeat(np.arange(r0, r1 + 1), cut)
        place = np.arange(first, last) - (to - size)[row]
        i, j = np.divmod(place, fn[row])
        i += e_at[row]
        j += f_at[row]
        lo, hi = np.maximum(ex0[i], fx0[j]), np.minimum(ex1[i], fx1[j])
        met = np.flatnonzero(lo < hi)
        i, j, row, lo, hi = i[met], j[met], row[met], lo[met], hi[met]
        em, fm, low = (ey1[i] - ey0[i]) / (ex1[i] - ex0[i]), (fy1[j] - fy0[j]) / (fx1[j] - fx0[j]), base[row]
        f0, f1 = fy0[j] + fm * (lo - fx0[j]) - low, fy0[j] + fm * (hi - fx0[j]) - low
        d0, d1 = ey0[i] + em * (lo - ex0[i]) - low - f0, ey0[i] + em * (hi - ex0[i]) - low - f1
        under, over = np.minimum(d0, 0.0), np.minimum(d1, 0.0)
        gap = np.abs(d0 - d1)
        crossed = d0 * d1 < 0
        # the mean of the lower line: of f, less where e dips under it
        dip = np.where(crossed, -(under * under + over * over) / 2 / np.where(crossed, gap, 1.0), (under + over) / 2)
        out += np.bincount(row, weights=es[i] * fs[j] * (hi - lo) * ((f0 + f1) / 2 + dip), minlength=len(out))
    return out


def shared_areas(pairs: DataFrame) -> DataFrame:
    """pairs of outlined() shapes with boxes, as meeting_boxes gives them, with both and iou instead of outlines, boxes and areas.

    A pair is worked out where it is made, in batches; nothing is shuffled. iou is null if both are without area.
    """
    names = [f"{n}_{c}" for n in "ab" for c in ("xs", "ys", "area", "x0", "x1", "y1", "y0")]
    rest = [c for c in pairs.columns if c not in names]
    known = pairs.select(*rest, "a_xs", "a_ys", "b_xs", "b_ys", "a_area", "b_area", F.least("a_y0", "b_y0").alias("low_"))
    schema = pairs.select(*rest, F.col("a_area").alias("area_a"), F.col("b_area").alias("area_b"), F.col("a_area").alias("both")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = lambda n: b.column(b.schema.get_field_index(n))  # noqa: E731, B023
            both = _shared_by_row(_edges(c("a_xs"), c("a_ys")), _edges(c("b_xs"), c("b_ys")), np.asarray(c("low_"), dtype=float))
            yield pa.RecordBatch.from_arrays([*map(c, rest), c("a_area"), c("b_area"), pa.array(both)], names=[*rest, "area_a", "area_b", "both"])

    out = known.mapInArrow(work, schema).withColumn("both", F.greatest(F.lit(0.0), F.least("area_a", "area_b", "both")))
    return out.withColumn("iou", F.col("both") / F.nullif(F.col("area_a") + F.col("area_b") - F.col("both"), F.lit(0.0)))
