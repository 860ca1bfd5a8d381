"""Closed basins of a surface: every cell filled to the height at which water would leave it.

A cell drains where one of its four sides has no cell; water goes to any of
eight neighbours. Grids are cut into chunks with a rim of one cell. A chunk
tells which of its border cells meet at what height (a tree, so no more edges
than border cells); heights over the borders are found in rounds of minima, a
round being a step from chunk to chunk; then each chunk fills its own cells.
A task holds a chunk or the borders of one, whatever the size of the surface.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: Stands for the outside in edges; cells are coded by both numbers and never negative.
OUTSIDE = -1
_HALF = 1 << 30

_CHUNK = ["tile", "ci", "cj"]
_EDGES = "tile long, ci long, cj long, a long, b long, w double"
_HEIGHTS = "tile long, node long, h double"


def _code(i, j):
    return (i + _HALF) * (2 * _HALF) + (j + _HALF)


class Sets:
    """Disjoint sets of numbers; each knows one member that others can see, or the outside."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n
        self.seen: list[int | None] = [None] * n

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def unite(self, x: int, y: int) -> tuple[int, int] | None:
        """Unite two sets; the pair of visible members that meet so, if both have one."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return None
        if self.size[x] < self.size[y]:
            x, y = y, x
        s, t = self.seen[x], self.seen[y]
        self.parent[y] = x
        self.size[x] += self.size[y]
        self.seen[x] = OUTSIDE if OUTSIDE in (s, t) else t if s is None else s
        return None if s is None or t is None else (s, t)


def _window(cells: pd.DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """The chunk's values with a rim of one cell, NaN where there is none, and the place of its corner."""
    i0, j0 = int(cells["ci"].iat[0]) * size - 1, int(cells["cj"].iat[0]) * size - 1
    v = np.full((size + 2, size + 2), np.nan)
    c = cells.sort_values("v", ascending=False)  # of cells given twice the lowest counts
    v[c["i"].to_numpy() - i0, c["j"].to_numpy() - j0] = c["v"].to_numpy()
    return v, i0, j0


def _drains(v: np.ndarray) -> np.ndarray:
    """Own cells with a side at which there is no cell."""
    none, out = np.isnan(v), np.zeros(v.shape, bool)
    out[1:-1, 1:-1] = ~none[1:-1, 1:-1] & (none[:-2, 1:-1] | none[2:, 1:-1] | none[1:-1, :-2] | none[1:-1, 2:])
    return out


def _borders(size: int):
    """Function of a chunk's cells: edges between the cells that other chunks know, and the outside."""

    def edges(cells: pd.DataFrame) -> pd.DataFrame:
        v, i0, j0 = _window(cells, size)
        drains = np.flatnonzero(np.pad(_drains(v), 1).ravel())
        v, i0, j0, n = np.pad(v, 1, constant_values=np.nan), i0 - 1, j0 - 1, size + 4
        place = np.minimum(np.arange(n), np.arange(n)[::-1])  # 0 beyond the rim, 1 on it, 2 on the chunk's own border
        depth = np.minimum.outer(place, place).ravel()
        flat, own = v.ravel(), (depth > 1).tolist()
        some = np.flatnonzero(~np.isnan(flat))
        sets, done, out = Sets(n * n + 1), [False] * (n * n), []
        for p in some[depth[some] < 3].tolist():
            sets.seen[p] = _code(i0 + p // n, j0 + p % n)
        sets.seen[n * n] = OUTSIDE
        drains = set(drains.tolist())
        for p in some[np.argsort(flat[some], kind="stable")].tolist():
            met = [sets.unite(p, n * n)] if p in drains else []
            met += [sets.unite(p, p + s) for s in (-n - 1, -n, -n + 1, -1, 1, n - 1, n, n + 1) if done[p + s] and (own[p] or own[p + s])]
            out += [(*m, float(flat[p])) for m in met if m]
            done[p] = True
        got = pd.DataFrame(out, columns=["a", "b", "w"])
        return got.assign(**{k: cells[k].iat[0] for k in _CHUNK})[[*_CHUNK, "a", "b", "w"]]

    return edges


def _meet(edges: pd.DataFrame) -> pd.DataFrame:
    """(tile, node, h) of a chunk's border cells that reach the outside over its edges, as low as they can."""
    nodes = np.unique(np.concatenate([[OUTSIDE], edges["a"].to_numpy(), edges["b"].to_numpy()]))
    a, b = np.searchsorted(nodes, edges["a"].to_numpy()), np.searchsorted(nodes, edges["b"].to_numpy())
    near: dict[int, list[tuple[int, float]]] = {}
    for x, y, w in zip(a.tolist(), b.tolist(), edges["w"].tolist(), strict=True):
        near.setdefault(x, []).append((y, w))
        near.setdefault(y, []).append((x, w))
    h, heap = {}, [(-np.inf, 0)]
    while heap:
        at, x = heapq.heappop(heap)
        if x not in h:
            h[x] = at
            for y, w in near.get(x, ()):
                if y not in h:
                    heapq.heappush(heap, (max(at, w), y))
    h.pop(0)
    return pd.DataFrame({"tile": edges["tile"].iat[0], "node": nodes[list(h)] if h else np.empty(0, np.int64), "h": list(h.values())})


def _fill(size: int):
    """Function of a chunk's cells and the heights at its borders: own cells filled."""

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["h"].notna()
        if known.all():
            return pd.DataFrame({c: [] for c in ("tile", "i", "j", "v", "filled")})
        v, i0, j0 = _window(rows[~known], size)
        n = size + 2
        flat, level, done = v.ravel().tolist(), np.full(n * n, np.nan), [False] * (n * n)
        heap = [(flat[p], p) for p in np.flatnonzero(_drains(v).ravel()).tolist()]
        at = rows[known]
        heap += list(zip(at["h"].tolist(), ((at["i"] - i0) * n + at["j"] - j0).astype(int).tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            h, p = heapq.heappop(heap)
            if done[p]:
                continue
            done[p], level[p] = True, h
            r, c = divmod(p, n)
            for y in range(max(r - 1, 1), min(r + 2, n - 1)):
                for x in range(max(c - 1, 1), min(c + 2, n - 1)):
                    q = y * n + x
                    if not done[q] and flat[q] == flat[q]:
                        heapq.heappush(heap, (max(h, flat[q]), q))
        inner = np.zeros((n, n), bool)
        inner[1:-1, 1:-1] = True
        p = np.flatnonzero(inner.ravel() & ~np.isnan(v.ravel()))
        return pd.DataFrame({"tile": rows["tile"].iat[0], "i": i0 + p // n, "j": j0 + p % n, "v": v.ravel()[p], "filled": level[p]})

    return filled


def _to_chunks(df: DataFrame, size: int) -> DataFrame:
    """df with (ci, cj) of every chunk that has the cell (i, j) or has it on its rim."""
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / size), F.floor((F.col(c) + 1) / size)))
    return df.withColumn("ci", reach("i")).withColumn("cj", reach("j"))


def _placed(heights: DataFrame) -> DataFrame:
    return heights.withColumns({"i": F.shiftright("node", 31) - _HALF, "j": F.col("node").bitwiseAND(2 * _HALF - 1) - _HALF})


def overdeepened(df: DataFrame, least: float | Column = 10.0, size: int = 256, tile: str = "tile", value: str = "v") -> DataFrame:
    """(tile, i, j, v, filled, depth) of the cells of df (tile, i, j, value) that have a value, each once.

    filled is the lowest height over which the cell has a way to a drain;
    depth is what it lies below that, 0 where that is less than `least`. Null
    and NaN are no data, and cells beside them drain. Of cells given twice the
    lowest counts; an empty table gives no rows. tile must be a whole number,
    i and j within 2**30.

    Rounds are as many as a way to a drain has chunks; each takes only the
    chunks beside which a height fell in the last one, and is written.
    """
    cells = df.select(F.col(tile).cast("long").alias("tile"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(value).cast("double").alias("v"))
    cells = cells.where(F.col("v").isNotNull() & ~F.isnan("v") & F.col("tile").isNotNull() & F.col("i").isNotNull() & F.col("j").isNotNull())
    chunked = _to_chunks(cells, size)
    edges = settled(chunked.groupBy(*_CHUNK).applyInPandas(_borders(size), _EDGES))
    heights, active = None, edges
    while True:
        found = active.groupBy(*_CHUNK).applyInPandas(_meet, _HEIGHTS).groupBy("tile", "node").agg(F.min("h").alias("h"))
        if heights is None:
            heights = settled(found.withColumn("fell", F.lit(True)))
        else:
            old = heights.select("tile", "node", F.col("h").alias("old"))
            fell = F.col("h").isNotNull() & (F.col("old").isNull() | (F.col("h") < F.col("old")))
            heights = settled(old.join(found, ["tile", "node"], "full").select("tile", "node", F.least("h", "old").alias("h"), F.coalesce(fell, F.lit(False)).alias("fell")))
        if heights.where("fell").isEmpty():
            break
        at = _to_chunks(_placed(heights), size)
        changed = at.where("fell").select(*_CHUNK).distinct()
        outside = at.select(*_CHUNK, F.lit(OUTSIDE).cast("long").alias("a"), F.col("node").alias("b"), F.col("h").alias("w"))
        active = edges.unionByName(outside).join(changed, _CHUNK, "left_semi")
    border = _to_chunks(_placed(heights), size).select(*_CHUNK, "i", "j", F.lit(None).cast("double").alias("v"), "h")
    rows = chunked.withColumn("h", F.lit(None).cast("double")).select(*_CHUNK, "i", "j", "v", "h").unionByName(border)
    full = rows.groupBy(*_CHUNK).applyInPandas(_fill(size), "tile long, i long, j long, v double, filled double")
    depth = F.col("filled") - F.col("v")
    return full.withColumn("depth", F.when(depth >= least, depth).otherwise(0.0))
