"""Basins against a fill of the whole surface."""

import heapq
import math
import random

import pytest

from kestrine.operators.basins import overdeepened

SCHEMA = "tile int, i int, j int, v double, name string"


def whole(cells):
    """Every cell's fill, by a search over the whole surface."""
    v, out = dict(cells), {}
    heap = [(h, c) for c, h in v.items() if any((c[0] + a, c[1] + b) not in v for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
    heapq.heapify(heap)
    while heap:
        h, c = heapq.heappop(heap)
        if c in out:
            continue
        out[c] = h
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                q = (c[0] + a, c[1] + b)
                if q in v and q not in out:
                    heapq.heappush(heap, (max(h, v[q]), q))
    return out


def maze(seed, side, holes):
    """Ways that wind through high walls from chunk to chunk, with floors of many heights."""
    rng = random.Random(seed)
    cells = {}
    for i in range(side):
        for j in range(side):
            wall = i % 4 == 1 and j != (1 if i % 8 == 1 else side - 2)
            cells[i, j] = 90.0 + rng.random() if wall or i in (0, side - 1) or j in (0, side - 1) else float(rng.randrange(40))
    cells[side - 1, side - 2] = 2.0  # the way out
    for _ in range(holes):
        del cells[rng.choice(sorted(cells))]
    return cells


@pytest.mark.parametrize("seed, side, holes, size", [(1, 15, 0, 5), (2, 12, 1, 4), (3, 17, 12, 64), (4, 16, 0, 7)])
def test_equals_a_fill_of_the_whole(spark, seed, side, holes, size):
    cells = maze(seed, side, holes)
    off = -9 if seed == 4 else 0  # numbers below zero are cells too
    rows = [(7, i + off, j + off, v, "x") for (i, j), v in cells.items()]
    got = {(r.i - off, r.j - off): (r.v, r.filled, r.depth) for r in overdeepened(spark.createDataFrame(rows, SCHEMA), 10.0, size).collect()}
    want = whole(cells)
    assert got == {c: (v, want[c], want[c] - v if want[c] - v >= 10 else 0.0) for c, v in cells.items()}
    if not holes:
        assert max(d for _, _, d in got.values()) > 20


def test_nothing_null_and_repeated_cells(spark):
    assert overdeepened(spark.createDataFrame([], SCHEMA)).count() == 0
    ring = [(1, i, j, 50.0, None) for i in range(5) for j in range(5) if (i, j) != (2, 2)]
    odd = [(1, 2, 2, 20.0, "a"), (1, 2, 2, 30.0, "b"), (1, None, 2, 1.0, None), (None, 2, 2, 1.0, None), (2, 0, 0, None, None), (2, 0, 1, math.nan, None), (2, 1, 1, 3.0, None)]
    got = {(r.tile, r.i, r.j): (r.v, r.filled, r.depth) for r in overdeepened(spark.createDataFrame(ring + odd, SCHEMA), size=2).collect()}
    assert len(got) == 26 and got[1, 2, 2] == (20.0, 50.0, 30.0) and got[2, 1, 1] == (3.0, 3.0, 0.0)
