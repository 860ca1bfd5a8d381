import math
import random

import numpy as np

from kestrine.llm import negatives as N
from kestrine.llm import queries

from ..conftest import SF
from ..helpers import assert_same

SCHEMA = "vec_id long, embedding array<float>, label int, score double, leaf string, rank int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1.0, "x", 3) for i, v, label in rows], SCHEMA)


def by_hand(rows, every=50):
    kept = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, label, v in kept:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out)


def found(table, every=50):
    return sorted(tuple(r) for r in N.hard_negatives(table, every).collect())


def groups(rng, n, dim, copies):
    middles = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        m = middles[0] if i % 3 == 0 else rng.choice(middles)
        v = list(m) if copies and i % 3 == 0 else [c + rng.gauss(0, 0.05) for c in m]
        rows.append((i, v, rng.randrange(10) if not (copies and i % 6 == 0) else 1))
    return rows


def test_query(spark, duck):
    assert_same(queries.op12_gnat_hard_negatives(spark, SF), duck, queries.OP12)


def test_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 6)
    monkeypatch.setattr(N, "FAN", 4)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "PACK", 8)
    for seed, copies in ((1, False), (2, True)):
        rows = groups(random.Random(seed), 400, 6, copies)
        assert found(table_of(spark, rows), 10) == by_hand(rows, 10)


def test_siblings_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 10)
    rows = groups(random.Random(4), 600, 4, False)
    tree = N.Tree(N.vectors(table_of(spark, rows)))
    x = np.array([r.v for r in N.vectors(table_of(spark, rows)).where("id % 10 = 0").collect()])
    n = (x**2).sum(axis=1)
    narrow = N.reached(tree.nodes, tree.known, x, 0.9 * n, 1.1 * n)
    leaves = tree.rows.select("leaf").distinct().count()
    assert leaves > 20 and sum(map(len, narrow)) < 0.5 * leaves * len(x)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0], 1), (50, None, 1), (100, [1.0, 2.0], None), (150, [1.0, None], 2), (200, [nan, 1.0], 2), (250, [inf, 1.0], 2), (300, [], 2)]
    assert found(table_of(spark, rows)) == [] and found(table_of(spark, [])) == []
    more = rows + [(350, [1.0, 1.0], 1), (351, [1.0, 1.0], 1), (351, [1.0, 1.0], 1), (352, [1.0], 2), (353, [0.9, 0.8], 3), (353, [0.9, 0.8], 4), (354, [0.7, 0.7], 4), (355, [0.7, 0.7], 4), (356, [-1.0, -1.0], 2), (50, [0.0, 0.0], 5), (51, [0.0, 0.0], 5), (52, [0.0, 0.0], 6)]
    assert found(table_of(spark, more)) == by_hand(more)
    copies = [(k, [0.5, 0.5], k % 3) for k in range(40)] + [(k, [0.4, 0.4], 5) for k in range(40, 60)]
    assert found(table_of(spark, copies), 5) == by_hand(copies, 5)
