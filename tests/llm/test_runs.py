import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kestrine.llm import queries, runs

from ..conftest import SF
from .conftest import ODD


def by_hand(w, least=12):
    """Every period, every stretch; a stretch counts under its smallest period."""
    out = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if j > i and e - s >= max(least, 2 * p) and not any(all(w[x] == w[x + q] for x in range(s, e - q)) for q in range(1, p)):
                out.add((s, e - s, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_against_every_stretch(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 14)
            for i in range(a + p, n):
                w[i] = w[i - p]
        for least in (2, 5, 12):
            assert runs.runs_of(np.array(w, dtype=np.int64), least) == by_hand(w, least)


def test_long_texts_of_one_word_and_of_long_periods():
    assert runs.runs_of(np.zeros(60_000, dtype=np.int64)) == [(0, 60_000, 1)]
    assert runs.runs_of(np.arange(50_000) % 1000) == [(0, 50_000, 1000)]
    assert runs.runs_of(np.arange(50_000)) == []


def test_positions_stay_in_order():
    rng = random.Random(3)
    xs = rng.sample(range(10_000), 4000)
    kept, plain = runs.Positions(xs[0]), [xs[0]]
    for x in xs[1:]:
        before, after = max((y for y in plain if y < x), default=-1), min((y for y in plain if y > x), default=-1)
        assert kept.add(x) == (before, after)
        plain.append(x)
    assert list(kept) == sorted(xs) and kept.size == len(xs)


def test_collapse_keeps_one_period(docs_of):
    a = "a b c " * 5 + "x y"
    got = {r.id: r for r in runs.periodic_runs(docs_of([(1, a), (2, "z " * 11), (3, "z " * 12), (4, None)])).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 15, 3)] and got[1].collapsed == "a b c x y"
    assert got[2].runs == [] and [tuple(r) for r in got[3].runs] == [(0, 12, 1)] and got[3].collapsed == "z" and got[4].collapsed == ""


def test_odd_rows(odd):
    got = runs.periodic_runs(odd).collect()
    assert len(got) == len(ODD) and {r.id: len(r.runs) for r in got if r.id}[6] == 1
    assert runs.periodic_runs(odd.limit(0)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_kruskal_runs(spark, SF).collect()
    assert len(got) == len(docs)
    changed = 0
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        if n > 1500:
            continue
        found = by_hand(w)
        drop = {i for s, e, q in found for i in range(s + q, s + e)}
        best = max(((e, -s, -q) for s, e, q in found), default=None)
        want = (None,) * 4 if best is None else (-best[1], best[0], -best[2], 1000 * best[0] // -best[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{e},{q}\n" for s, e, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()
    assert changed and any(r.n_runs for r in got)
