import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrine.llm import exact, simhash

from ..conftest import SF
from .conftest import ODD


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, ids, radius=4):
    n, root = len(fps), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    out = [None] * n
    for g in groups.values():
        known = [ids[i] for i in g if ids[i] is not None]
        for i in g:
            out[i] = min(known) if known else None
    return out


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode("utf-8", "surrogatepass")) == brute_fingerprint(text) or "\ud800" <= max(text, default="") <= "\udfff"


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip(fps, brute_components(fps, [r.doc_id for r in rows]), strict=True), strict=True))
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_odd_documents(odd):
    got = sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd).collect()), key=repr)
    fps = [brute_fingerprint(t) for _, t in ODD]
    want = sorted(zip([i for i, _ in ODD], fps, brute_components(fps, [i for i, _ in ODD]), strict=True), key=repr)
    assert got == want


@pytest.mark.parametrize("tile", [8, 2048])
def test_links_connect_what_brute_force_connects(spark, tile):
    """A hot group of near copies is cut into tiles; no link is lost and edges don't grow with pairs."""
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {rnd.getrandbits(64) for _ in range(150)} | {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(200)}
    fps |= {0, (1 << 64) - 1, (1 << 64) - 2}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, tile=tile).collect()]
    assert all((a ^ b).bit_count() <= 8 for a, b in edges)  # a root reaches its members by links
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    ids = list(range(len(fps)))
    want = brute_components(fps, ids)
    same = {}
    assert all(same.setdefault(find(f), w) == w for f, w in zip(fps, want, strict=True)) and len(same) == len(set(want))


def test_block_masks_find_every_pair():
    rnd = random.Random(1)
    for blocks in (5, 6, 7):
        ms = simhash.masks(blocks, 4)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a
            for i in rnd.sample(range(64), 4):
                b ^= 1 << i
            assert any(a & m == b & m for m in ms)


def test_strips_skip_nothing_near():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 700, dtype=np.uint64)
    a = a[np.argsort(np.bitwise_count(a))]
    assert (simhash.linked(a, a, 20) == (np.bitwise_count(a[:, None] ^ a[None, :]) <= 20)).all()


def test_one_of_each_near_group_stays(docs_of):
    rnd = random.Random(3)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    near = [*w[:200], "changed", *w[201:]]
    out = simhash.keep_one(docs_of([(5, " ".join(w)), (3, " ".join(near)), (9, "all different text of its own"), (3, " ".join(near))]))
    assert sorted(r.doc_id for r in out.collect()) == [3, 9]
    assert out.columns == docs_of([]).columns


def test_empty_tables(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert exact.exact_duplicates(docs_of([])).count() == 0
    assert exact.keep_one(docs_of([])).count() == 0


# exact duplicates

@given(st.lists(st.tuples(st.binary(max_size=12), st.one_of(st.none(), st.integers(0, 99))), max_size=60), st.integers(100, 2000))
@settings(max_examples=150, deadline=None)
def test_trie_against_a_dictionary(rows, budget):
    """With tiny budgets, spilled by the heaviest and by the passed subtree."""
    want = {}
    for k, o in rows:
        a, n = want.get(k, (None, 0))
        want[k] = (max([x for x in (a, o) if x is not None], default=None), n + 1)
    for ordered in (False, True):
        trie, out = exact.Trie(), []
        for k, o in sorted(rows, key=lambda r: r[0]) if ordered else rows:
            trie.insert(k, o)
            if trie.bytes > budget:
                out += trie.spill_passed(k) if ordered else trie.spill_heaviest()
        out += trie.drain()
        got = {}
        for k, o, n in out:
            a, m = got.get(k, (None, 0))
            assert not ordered or k not in got
            got[k] = (max([x for x in (a, o) if x is not None], default=None), m + n)
        assert got == want


@pytest.mark.parametrize("budget", [1000, 64 << 20])
def test_odd_exact(odd, budget):
    low = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in ODD]
    got = exact.exact_duplicates(odd, budget=budget).collect()
    assert len(got) == len(ODD)
    for r in got:
        same = [i for i, t in low if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max([i for i in same if i is not None], default=None)
    assert sum(r.kept for r in got) == len({t for _, t in low})
    assert len([r for r in got if r.id == 4 and r.kept]) == 1


def test_kept_rows_keep_their_columns(odd):
    out = exact.keep_one(odd)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["None", "2", "4", "5", "6", "7"])
