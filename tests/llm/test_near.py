import random

import corpus_pipeline
import pytest
from kestrine.llm import near

from ..conftest import SF


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_stage_holds_similarity(spark, docs_of):
    """Copies at similarity 0.8 and more go, texts below stay; all are far beyond the radius of op2."""
    rnd = random.Random(7)
    rows, want = [], set()
    for i in range(30):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        like, unlike = list(w), list(w)
        for at in range(20, 300, 60):
            like[at] = "other"
        for at in range(10, 300, 25):
            unlike[at] = "other"
        assert jaccard(grams(" ".join(w)), grams(" ".join(like))) >= 0.8 > jaccard(grams(" ".join(w)), grams(" ".join(unlike)))
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(like)), (3 * i + 2, " ".join(unlike))]
        want |= {3 * i, 3 * i + 2}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), SF).collect()} == want


def test_stage_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: grams(r.text or "") for r in docs.collect()}
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    of = {}
    for i in text:
        for g in text[i]:
            of.setdefault(g, set()).add(i)
    like = {i: {j for j in set().union(*(of[g] for g in text[i])) if j != i and jaccard(text[i], text[j]) >= 0.8} if text[i] else set() for i in text}
    assert not [(i, j) for i in kept for j in like[i] if j in set(kept)]
    assert all(like[i] for i in set(text) - set(kept) if text[i])  # clean texts stay


def brute_components(texts):
    """Smallest index reached by pairs of similarity 0.8 or more."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("tile", [8, 2048])
def test_groups_of_many_likes_and_unlikes(spark, docs_of, tile):
    """A bucket full of texts that share a passage: some are copies of each other, most lie below the similarity, and full tiles are cut. No link is lost."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(10**6)}"
    shared = [word() for _ in range(120)]
    texts = []
    for _ in range(25):
        own = [word() for _ in range(45)]
        texts.append(" ".join(shared + own))
        for _ in range(rnd.randrange(4)):
            like = list(own)
            like[rnd.randrange(45)] = word()
            texts.append(" ".join(shared + like))
    rnd.shuffle(texts)
    want = brute_components(texts)
    got = {r.id: r.component_id for r in near.near_duplicates(docs_of(list(enumerate(texts))), tile=tile).collect()}
    assert got == dict(enumerate(want)) and 5 < len(set(want)) < len(texts)


def families(seed=3, n=12, copies=30, words=200):
    """Texts with 2 to 5 of their words changed, again and again: many lie below the similarity of each other, and above that of some."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = []
    for _ in range(n):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            like = list(base)
            for _ in range(rnd.randrange(2, 6)):
                like[rnd.randrange(words)] = word()
            texts.append(" ".join(like))
    return texts


@pytest.mark.parametrize("block", [7, 256])
def test_no_link_is_lost_where_the_nearest_tie_fails(docs_of, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = families()
    want = brute_components(texts)
    got = {r.id: r.component_id for r in near.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(want))
    kept = near.keep_one(docs_of(list(enumerate(texts)))).count()
    assert kept == len(set(want))


def test_intersections(monkeypatch):
    import numpy as np

    monkeypatch.setattr(near, "COLUMNS", 16)
    rnd = random.Random(1)
    sets = [np.unique(np.array([rnd.randrange(100) for _ in range(rnd.randrange(0, 60))], dtype=np.uint64)) for _ in range(40)]
    assert near.intersections(sets).astype(int).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert near.linked([sets[0][:0], sets[0][:0], sets[1]], np.ones((3, 3), dtype=bool)) == [(0, 1)]


def test_a_farther_text_links_where_the_nearest_does_not(docs_of):
    """Of three texts two are nearer by fingerprint but unlike; the like pair is found by the exact blocks."""
    import numpy as np

    texts = families(seed=9, n=3, copies=40, words=120)
    sign = [near.signature(near.shingles(t.encode())) for t in texts]
    far = near.distances(np.array([f for _, f in sign]), np.array([f for _, f in sign]))
    np.fill_diagonal(far, 999)
    sets = [grams(t) for t in texts]
    like = np.array([[jaccard(a, b) >= 0.8 for b in sets] for a in sets])
    np.fill_diagonal(like, False)
    assert any(like[i].any() and not like[i, far[i].argmin()] for i in range(len(texts)))
    got = {r.id: r.component_id for r in near.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_unlike_texts_without_ids_stay(docs_of):
    assert near.keep_one(docs_of([(None, "one of them here now"), (None, "quite another text again"), (None, "one of them here now")])).count() == 2


def test_chains_reach_their_smallest_id(docs_of):
    """Each text is like the next one only; all are one group."""
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w[16 * k : 16 * k + 160]) for k in range(14)]
    assert set(brute_components(texts)) == {0}
    assert {r.component_id for r in near.near_duplicates(docs_of(list(enumerate(texts)))).collect()} == {0}


def test_fingerprints_hold_the_similarity():
    """Pairs of similarity 0.8 lie within the radius and share a tile; unlike texts lie far outside."""
    import numpy as np

    rnd = random.Random(2)
    for n in (12, 60, 400):
        within = shared = 0
        for _ in range(200):
            base = [rnd.getrandbits(64) for _ in range(n)]
            k = round(n / 9)  # Jaccard (n - k) / (n + k) = 0.8
            like = base[k:] + [rnd.getrandbits(64) for _ in range(k)]
            (ka, fa), (kb, fb) = (near.signature(np.unique(np.array(x, dtype=np.uint64))) for x in (base, like))
            within += near.distances(np.array([fa]), np.array([fb]))[0, 0] <= near.RADIUS
            shared += any(x == y for x, y in zip(ka, kb, strict=True))
        assert within >= 190 and shared >= 197
        far = near.signature(np.array([rnd.getrandbits(64) for _ in range(n)], dtype=np.uint64))[1]
        assert near.distances(np.array([fa]), np.array([far]))[0, 0] > 90


def test_odd_documents(odd, docs_of):
    assert near.near_duplicates(odd).count() == odd.count()
    assert sorted(str(r.doc_id) for r in near.keep_one(odd).collect()) == ["1", "3", "5", "6", "7", "None"]
    assert near.keep_one(docs_of([])).count() == 0
