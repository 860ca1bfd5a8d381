import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kestrine.llm import mixing, packing, queries, sharding

from ..conftest import SF
from ..helpers import assert_same
from .conftest import ODD


@pytest.fixture(scope="module")
def hf():
    """The library as the file makes it, with its defaults."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizers_library(spark, hf):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    enc = packing.encoder()
    odd = ["", " ", "\n\n  x", "don't I'LL we've", "日本語 ﬁ ½ ²", "a" * 3000, "<|endoftext|> x", "  x", "1234567 89", "é​", "\x00\x01"]
    for text in [*(r.text for r in docs), *odd]:
        assert packing.encode(enc, text) == hf.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_ids(spark, docs_of, hf):
    docs = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "x  <|endoftext|>  "), (4, "<|endoftext| > <|endoftext|"), (5, " " * 20_000 + "<|endoftext|>" + "\n" * 20_000 + "z")]
    rows = queries.packing.pieces(docs_of(docs), capacity=1 << 20).collect()
    got = {r.doc_id: np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in rows}
    assert got == {i: [*hf.encode(t, add_special_tokens=False).ids, 0] for i, t in docs}
    assert 50256 in got[1]


@pytest.mark.parametrize("space", [" ", "\n", "\t ", "\u2003", "\x1c", "\xa0 \r\n"])
@pytest.mark.parametrize("form", ["{}", "{}b", "a{}", "a {} b", "it's{}'s", "!{}9{}.", "{}<|endoftext|>{}x"])
def test_long_white_space(hf, space, form):
    enc = packing.encoder()
    for n in (1, 2, 3, packing.LONG_SPACE - 1, packing.LONG_SPACE, packing.LONG_SPACE + 1):
        text = form.format(*[space * n] * 2)
        assert packing.encode(enc, text) == hf.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n"])
def test_a_million_spaces(hf, space):
    text = f"a{space * 1_000_000}b"
    assert packing.encode(packing.encoder(), text) == hf.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, hf):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, text in docs:
        ids = [*hf.encode(text or "", add_special_tokens=False).ids, 0]
        ps = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and sum(p.length for p in ps) == len(ids)
        assert len(ids) <= 2048 and len(ps) == 1 or all(p.length == 2048 for p in ps[1:])
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(seqs)


def test_packing_round_trip(spark, hf):
    rows = queries.op5_best_fit_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check_packing(rows, docs, hf)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048 * 1.02) + 1


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(0)
    lengths = sorted(rng.integers(1, 2049, 3000).tolist(), reverse=True)
    bins, left = packing.OpenSequences(2048), []
    for n in lengths:
        fits = [c for c in left if c >= n]
        seq, offset = bins.place(n)
        if fits:
            assert 2048 - offset == min(fits) and left[seq] == min(fits)
            left[seq] -= n
        else:
            assert offset == 0 and seq == len(left)
            left.append(2048 - n)


def test_sequences_hold_the_ids(spark, docs_of, hf):
    docs = docs_of([(1, "hello world " * 1500), (2, "short"), (3, None)])
    for s in packing.sequences(packing.packed(docs)).collect():
        for p in s.parts:
            ids = np.frombuffer(bytes(s.ids), dtype="<u4")[p.offset : p.offset + p.length].tolist()
            whole = [*hf.encode({1: "hello world " * 1500, 2: "short", 3: ""}[p.doc_id], add_special_tokens=False).ids, 0]
            assert any(whole[i : i + p.length] == ids for i in range(0, len(whole) - p.length + 1))


def test_odd_documents_pack(odd):
    rows = packing.packed(odd).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(i for i, _ in ODD)
    assert packing.packed(odd.limit(0)).count() == 0
    again = packing.pack(packing.packed(odd), len(ODD))
    assert again.columns == packing.packed(odd).columns and again.count() == len(rows)


# mixing

def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= above


def test_ranks_by_code_point(spark):
    names = [f"http://{i % 7}.{i}" for i in range(300)] + ["", "é", "Z", "z", "\U0001f389", "\uffee", None]
    got = mixing.ranked(spark.createDataFrame([(s,) for s in names], "source string").repartition(5)).collect()
    want = sorted((s for s in names if s is not None), key=lambda s: s.encode()) + [None]
    assert {r.source: r.rank_ for r in got} == {s: i for i, s in enumerate(want)}


def test_targets_by_rounds(docs_of):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 5), ("b", 1), ("B", 400), (None, 2), ("é", 30), ("z", 0), ("aaaab", 3), ("aaaac", 50)])]
    got = mixing.copies(docs_of(rows)).collect()
    want = brute_targets({s: n for s, n in [("a", 5), ("b", 1), ("B", 400), (None, 2), ("é", 30), ("z", 0), ("aaaab", 3), ("aaaac", 50)]})
    assert {r.source: pytest.approx(r.target) for r in got} == want
    assert all(r.times <= 3 for r in got)


def test_mix_query(spark, duck):
    assert_same(queries.op3_mix_sources(spark, SF), duck, queries.OP3)


def test_sources_come_near_their_targets(docs_of):
    docs = docs_of([(i, "w " * (1 + i % 50), f"s{i % 5}") for i in range(20_000)])
    got = mixing.copies(docs).collect()
    took, target = defaultdict(int), {}
    for r in got:
        took[r.source] += r.size * r.times
        target[r.source] = r.target
    assert all(abs(took[s] / target[s] - 1) < 0.005 for s in target)
    again = mixing.copies(docs).collect()
    assert sorted((r.id, r.times) for r in got) == sorted((r.id, r.times) for r in again)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_long_documents_do_not_carry_a_source_away(spark, sf):
    """The words of a source differ from its target by those of its longest document at most, or by the coins of the short ones."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    took, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in mixing.copies(docs).collect():
        took[r.source] += r.size * r.times
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(took[s] - target[s]) <= longest[s] for s in target)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_every_document_gets_its_copy_with_the_fraction(docs_of, n):
    """Over many sources of few documents, each place in a source has its extra copy as often as the fraction says; sources are what seeds are here."""
    many = 1500
    docs = docs_of([(s * n + k, "w " * (10 * (k + 1)), f"{s % 3} {s:05}") for s in range(many) for k in range(n)])
    got = mixing.copies(docs.orderBy("source"), weights=(0.3,) * (many // 3) + (1.0,) * (many // 3) + (1.7,) * (many // 3)).collect()
    for k in range(n):
        for group, rate in enumerate((0.3, 1.0, 1.7)):
            times = [r.times for r in got if r.id % n == k and r.source.startswith(str(group))]
            assert len(times) == many // 3 and set(times) <= {int(rate + 1e-9), int(rate + 1e-9) + 1}
            assert abs(sum(times) / len(times) - rate) < 4.5 * math.sqrt(0.21 / len(times)) * (group != 1) + 1e-9


def test_coins_of_short_documents_are_their_own(docs_of):
    """24,000 documents of one length: none is long, every coin is the hash of its id."""
    import hashlib

    got = mixing.copies(docs_of([(i, "w", "ab"[i % 2]) for i in range(24_000)])).collect()
    for r in got:
        rate = r.target / r.source_size
        assert r.times == int(rate) + (int(hashlib.md5(f"mix:{r.id}".encode()).hexdigest()[:13], 16) / 2**52 < rate - int(rate))


def test_mixed_rows_repeat_as_counted(odd):
    times = Counter()
    for r in mixing.copies(odd).collect():
        times[r.id] += r.times
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect()) == +times
    assert mixing.mix(odd.limit(0)).count() == 0


# sharding

def test_shards_against_brute_force(spark, docs_of):
    import hashlib

    rows = [(i, f"text {i}") for i in range(500)] + [(None, None), (7, "again"), (7, "again")]
    got = sharding.sharded(docs_of(rows)).collect()
    u = lambda key, s: int(hashlib.md5(f"shard:{key}@{s}".encode()).hexdigest()[:13], 16)
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.shard == max(range(8), key=lambda s: u(key, s)) and r.grown_shard == max(range(9), key=lambda s: u(key, s))
        assert r.grown_shard in (r.shard, 8)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(got) == len(rows)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 3} == {(7, zlib.crc32(b"text 3"))}


def test_slots_over_many_slices(spark, docs_of):
    rows = sharding.with_slots(docs_of([(i, "t") for i in range(1000)]).select("doc_id", "shard"), "shard", ["doc_id"], slice_rows=50)
    assert sorted(r.slot for r in rows.collect()) == list(range(1000))


def test_weights_are_kept(spark):
    from pyspark.sql import functions as F

    n = spark.range(20_000).groupBy(sharding.rendezvous(F.col("id"), {0: 1.0, 1: 3.0}).alias("s")).count().collect()
    assert abs({r.s: r["count"] for r in n}[1] / 15_000 - 1) < 0.03


def test_shards_written(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    sharding.write_shards(odd.drop("shard"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)
    sharding.write_shards(odd.withColumn("shard_no", F.lit("mine")), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r.shard_no for r in back.collect()} == {"mine"} and "shard_no_" in back.columns
    got = sharding.sharded(odd).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r.doc_id == 7} == {200_001}
    assert sharding.sharded(odd.limit(0)).count() == 0
