import random
import re

import pytest
from pyspark.sql import functions as F

from kestrine.llm import chat, media, pii, quality, queries, warc

from ..conftest import SF
from ..helpers import assert_same
from .conftest import ODD


# chat

def test_chat_query(spark, duck):
    assert_same(queries.op6_chat_formatting(spark, SF), duck, queries.OP6)


def test_every_text_and_role_comes_back(spark):
    texts = ["", None, "<|im_end|>", "&lt;|", "&amp;#60;|", "&#60;|im_start|>", "a<", "|x", "\n<|im_end|>\n", "🎉é", "<<||", "&", "\\Q\\E"]
    roles = ["user", "assistant", "system", "tool", None, "we\nird", "<|im_start|>", "&#10;"]
    rows = [(c, t, roles[(c + t) % len(roles)], texts[(c * 3 + t) % len(texts)]) for c in range(20) for t in range(9)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", chat.parsed(F.col("formatted")).alias("p"), chat.learned(F.col("segments")).alias("l")).collect()
    for r in got:
        mine = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(x) for x in r.p] == mine
        assert r.l == "".join(t for role, t in mine if role == "assistant")


@pytest.mark.parametrize("roles,ok", [("user assistant", True), ("system user assistant user assistant", True), ("user", False), ("assistant user", False), ("user user assistant", False), ("user assistant tool assistant", True), ("user assistant system", False)])
def test_turn_order(spark, roles, ok):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles.split())], "conv_id long, turn long, role string, text string")
    assert chat.formatted(df).first().valid is ok


def test_chat_ties_nulls_and_empty(spark):
    s = "conv_id long, turn long, role string, text string, segments string, valid int"
    rows = [(None, None, None, None, "x", 1), (None, 1, "user", "b", "x", 1), (None, 1, "user", "a", "x", 1), (None, 1, "user", "a", "x", 1)]
    r = chat.formatted(spark.createDataFrame(rows, s)).select("n_turns", chat.parsed(F.col("formatted")).alias("p")).first()
    assert r.n_turns == 4 and [x.text for x in r.p] == ["", "a", "a", "b"]
    assert chat.formatted(spark.createDataFrame([], s)).count() == 0


def test_chat_of_very_long_texts(spark):
    long = "<|im_end|>& " * 50_000
    r = chat.formatted(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")).select(chat.parsed(F.col("formatted")).alias("p"), chat.learned(F.col("segments")).alias("l"), "valid").first()
    assert [x.text for x in r.p] == [long, long] and r.l == long and r.valid


# surrogates

MIXED = [
    (1, "mail ann.b7@mail3.example.com or ANN.B7@MAIL3.EXAMPLE.COM call +1 (017) 555-7713."),
    (2, "again ann.b7@mail3.example.com; card 4952935900253052 and 4952-9359-0025-3052, ip 97.51.17.173!!"),
    (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"###'),
    (4, "Mr. John Smith met Mrs. Ann Lee; Mr. John Smith. Господин Иванов. 123-45-6789"),
    (5, "Nothing here. Version 2.0, chapter 3. In 2012 there were 1,234 of them; 5 < 6 & a | b."),
]


def test_surrogates(docs_of):
    got = {r.doc_id: r for r in pii.pseudonymised(docs_of(MIXED)).collect()}
    t = {k: r.text for k, r in got.items()}
    for _, text in MIXED[:4]:
        for e in re.findall(r"\S+@[\w.]+\w|\+1 \(017\) 555-7713|4952[\d-]{12,}|97\.51\.17\.173|04[a-fA-F\d]{38}|Smith|Lee|Иванов|123-45-6789", text):
            assert e not in "\n".join(t.values()), e
    mail = re.search(r"\S+@\S+", t[1])[0]
    assert mail in t[2] and mail.upper() in t[1]
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", t[2])
    assert len(cards) == 2 and cards[0] == cards[1].replace("-", "")
    secrets = re.findall(r'"(\w{40})"', t[3])
    assert secrets[0].upper() == secrets[1] and re.fullmatch("[0-9a-f]{40}", secrets[0])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.", t[1])
    names = re.findall(r"Mr\. (\w+ \w+)", t[4])
    assert len(set(names)) == 1 and names[0].split()[0] in pii.FIRST["Latin"]["m"]
    assert all(luhn_ok(c.replace("-", "")) for c in cards)
    assert re.search(r"Mrs\. (\w+)", t[4])[1] in pii.FIRST["Latin"]["f"]
    assert re.search(r"Господин [Ѐ-ӿ]+", t[4])
    assert t[5] == MIXED[4][1] and got[5].n_entities == 0


def luhn_ok(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_check_digits(spark):
    for n in ("4952935900253052", "79927398713", "4111111111111111", "4111111111111112", "0"):
        got = spark.range(1).select((pii.luhn(F.lit(n)) % 10 == 0).alias("ok"), pii.mod97(F.lit(n)).alias("r")).first()
        assert got.ok == luhn_ok(n) and got.r == int(n) % 97
    code = "WEST12345698765432GB82"
    assert spark.range(1).select(pii.mod97(F.lit(code))).first()[0] == int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def test_numbers_that_are_no_cards_stay(docs_of):
    """Sixteen digits with a wrong check digit are no card; after a keyword they are a secret all the same."""
    rows = [(1, "order 4952935900253053 of 2123465659789240 rows"), (2, "card 4952935900253052 here"), (3, "password=4952935900253053 end"), (4, "pay to GB82 WEST 1234 5698 7654 32 now")]
    got = {r.doc_id: r for r in pii.pseudonymised(docs_of(rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_entities == 0
    card = re.search(r"\d{16}", got[2].text)[0]
    assert card != "4952935900253052" and card[0] == "4" and luhn_ok(card)
    assert re.fullmatch(r"password=\d{16} end", got[3].text) and "4952935900253053" not in got[3].text
    iban = re.search(r"GB\d\d( [A-Z0-9]{2,4})+", got[4].text)[0].replace(" ", "")
    assert iban != "GB82WEST12345698765432" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_one_name_for_a_person(docs_of):
    """Honorifics and short forms don't matter; a first name has the gender that the corpus tells."""
    rows = [(1, "Dr. John Smith, Mr. John Smith and Mr. Smith met Mrs. Jane Smith."), (2, "My name is John Smith and I know Dr. SMITH not. Prof. Smith."), (3, "Dr. Kim Lee"), (4, "Signed: John Doe")]
    t = {r.doc_id: r.text for r in pii.pseudonymised(docs_of(rows)).collect()}
    first, last = re.search(r"Dr\. (\S+) (\w+),", t[1]).groups()
    assert f"Mr. {first} {last} and Mr. {last} met" in t[1] and first.split("-")[0] in pii.FIRST["Latin"]["m"]
    jane = re.search(rf"Mrs\. (\S+) {last}\.", t[1])[1]
    assert jane.split("-")[0] in pii.FIRST["Latin"]["f"]
    assert f"name is {first} {last} and" in t[2] and f"Dr. {last.upper()} not. Prof. {last}." in t[2]
    assert re.search(r"Dr\. (\w+)", t[3])[1] in pii.FIRST["Latin"]["n"]
    assert t[4].startswith(f"Signed: {first} ") and "Doe" not in t[4]


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(1, "mail a.b@c.com", "p", 2, "q", "r")], "doc_id long, text string, xs_ string, known_ int, text_key string, row_ string")
    got = pii.pseudonymised(rows)
    assert got.columns == [*rows.columns, "n_entities"]
    r = got.first()
    assert (r.xs_, r.known_, r.text_key, r.row_, r.n_entities) == ("p", 2, "q", "r", 1) and "a.b@c.com" not in r.text


def test_against_a_count_of_entities(docs_of):
    """Over many entities of each kind: equal ones have equal surrogates, different ones different, none is real, and the kind's form stays."""
    rnd = random.Random(11)

    def card():
        body = f"4{rnd.randrange(10**14):014}"
        return body + next(str(d) for d in range(10) if luhn_ok(f"{body}{d}"))

    kinds = {
        "card": ([card() for _ in range(60)], r"\d{16}"), "ip": ([f"{rnd.randrange(1, 224)}.{rnd.randrange(256)}.{rnd.randrange(256)}.7" for _ in range(60)], r"(?:\d{1,3}\.){3}\d{1,3}"), "ssn": ([f"{i:03}-45-{rnd.randrange(10**4):04}" for i in range(100, 160)], r"\d{3}-\d\d-\d{4}"),
        "email": ([f"u{i}.x@host{i % 4}.com" for i in range(60)], r"\S+@\w+\.example\.org"), "phone": ([f"+1 ({i}) 555-{rnd.randrange(10**4):04}" for i in range(200, 260)], r"\+1 \(\d{3}\) \d{3}-\d{4}"), "name": ([f"Mr. {a}a {b}son" for a in "BCDFGHJK" for b in ("Ander", "Peter", "Jon", "Han")], r"Mr\. \S+ \w+"),
    }
    order = [(k, e) for k, (es, _) in kinds.items() for e in es] * 2
    rnd.shuffle(order)
    got = {r.doc_id: r.text for r in pii.pseudonymised(docs_of([(i, f"< {e} >") for i, (_, e) in enumerate(order)])).collect()}
    to = {}
    for i, (k, e) in enumerate(order):
        s = got[i][2:-2]
        assert re.fullmatch(kinds[k][1], s), (k, e, s)
        assert to.setdefault((k, e), s) == s
    assert len(set(to.values())) == len(to) and not set(to.values()) & {e for _, e in order}


def test_distinct_entities_stay_distinct(spark, docs_of, monkeypatch):
    """Surrogates that collide are drawn again until none do; here addresses have few to choose from."""
    small = lambda h, i, n: F.pmod(pii._draw(h, i), F.lit(min(n, 6))).cast("int")
    monkeypatch.setattr(pii, "_nth", small)
    docs = docs_of([(i, f"host {i % 40 + 1}.2.3.4 end") for i in range(80)])
    got = pii.pseudonymised(docs).collect()
    to = {}
    for r in got:
        to.setdefault(r.doc_id % 40, set()).add(r.text.split()[1])
    assert all(len(v) == 1 for v in to.values()) and len(set.union(*to.values())) == 40


@pytest.mark.parametrize("n", [199, 200, 201, 300, 20_000])
def test_long_secrets_go_whole(docs_of, n):
    rnd = random.Random(n)
    body = "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    rows = [(1, f"my token={body} end"), (2, f"see sk-{body} end"), (3, f"see sk-{body}- end"), (4, f'"password": "x" and key: {body[:100]}+/{body[100:]}')]
    got = {r.doc_id: r for r in pii.pseudonymised(docs_of(rows)).collect()}
    for i, text in rows:
        assert got[i].n_entities >= 1 and len(got[i].text) == len(text)
        assert not [k for k in range(0, n - 20, 10) if body[k : k + 20] in got[i].text]
    assert got[1].text.startswith("my token=") and got[1].text.endswith(" end")


def test_odd_texts_keep_their_form(odd):
    got = pii.pseudonymised(odd)
    assert got.count() == len(ODD) and sorted(map(repr, (r.text for r in got.collect()))) == sorted(repr(t) for _, t in ODD)
    assert pii.pseudonymised(odd.limit(0)).count() == 0


# WARC

def test_warc_query(spark, duck):
    assert_same(queries.op9_warc_reassembly(spark, SF), duck, queries.OP9)


def test_framing():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        body = random.Random(n).randbytes(n)
        assert warc.unframed(warc.framed(body)) == body
    with pytest.raises(ValueError):
        warc.unframed(warc.framed(b"x" * 100)[:-20])
    assert warc.unframed(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def test_segments_come_together_across_files(spark, tmp_path):
    s = "page_id long, url string, html string, type string, block string"
    rows = [(1, "http://a\r\nX: y", "é" * 9000, "t", "b"), (2, None, None, "t", "b"), (3, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nfalse" * 20, "t", "b"), (4, "u", "é" * 9000, "t", "b"), (5, "u", "short", "t", "b"), (6, "u", "short", "t", "b"), (None, "u", "é" * 9000, "t", "b"), (4, "u", "é" * 9000, "t", "b"), (1, "u", "é" * 9000, "t", "b")]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, s).repartition(3), path, segment=1000, file_records=2)
    got = sorted(map(tuple, warc.resolved(warc.read(spark, path)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    want = [(1, 18000, "response", None)] * 2 + [(2, 0, "response", None), (3, len(rows[2][2]), "response", None)] + [(4, 18000, "revisit", 1)] * 2 + [(5, 5, "response", None), (6, 5, "response", None), (None, 18000, "response", None)]
    assert got == sorted(want, key=repr)
    texts = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path).where("page_id in (1, 3)").collect()}
    assert texts == {1: rows[0][2], 3: rows[2][2]}


def test_records_follow_each_other():
    whole = b"".join(warc.record([("WARC-Type", "response")], b) + warc.END for b in (b"", b"WARC/1.1 inside", b"x" * 100))
    assert [b for _, b in warc.records(whole)] == [b"", b"WARC/1.1 inside", b"x" * 100]
    for bad in (whole[:-1], whole[:-30], whole.replace(b"Content-Length: 100", b"Content-Length: 99"), b" " + whole):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def test_revisits_name_their_record(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(i, "u", "same " * 50) for i in (3, 1, 2)], "page_id long, url string, html string").repartition(3), path)
    lines = [x.value for x in spark.read.text(path).collect()]
    mine = dict(zip([x.split()[-1] for x in lines if x.startswith("WARC-Record-ID")], [int(x.split()[-1]) for x in lines if x.startswith("Page-ID")], strict=True))
    assert [mine[x.split()[-1]] for x in lines if x.startswith("WARC-Refers-To:")] == [1, 1]


def test_missing_segment_raises(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string"), path, segment=1000)
    found = warc.parsed(spark.read.format("binaryFile").load(path))
    with pytest.raises(Exception, match="segments are missing"):
        warc.payloads(found.where("segment is null or segment <> 3")).collect()


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.read(spark, path)).count() == 0


def test_the_given_pages_are_segmented_and_read_once(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    warc.write(pages, path)
    found = warc.parsed(spark.read.format("binaryFile").load(path))
    assert found.where("type = 'continuation'").count() > 30
    assert found.where("segment is not null").agg(F.max(F.octet_length("block"))).first()[0] <= warc.SEGMENT
    told = {r.page_id: r.payload_digest for r in warc.resolved(warc.measured(found)).collect()}
    assert told == {r.page_id: r.d for r in pages.select("page_id", F.sha2(F.coalesce(F.col("html").cast("binary"), F.lit(b"")), 256).alias("d")).collect()}
    assert warc.measured(found)._jdf.queryExecution().toString().count("binaryFile") == 0  # what is told is cut: the rest of the plan doesn't parse again


def test_pages_of_some_megabytes(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), (3, "u", "x" * 100_001), (4, "u", None)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolved(warc.measured(warc.parsed(spark.read.format("binaryFile").load(path)))).collect()}
    assert got == {1: (6_000_000, "response", None), 2: (6_000_000, "revisit", 1), 3: (100_001, "response", None), 4: (0, "response", None)}



# media

def brute_media(text):
    """What op10 is to give for a text, from the contract and the WAV format, by loops."""
    import hashlib
    import struct
    import zlib

    raw = (text or "").encode()
    x = raw + b"\0" * (-len(raw) % 64)
    x = x or b"\0" * 64
    head = b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(x))
    level = [c - 128 for c in x]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(level, level[1:], strict=False))
    feature = f"mean={sum(level) * 1000 // len(x)};crossings={crossings};energy={sum(v * v for v in level) // len(x)}"
    return len(raw), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), 44 + len(x), hashlib.sha256(head + x).hexdigest(), feature


def test_media_against_brute_force(spark, docs_of):
    rnd = random.Random(4)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(30_000))
    rows = [*ODD, (90, "x" * 64), (91, "x" * 63), (92, "x" * 65), *((100 + i, f"{i} intro " * 50 + shared + f" end {i}") for i in range(6)), (200, shared), (201, shared)]
    got = media.stored_features(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).add(brute_media(t))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) in want[r.id]


def test_shared_passages_are_stored_once(spark, docs_of, tmp_path):
    rnd = random.Random(6)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    docs = docs_of([(i, f"{i} " * 400 + shared) for i in range(10)])
    path = str(tmp_path / "m")
    media.store(docs, media.digests(docs), path)
    assert spark.read.parquet(f"{path}/chunks").select("digest").distinct().count() == spark.read.parquet(f"{path}/chunks").count()
    assert spark.read.parquet(f"{path}/lists").count() > 5 * spark.read.parquet(f"{path}/chunks").count() > 5
    assert media.read(spark, path).count() == 10


def test_cuts_follow_the_content():
    t = media.gear()
    data = random.Random(1).randbytes(200_000)
    a = media.cut_points(data, t)
    b = media.cut_points(b"some words before" + data, t)
    assert a[-1] == len(data) and all(x - y <= media.MOST for x, y in zip(a, [0, *a], strict=False))
    assert len({x + 17 for x in a} & set(b)) > 0.8 * len(a)


@pytest.mark.parametrize("n", [1, 17, 1023, 1024, 5000, 70_000])
def test_cuts_are_those_of_a_rolling_hash(n):
    """The hash rolled byte by byte, and the rules of least and most applied as it goes."""
    t = media.gear()
    for data in (random.Random(n).randbytes(n), b"ab" * (n // 2) + b"c"):
        h, last, ends = 0, 0, []
        for i, c in enumerate(data, 1):
            h = ((h << 1) + int(t[c])) & 0xFFFF
            if i - last == media.MOST and i < len(data):
                hit = h >> (16 - media.MASK_BITS) == 0
                ends.append(i)
                last = i
                assert not hit or ends[-1] == i
            elif h >> (16 - media.MASK_BITS) == 0 and i - last >= media.LEAST:
                ends.append(i)
                last = i
        if last < len(data):
            ends.append(len(data))
        assert media.cut_points(data, t) == ends


def test_filter_has_what_is_put_in(spark):
    import zlib

    places = [0, 1, 32767, 32768, 32769, media.LEAST_BITS - 1, media.LEAST_BITS + 9]
    slim = spark.createDataFrame([(n, f"m{n}", p, [7]) for n, p in enumerate(places)] + [(99, "m0", 5, [9])], "id long, media_sha256 string, owner_at int, at array<int>")
    *maps, bits = media.filters(slim)
    owners, shared = map(zlib.decompress, maps)
    assert bits == media.LEAST_BITS and media.bits_for(1 << 20) == 1 << 25 and media.bits_for(1 << 40) == media.FILTER_BITS
    assert [p for p in (5, 7, 9) if media._is_set(shared, p, bits)] == [7] and not media._is_set(owners, 5, bits)
    assert [p for p in (*places, 2, 9, 40_000, 65_536) if media._is_set(owners, p, bits)] == [*places, 9]


def test_no_media(docs_of):
    assert media.stored_features(docs_of([])).count() == 0


# quality

def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    got = quality.scored(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").select("quality_score", "quality").collect()
    right = sum((r.quality_score >= quality.KEEP_FROM) == bool(r.quality) for r in got)
    assert right / len(got) > 0.95
    good = [r for r in got if r.quality]
    assert sum(r.quality_score >= quality.KEEP_FROM for r in good) / len(good) > 0.97


def test_rounds_bring_pseudo_labels_in(spark):
    """The view without labels of its own learns from the other: the metadata view sees nothing in the labels, yet all junk is of one source."""
    junk, fine = "### $$$ %%% " * 20, "Quiet words in a row, and then some more of them. "
    rows = [(i, junk if i % 2 else fine * (1 + i % 7), "en", "bad" if i % 2 else f"s{i % 5}", 100) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    alone, taught = quality.train(docs, labels, rounds=0), quality.train(docs, labels, rounds=3)
    import numpy as np

    m = np.array([quality.metadata("en", "bad", 100)])
    assert taught.meta.raw(m)[0] < alone.meta.raw(m)[0] < 0


def test_pseudo_labels_flow_both_ways(spark):
    """On the given tables each view is confident of documents of both classes, and each view changes by the other's."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    y = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    rows = quality.features(docs).join(y, "id", "left").cache()
    alone = quality._fit(rows, None, None)
    for sure in quality.sure_of(rows, alone):
        assert sure and sure.bad < sure.good and 0 < sure.bad_weight <= quality.PSEUDO_WEIGHT and 0 < sure.good_weight <= quality.PSEUDO_WEIGHT
    taught = quality._fit(rows, *alone)
    assert all(abs(a.weights - b.weights).max() > 0.01 for a, b in zip(alone, taught, strict=True))


def brute_cotraining(rows, labels, rounds):
    """Scores of rows (id, text, lang, source, n_chars) by loops over documents and features, from the docstrings of the module."""
    import math

    said = {}
    for i, q in labels:
        said.setdefault(i, []).append(q)
    y = [round(sum(said[r[0]]) / len(said[r[0]])) if r[0] in said else None for r in rows]
    text = []
    for r in rows:
        bins, packed = quality.content((r[1] or "").encode())
        on = "".join(f"{b:08b}" for b in packed)
        text.append((list(enumerate(bins)), [i for i, c in enumerate(on) if c == "1"]))
    meta = [(list(enumerate(quality.metadata(*r[2:]))), None) for r in rows]

    def fit(view, target, weight):
        counts, on, n = {}, {}, [1.0, 1.0]
        for (fs, gs), t, w in zip(view, target, weight, strict=True):
            if w:
                n[t] += w
                for f in fs:
                    counts[t, f] = counts.get((t, f), 0.0) + w
                for g in gs or ():
                    on[t, g] = on.get((t, g), 0.0) + w
        return counts, on, n

    def raw(view, model, size, own=None):
        counts, on, n = model
        total = [n[k] - 1 + 0.5 * size for k in (0, 1)]
        all_on = sum(on.get((k, g), 0.0) + 0.5 for k in (0, 1) for g in range(2 * quality.GRAMS))
        out = []
        for at, (fs, gs) in enumerate(view):
            mine = [float(own is not None and own[at] == k) for k in (0, 1)]
            if own is not None and own[at] is None:
                out.append(None)
                continue
            c = lambda k, f: max(counts.get((k, f), 0.0) + 0.5 - mine[k], 0.5)  # noqa: E731, B023
            score = math.log(total[1] - mine[1]) - math.log(total[0] - mine[0])
            score += sum(math.log(c(1, f) / (total[1] - mine[1])) - math.log(c(0, f) / (total[0] - mine[0])) for f in fs)
            if gs is not None:
                have = set(gs)
                o = [[on.get((k, g), 0.0) + 0.5 for g in range(2 * quality.GRAMS)] for k in (0, 1)]
                left = [[max(v - mine[k], 0.5) if g in have else v for g, v in enumerate(o[k])] for k in (0, 1)]
                w = [math.log(left[1][g] / (n[1] - mine[1])) - math.log(left[0][g] / (n[0] - mine[0])) for g in range(2 * quality.GRAMS)]
                middle = sum(x * (a + b) for x, a, b in zip(w, *o, strict=True)) / all_on
                score += quality.GRAM_WEIGHT * sum(w[g] - middle for g in gs) / (len(gs) + quality.FEW)
            out.append(score)
        return out

    sizes = (quality.BINS, quality.META_BUCKETS)
    known = [0 if v is None else v for v in y]
    weights = [[float(v is not None) for v in y]] * 2
    targets, models = [known, known], None
    for turn in range(rounds + 1):
        if turn:
            new = []
            for me in (0, 1):
                view, size = (text, meta)[1 - me], sizes[1 - me]
                steps = [math.floor(v / quality.FINE) for v in raw(view, models[1 - me], size)]
                free = sorted(s for s, v in zip(steps, y, strict=True) if v is None)
                rate = (sum(v == 1 for v in y) + 0.5) / (sum(v is not None for v in y) + 1)

                def edge(order, quota):
                    s = next(s for n, s in enumerate(order, 1) if n >= quota)  # noqa: B023
                    return s, min(1.0, quota / sum((x <= s) if order[0] <= order[-1] else (x >= s) for x in order))

                bad, bw = edge(free, quality.CONFIDENT * (1 - rate) * len(free))
                good, gw = edge(free[::-1], quality.CONFIDENT * rate * len(free))
                t, w = list(known), [float(v is not None) for v in y]
                if bad < good:
                    for i, (s, v) in enumerate(zip(steps, y, strict=True)):
                        if v is None and (s <= bad or s >= good):
                            t[i], w[i] = (0, quality.PSEUDO_WEIGHT * bw) if s <= bad else (1, quality.PSEUDO_WEIGHT * gw)
                new.append((t, w))
            targets, weights = [n[0] for n in new], [n[1] for n in new]
        models = [fit(v, t, w) for v, t, w in zip((text, meta), targets, weights, strict=True)]
    return [raw(v, m, s) for v, m, s in zip((text, meta), models, sizes, strict=True)], [raw(v, m, s, y) for v, m, s in zip((text, meta), models, sizes, strict=True)]


def test_cotraining_against_brute_force(spark):
    """Both views' scores of all documents, and the left-out scores of the labelled ones, after two rounds."""
    import numpy as np

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, table = quality.cotrained(docs, labels, rounds=2)
    rows = sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect())
    want, left_out = brute_cotraining(rows, [tuple(r) for r in labels.select("doc_id", "quality").collect()], 2)
    got = sorted((r.id, r.t, bytes(r.g), r.m, r.y) for r in table.collect())
    t, m = np.array([g[1] for g in got]), np.array([g[3] for g in got])
    bits = np.array([np.frombuffer(g[2], dtype=np.uint8) for g in got])
    assert np.allclose(model.text.raw(t, bits), want[0], atol=1e-3) and np.allclose(model.meta.raw(m), want[1], atol=1e-6)
    use = np.array([g[4] is not None for g in got])
    y = np.array([g[4] for g in got if g[4] is not None])
    assert np.allclose(model.text.without(t[use], y, bits[use]), [v for v in left_out[0] if v is not None], atol=1e-3)
    assert np.allclose(model.meta.without(m[use], y), [v for v in left_out[1] if v is not None], atol=1e-6)


def test_calibration_is_the_likeliest_line():
    """Against a search on a grid; without labels it says nothing, and a score that runs the wrong way is dropped."""
    import numpy as np

    rng = np.random.default_rng(4)
    raw = np.linspace(-6, 6, 49)
    n = rng.integers(1, 30, 49).astype(float)
    good = rng.binomial(n.astype(int), 1 / (1 + np.exp(-(0.8 * raw + 1)))).astype(float)
    a, b = quality.line(raw, good, n - good)
    up, down = (good.sum() + 1) / (good.sum() + 2), 1 / ((n - good).sum() + 2)
    loss = lambda a, b: (n * np.logaddexp(0, a * raw + b) - (good * up + (n - good) * down) * (a * raw + b)).sum()
    assert abs(a - 0.8) < 0.15 and abs(b - 1) < 0.3
    assert all(loss(a, b) <= loss(a + i, b + j) + 1e-6 for i in (-0.05, 0, 0.05) for j in (-0.1, 0, 0.1))
    assert quality.line(np.zeros(0), np.zeros(0), np.zeros(0)) == (0.0, 0.0)
    assert quality.line(raw, (raw < 0) * 5.0, (raw >= 0) * 5.0)[0] == 0.0


def test_scores_are_those_of_the_texts(spark, odd):
    """From the training's features or from texts anew: the same."""
    labels = spark.createDataFrame([(3, 1), (6, 0)], "doc_id long, quality int")
    a = sorted((repr(r.id), round(r.quality_score, 6)) for r in quality.scores(odd, labels).collect())
    b = sorted((repr(r.doc_id), round(r.quality_score, 6)) for r in quality.scored(odd, quality.train(odd, labels)).collect())
    assert a == b and len(a) == len(ODD)
    assert quality.scores(odd.limit(0), labels).count() == 0


def test_odd_documents_score(spark, odd):
    labels = spark.createDataFrame([(3, 1), (6, 0), (None, 1), (4, None), (3, 1)], "doc_id long, quality int")
    got = quality.scored(odd, quality.train(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.quality_score <= 1 for r in got)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert quality.keep_good(odd.limit(0), labels).count() == 0
    assert quality.scored(odd, quality.train(odd, labels.limit(0))).count() == len(ODD)


def test_quoted_keys_of_secrets(docs_of):
    texts = ['{"password": "hunter2hunter2x", "api_key": "Zk81mmQpLw09vv"}', "{'secret':'abcDEF123456xyz'}", 'the "key": is here', 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    got = {r.doc_id: r.text for r in pii.pseudonymised(docs_of(list(enumerate(texts)))).collect()}
    assert not any(x in got[0] + got[1] + got[3] for x in ("hunter2", "Zk81mm", "abcDEF", "24be64"))
    assert got[2] == texts[2]
    # what stands around the secret stays, and so do the form and length
    assert re.fullmatch(r'\{"password": "[a-z]{6}\d[a-z]{6}\d[a-z]", "api_key": "[A-Z][a-z]\d\d[a-z]{2}[A-Z][a-z][A-Z][a-z]\d\d[a-z]{2}"\}', got[0])
    assert re.fullmatch(r"\{'secret':'[a-z]{3}[A-Z]{3}\d{6}[a-z]{3}'\}", got[1])
