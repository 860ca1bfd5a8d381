"""WARC archives written and read by Spark, with segmented records put together again.

Records are built in Arrow batches and written by Spark's text sink (its line
separator is the blank lines that end a record), so archives can be in any
store. A record larger than the segment size is cut into continuations. To
read, archives are parsed record by record; segments are grouped by the
identifier of their origin, ordered by number, checked against the total
length, and chunked transfer framing is taken off.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Largest block of a record; an archive holds at most FILE_RECORDS records, so its size is bounded (128 MB unzipped).
SEGMENT = 4 << 10
FILE_RECORDS = 4000
#: Bytes of a chunk in transfer framing.
CHUNK = 8192
#: Smaller payloads are never revisits.
REVISIT_FROM = 100

END = b"\r\n\r\n"
PARSED = "record_id string, origin string, segment int, total long, type string, page_id long, uri string, digest string, refers_to long, block binary"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """HTTP response with chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for i in range(0, len(payload), chunk) if (x := payload[i : i + chunk])]
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(parts) + b"0\r\n\r\n"


def unframed(block: bytes) -> bytes:
    """Body of an HTTP message, transfer framing taken off; a frame that is cut short raises ValueError."""
    head, gap, body = block.partition(END)
    if not gap:
        raise ValueError("no end of the HTTP header")
    if not any(x.partition(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n")):
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + n


def written(key: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_key: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a response, with continuations if it is large, or a revisit that names its response's record."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("Page-ID", page_id)]
    me = f"<urn:page:{key}>"
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_key}>"), ("Refers-To-Page-ID", refers_to)], b"")
        return
    block = framed(payload)
    cuts = range(0, len(block), segment)
    for k, i in enumerate(cuts, 1):
        many = len(cuts) > 1
        kind = ("response", me, [*common, ("Content-Type", "application/http; msgtype=response")]) if k == 1 else ("continuation", f"<urn:page:{key}:{k}>", [("WARC-Segment-Origin-ID", me), *common])
        yield record([("WARC-Type", kind[0]), ("WARC-Record-ID", kind[1]), *kind[2], ("WARC-Segment-Number", k if many else None), ("WARC-Segment-Total-Length", len(block) if many and k == len(cuts) else None)], block[i : i + segment])


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record. Where none begins after another's end, lengths are wrong or the archive is cut short: ValueError."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = archive.index(END, at)
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        n = int(head["content-length"])
        block = archive[end + 4 : end + 4 + n]
        at = end + 4 + n + 4
        if len(block) != n or archive[at - 4 : at] != END:
            raise ValueError(f"the record before byte {at} is cut short")
        yield head, block


def write(pages: DataFrame, path: str, segment: int = SEGMENT, file_records: int = FILE_RECORDS) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC archives.

    Of payloads that are equal and of REVISIT_FROM bytes at least, the one
    with the smallest page_id becomes a response and the others revisit it;
    rows that repeat that page_id are responses too, and so are rows with a
    null page_id. Null html is an empty payload; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("sha", F.sha2("html", 256))
    large = F.octet_length("html") >= REVISIT_FROM
    rows = rows.withColumn("key", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.substring("sha", 1, 16), F.monotonically_increasing_id().cast("string")))
    first = rows.where(large & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min(F.struct("page_id", "key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    again = large & (F.col("page_id") != F.col("first.page_id"))
    keyed = rows.join(first, "sha", "left").withColumns({"refers_to": F.when(again, F.col("first.page_id")), "refers_key": F.when(again, F.col("first.key"))})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [r for row in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "refers_to", "refers_key")), strict=True) for r in written(*row, segment)]
            yield pa.record_batch([pa.array(got, pa.binary())], ["record"])

    out = keyed.select("key", "page_id", "url", "html", "refers_to", "refers_key").mapInArrow(run, "record binary")
    out.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parsed(archives: DataFrame) -> DataFrame:
    """One row per record of archives (content binary, gzipped or not). Archives are of bounded size."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = lambda x: None if x is None else int(x)
        for b in batches:
            for raw in b.column("content"):
                data = raw.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                got = []
                for h, block in records(data):
                    got.append((h.get("warc-record-id"), h.get("warc-segment-origin-id"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), h.get("warc-type"), number(h.get("page-id")), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").partition(":")[2] or None, number(h.get("refers-to-page-id")), block))
                if got:
                    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*got, strict=True), kinds, strict=True)], [x.split()[0] for x in PARSED.split(", ")])

    return archives.select("content").mapInArrow(run, PARSED)


KEEP = ["record_id", "page_id", "uri", "type", "digest", "refers_to"]
PAYLOADS = "record_id string, page_id long, uri string, type string, digest string, refers_to long, payload binary"


def assembled(found: DataFrame) -> DataFrame:
    """Payloads of the segmented records of parsed(): grouped by origin, ordered by number, checked, and put together."""
    keep = KEEP

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(held: list[dict]) -> object:
            block = b"".join(x["block"] for x in held)
            if [x["segment"] for x in held] != list(range(1, len(held) + 1)) or held[-1]["total"] != len(block):
                raise ValueError(f"{held[0]['record_id']}: segments are missing, or their total length is wrong")
            return pa.record_batch([*(pa.array([held[0][c]], pa.int64() if c in ("page_id", "refers_to") else pa.string()) for c in keep), pa.array([unframed(block)], pa.binary())], [*keep, "payload"])

        origin, held = None, []
        for b in batches:
            for x in b.to_pylist():
                if x["origin"] != origin and held:
                    yield done(held)
                    held = []
                origin = x["origin"]
                held.append(x)
        if held:
            yield done(held)

    parts = found.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    return parts.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(joined, PAYLOADS)


def payloads(found: DataFrame) -> DataFrame:
    """Records of parsed() put together: (record_id, page_id, uri, type, digest, refers_to, payload).

    Whole records pass where they are; only segments are shuffled, by their
    origin. A missing segment, a wrong total length or a broken frame raises
    ValueError; revisits have an empty payload.
    """
    keep, schema = KEEP, PAYLOADS

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [unframed(x) if kind == "response" else b"" for x, kind in zip(b.column("block").to_pylist(), b.column("type").to_pylist(), strict=True)]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(got, pa.binary())], [*keep, "payload"])

    one = found.where("segment is null and type in ('response', 'revisit')").mapInArrow(whole, schema)
    return one.unionByName(assembled(found))


def read(spark, path: str) -> DataFrame:
    return payloads(parsed(spark.read.format("binaryFile").load(path)))


def measured(found: DataFrame) -> DataFrame:
    """(page_id, type, digest, refers_to, payload_bytes, payload_digest) of the records of parsed(), which is read once.

    One pass takes the measures of whole records and lets segments through;
    what it tells is cut, so archives aren't parsed again for the segments.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            segments, kinds, blocks = (b.column(c).to_pylist() for c in ("segment", "type", "block"))
            told = [None if n is not None else unframed(x) if kind == "response" else b"" for n, kind, x in zip(segments, kinds, blocks, strict=True)]
            rest = [None if n is None else x for n, x in zip(segments, blocks, strict=True)]
            measures = [pa.array([None if t is None else len(t) for t in told], pa.int64()), pa.array([None if t is None else hashlib.sha256(t).hexdigest() for t in told], pa.string())]
            yield pa.record_batch([*(b.column(c) for c in b.schema.names if c != "block"), pa.array(rest, pa.binary()), *measures], [*(c for c in b.schema.names if c != "block"), "block", "payload_bytes", "payload_digest"])

    once = cut(found.where("segment is not null or type in ('response', 'revisit')").mapInArrow(run, f"{PARSED}, payload_bytes long, payload_digest string"))
    columns = ["page_id", "type", "digest", "refers_to", "payload_bytes", "payload_digest"]
    many = assembled(once).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    return once.where("segment is null").select(*columns).unionByName(many.select(*columns))


def resolved(found: DataFrame) -> DataFrame:
    """One row (page_id, payload_bytes, payload_digest, record_type, refers_to) per response or revisit of measured() or read(); a revisit's payload is that of its response."""
    if "payload" in found.columns:
        found = found.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    rows = cut(found.select("page_id", "payload_bytes", "payload_digest", "type", "refers_to", "digest"))
    base = rows.where("type = 'response'")
    told = rows.where("type = 'revisit'").select("page_id", "refers_to", "digest")
    target = base.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = told.join(target, ["refers_to", "digest"], "left").select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("digest")).alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return base.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to").unionByName(again)
