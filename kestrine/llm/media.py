"""Media columns stored as content-defined chunks.

A payload becomes the samples of an 8-bit WAV. Its samples are cut where a
rolling gear hash says so, so equal passages give equal chunks wherever they
lie. Digests are counted over all different media; media none of whose chunks
another has are stored with their chunks inline, and the chunks of the others
are stored once each, chosen by joins on the digest. Reading puts the ordered
chunks together and checks the digest of the whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, small_batches, text_bytes

LEAST, MASK_BITS, MOST = 1024, 12, 16384
BLOCK = 64
#: Bits of each of the two filters that every task gets: BITS_EACH for every chunk, up to FILTER_BITS (32 MB) whatever the input. A false positive
#: only means that a chunk takes the way of shared ones, by joins on its digest, or that a copy is stored again. With over some 10^9 different
#: chunks the filters say nothing more and all chunks go by the joins: the results are the same, the shuffle is that of all payloads.
BITS_EACH, LEAST_BITS, FILTER_BITS = 16, 1 << 20, 1 << 28
RATE = 8000
#: Bytes that a writer of chunks buffers.
ROW_GROUP = 8 << 20
PACK = "media_sha256 string, samples long, digests array<binary>, z array<binary>"


def gear() -> object:
    """256 fixed pseudo-random 16-bit values."""
    import numpy as np

    return np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=2, person=b"kestrine").digest() for i in range(256)), dtype="<u2").copy()


def cut_points(data: bytes, table, least: int = LEAST, bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks. The 16-bit gear hash at a byte is the sum of the last 16 gear values, each shifted by its age; doubling steps give it for all bytes at once."""
    import numpy as np

    h = table[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += older
    at = np.flatnonzero(h >> np.uint16(16 - bits) == 0) + 1
    ends, last = [], 0
    for p in [*at.tolist(), len(data)]:
        while p - last > most:
            last += most
            ends.append(last)
        if p - last >= least or (p == len(data) and p > last):
            ends.append(p)
            last = p
    return ends


def padded(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of BLOCK."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def wav_header(n: int) -> bytes:
    """Header of a mono 8-bit WAV of n samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def wav_samples(media: bytes) -> bytes:
    riff, _, wave, _, _, form, channels, _, _, _, bits, _, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, wave, form, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(media) != 44 + n:
        raise ValueError("not a mono 8-bit WAV, or cut short")
    return media[44:]


def feature(samples: bytes) -> str:
    """Mean level, crossings of the middle and loudness of the samples, whole numbers."""
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    return f"mean={int(x.sum()) * 1000 // len(x)};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};energy={int((x * x).sum()) // len(x)}"


def _where(digest: bytes) -> int:
    """Place of a digest in a filter of any size: modulo its bits."""
    return int.from_bytes(digest[:4], "big") % FILTER_BITS


def bits_for(chunks: int) -> int:
    """Bits of a filter for so many chunks, a power of two."""
    return min(FILTER_BITS, max(LEAST_BITS, 1 << (BITS_EACH * chunks).bit_length()))


def _chunks(text: bytes, table) -> tuple[bytes, str, list[bytes], list[bytes]]:
    samples = padded(text)
    ends = cut_points(samples, table)
    parts = [samples[i:j] for i, j in zip([0, *ends], ends, strict=False)]
    return samples, hashlib.sha256(wav_header(len(samples)) + samples).hexdigest(), parts, [hashlib.sha256(x).digest()[:20] for x in parts]


def _owner_at(sha: str, doc: int | None) -> int:
    return _where(hashlib.blake2b(f"{sha}:{doc}".encode(), digest_size=4).digest())


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_bytes, media_sha256, owner_at, at array<int>) per row of docs; owner_at and at are places in the filters, of the row as owner of its media and of its chunks."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = gear()
        for b in batches:
            texts, ids = text_bytes(b, "text"), b.column("id").to_pylist()
            got = [_chunks(t, table) for t in texts]
            yield pa.record_batch([b.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([_owner_at(g[1], i) for g, i in zip(got, ids, strict=True)], pa.int32()), pa.array([[_where(d) for d in dict.fromkeys(g[3])] for g in got], pa.list_(pa.int32()))], ["id", "n_bytes", "media_sha256", "owner_at", "at"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media_sha256 string, owner_at int, at array<int>")


def filters(slim: DataFrame) -> tuple[bytes, bytes, int]:
    """Of digests(): the owner of each different media, the row with the smallest id; the places of chunks that several different media have; and the bits of both."""
    bits = bits_for(slim.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0])
    media = slim.groupBy("media_sha256").agg(F.min(F.struct("id", "owner_at", "at")).alias("o"))
    place = lambda x: F.pmod(x, F.lit(bits)).cast("int")
    own = F.array(F.struct(F.lit(0).alias("kind"), place(F.col("o.owner_at")).alias("at")))
    parts = F.transform(F.array_distinct(F.transform("o.at", place)), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("at")))
    places = media.select(F.inline(F.concat(own, parts))).groupBy("kind", "at").count().where("kind = 0 or count > 1")
    maps = places.groupBy("kind", F.bitmap_bucket_number("at").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    held = [bytearray(bits // 8 + 2 * 4096) for _ in range(2)]
    for kind, no, found in maps:
        held[kind][no * 4096 : (no + 1) * 4096] = found
    return zlib.compress(bytes(held[0]), 1), zlib.compress(bytes(held[1]), 1), bits


def _is_set(bitmap: bytes, at: int, bits: int) -> bool:
    at %= bits
    # a place p > 0 is bit (p - 1) % 32768 of bucket (p - 1) // 32768 + 1, and 0 is bit 0 of bucket 0
    no, bit = ((at - 1) // 32768 + 1, (at - 1) % 32768) if at > 0 else (0, 0)
    return bool(bitmap[no * 4096 + bit // 8] >> (bit % 8) & 1)


def store(docs: DataFrame, slim: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as media under path, each different media once (or more often where a filter's false positives say so).

    path/packs: kind=own has a row per document without shared chunks, its
    chunks compressed and in order; kind=part the same for the others, with
    null for each shared chunk; kind=chunk a row for each shared chunk, as each
    task found it. path/chunks: the shared chunks, each once. path/lists: what
    shared chunk belongs where.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters(slim))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        table, small = gear(), zstandard.ZstdCompressor(level=3)
        owners, shared = map(zlib.decompress, sent.value[:2])
        bits = sent.value[2]
        for b in batches:
            got = ([], [], [], [], [])
            for t, i in zip(text_bytes(b, "text"), b.column("id").to_pylist(), strict=True):
                samples, sha, parts, names = _chunks(t, table)
                if not _is_set(owners, _owner_at(sha, i), bits):
                    continue
                far = [_is_set(shared, _where(d), bits) for d in names]
                z = [small.compress(p) for p in parts]
                rows = [("part" if any(far) else "own", sha, len(samples), names, [None if f else x for f, x in zip(far, z, strict=True)])]
                rows += [("chunk", sha, k, [names[k]], [z[k]]) for k in range(len(z)) if far[k]]
                for row in rows:
                    for to, x in zip(got, row, strict=True):
                        to.append(x)
            yield pa.record_batch([pa.array(x, k) for x, k in zip(got, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())), strict=True)], ["kind", "media_sha256", "samples", "digests", "z"])

    packs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "kind string, " + PACK)
    packs.write.partitionBy("kind").option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/packs")
    stored = spark.read.schema(PACK + ", kind string").parquet(f"{path}/packs").withColumn("file", F.expr("_metadata.file_path"))
    chunks = stored.where("kind = 'chunk'").select("file", "media_sha256", F.col("samples").alias("no"), F.get("digests", F.lit(0)).alias("digest"), F.get("z", F.lit(0)).alias("z"))
    owner = chunks.groupBy("digest").agg(F.min(F.struct("file", "media_sha256", "no")).alias("o")).select("digest", "o.*")
    once = chunks.join(owner, ["digest", "file", "media_sha256", "no"], "left_semi").select("digest", "z")
    once.write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/chunks")
    chunks.select("media_sha256", "no", "digest").distinct().write.option("compression", "zstd").parquet(f"{path}/lists")


def read(spark, path: str) -> DataFrame:
    """Reads what store() wrote. One row (media_sha256, media binary) per different media, put together from its chunks and checked."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor()

        def done(sha: str, n: int, parts: list[bytes]) -> tuple[str, bytes]:
            media = b"" if None in parts else wav_header(n) + b"".join(parts)
            if hashlib.sha256(media).hexdigest() != sha:
                raise ValueError(f"media {sha}: chunks are missing or changed")
            return sha, media

        def batched(rows: Iterator) -> Iterator:
            held, size = [], 0
            for x in rows:
                held.append(x)
                size += len(x[1])
                if size > 8 << 20:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        def rows() -> Iterator:
            sha, n, parts = None, 0, []
            for b in batches:
                for s, no, k, zs in zip(*(b.column(c).to_pylist() for c in ("media_sha256", "no", "samples", "z")), strict=True):
                    if no >= 0:
                        parts[no] = open_.decompress(zs[0])
                    elif s != sha:
                        if sha is not None:
                            yield done(sha, n, parts)
                        sha, n, parts = s, k, [z and open_.decompress(z) for z in zs]
            if sha is not None:
                yield done(sha, n, parts)

        for held in batched(rows()):
            yield pa.record_batch([pa.array([x[0] for x in held], pa.string()), pa.array([x[1] for x in held], pa.binary())], ["media_sha256", "media"])

    small_batches(spark)
    packs = spark.read.schema(PACK + ", kind string").parquet(f"{path}/packs")
    docs = lambda kind: packs.where(F.col("kind") == kind).select("media_sha256", F.lit(-1).cast("long").alias("no"), "samples", "z")
    lists, chunks = spark.read.schema("media_sha256 string, no long, digest binary").parquet(f"{path}/lists"), spark.read.schema("digest binary, z binary").parquet(f"{path}/chunks")
    far = lists.join(chunks, "digest").select("media_sha256", "no", F.lit(0).cast("long").alias("samples"), F.array("z").alias("z"))
    many = docs("part").unionByName(far).repartition("media_sha256").sortWithinPartitions("media_sha256", "no")
    schema = "media_sha256 string, media binary"
    return docs("own").mapInArrow(run, schema).unionByName(many.mapInArrow(run, schema))


def features(found: DataFrame) -> DataFrame:
    """(media_sha256, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature) of read(): all from the stored bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = []
            for sha, media in zip(b.column("media_sha256").to_pylist(), b.column("media").to_pylist(), strict=True):
                x = wav_samples(media)
                got.append((sha, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-BLOCK:]), len(media), feature(x)))
            if got:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*got, strict=True), kinds, strict=True)], ["media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return found.mapInArrow(run, "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores docs as media, reads them back, and returns a row (id, n_bytes, media_sha256, features ...) per row of docs.

    Null texts are empty; repeated rows and ids get a row each and equal texts
    equal values; an empty table gives an empty result.
    """
    slim = cut(digests(docs, id_col, text_col))
    path = fresh_path(docs.sparkSession, "media")
    store(docs, slim, path, id_col, text_col)
    # written, so that the join of many equal texts to their media can be split
    got = features(read(docs.sparkSession, path)).dropDuplicates(["media_sha256"])
    got.write.option("compression", "zstd").parquet(f"{path}/features")
    found = docs.sparkSession.read.schema(got.schema).parquet(f"{path}/features")
    return slim.select("id", "n_bytes", "media_sha256").join(found, "media_sha256")
