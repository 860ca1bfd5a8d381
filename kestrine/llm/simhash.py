"""Near-duplicate documents by 64-bit SimHash, compared exactly tile by tile.

Which fingerprints lie within the radius is settled by numpy exclusive-or and
bit counts inside tiles. A tile holds the distinct fingerprints that agree on
all but `radius` of the blocks into which the 64 bits are cut: two
fingerprints within the radius differ in at most `radius` blocks, so they
share a tile in at least one table of blocks, and no link is lost. Tiles that
exceed TILE rows are cut by population count and salt, and pairs of cut tiles
whose population counts differ beyond the radius are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small_batches, text_bytes

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Most fingerprints in a tile; fuller tiles are cut.
TILE = 2048
#: Fingerprints that a tile should hold on average; more blocks are used beyond.
AIM = 512


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, shingles of words with repeats; no words: 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(shingle, len(words))
    starts = [0, *(e + 1 for e in ends[:-1])]
    over = np.zeros(64, dtype=np.int64)
    n = len(words) - k + 1
    for lo in range(0, n, 65536):
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts[lo : min(n, lo + 65536)], ends[lo + k - 1 : min(n, lo + 65536) + k - 1], strict=True)], dtype=np.uint64)
        over += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(over * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row (id, fp long, text_key long) per row of docs; text_key tells apart rows that repeat an id."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in text_bytes(b, "text")], dtype=np.uint64)
            yield pa.record_batch([b.column("id"), pa.array(fp.view(np.int64)), b.column("text_key")], ["id", "fp", "text_key"])

    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return got.mapInArrow(run, "id long, fp long, text_key long")


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Least number of blocks whose tiles hold AIM fingerprints on average."""
    b = radius + 1
    while n >> (64 * (b - radius) // b) > AIM and b < radius + 4:
        b += 1
    return b


def masks(blocks: int, radius: int) -> list[int]:
    """Masks over 64 bits, one for each choice of blocks that must agree."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - radius)]


def linked(a, b, radius: int):
    """Boolean matrix of what lies within the radius, in strips ordered by population count; strips beyond it are skipped."""
    import numpy as np

    out = np.zeros((len(a), len(b)), dtype=bool)
    ca, cb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    step = 256
    for i in range(0, len(a), step):
        lo, hi = ca[i : i + step].min() - radius, ca[i : i + step].max() + radius
        for j in range(0, len(b), step):
            if cb[j : j + step].max() < lo or cb[j : j + step].min() > hi:
                continue
            out[i : i + step, j : j + step] = np.bitwise_count(a[i : i + step, None] ^ b[None, j : j + step]) <= radius
    return out


def forest(fps, sides, radius: int) -> list[tuple[int, int]]:
    """Edges (root, member) that span what is linked in a tile, or between two tiles if sides has both."""
    import numpy as np

    two = bool(len(sides)) and sides[0] != sides[-1]
    cut_at = int(np.searchsorted(sides, 1)) if two else len(fps)
    rows, cols = (fps[:cut_at], fps[cut_at:]) if two else (fps, fps)
    near = linked(rows, cols, radius)
    if not two:
        np.fill_diagonal(near, False)
    todo = near.any(axis=1)
    edges = []
    for root in np.flatnonzero(todo):
        if not todo[root]:
            continue
        todo[root] = False
        frontier, seen_cols = np.array([root]), np.zeros(near.shape[1], dtype=bool)
        while len(frontier):
            cols_new = near[frontier].any(axis=0) & ~seen_cols
            seen_cols |= cols_new
            if two:
                edges += [(int(rows[root]), int(cols[j])) for j in np.flatnonzero(cols_new)]
                fresh = near[:, cols_new].any(axis=1) & todo
                edges += [(int(rows[root]), int(rows[i])) for i in np.flatnonzero(fresh)]
            else:
                fresh = cols_new & todo
                edges += [(int(rows[root]), int(rows[i])) for i in np.flatnonzero(fresh)]
            todo &= ~fresh
            frontier = np.flatnonzero(fresh)
    return edges


def tiles(keyed: DataFrame, keys: list[str], member: str, radius: int, tile: int) -> DataFrame:
    """keyed (keys, n: rows of the keys, ones, member, more) as rows of tiles (keys, x, y, side, more), sorted by tile.

    Up to `tile` rows of a key are one tile. Above, they are cut by population
    count and a hash of the member, each cut is a tile with itself and with
    each other whose population counts lie within the radius; side tells the
    two apart.
    """
    rest = [c for c in keyed.columns if c not in (*keys, "n")]
    plain = keyed.where(F.col("n") <= tile).select(*keys, F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), *rest)
    job = [*keys, "x", "y"]
    full = keyed.where(F.col("n") > tile)
    if full.isEmpty():
        return plain.repartition(*job).sortWithinPartitions(*job, "side", "ones", member)
    cuts = full.groupBy(*keys, "ones").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("salts"))
    parts = cuts.select(*keys, "ones", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    parts = parts.withColumn("no", F.col("ones") * (1 << 20) + F.col("salt"))
    other = parts.select(*keys, F.col("ones").alias("ones2"), F.col("no").alias("no2"))
    pairs = parts.join(other, keys).where((F.col("no") <= F.col("no2")) & (F.abs(F.col("ones") - F.col("ones2")) <= radius))
    want = pairs.select(*keys, F.col("no").alias("x"), F.col("no2").alias("y"), F.explode(F.expr("if(no = no2, array(struct(no as no, 0 as side)), array(struct(no as no, 0 as side), struct(no2 as no, 1 as side)))")).alias("t"))
    own = full.join(cuts, [*keys, "ones"]).withColumn("no", F.col("ones") * (1 << 20) + F.expr(f"cast(pmod(xxhash64({member}), salts) as int)"))
    heavy = own.join(want.select(*keys, "x", "y", F.col("t.no").alias("no"), F.col("t.side").alias("side")), [*keys, "no"]).select(*keys, "x", "y", "side", *rest)
    return plain.unionByName(heavy).repartition(*job).sortWithinPartitions(*job, "side", "ones", member)


def tile_arrays(batches: Iterator, job: list[str], columns: list[str]) -> Iterator[list]:
    """For each tile of rows sorted by tile, the arrays of the columns."""
    import numpy as np

    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in job])
        got = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        at = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1), b.num_rows]
        for lo, hi in zip(at, at[1:], strict=False):
            this = tuple(ids[:, lo])
            if this != now:
                if held:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                now, held = this, []
            held.append([x[lo:hi] for x in got])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of nodes (fp long, distinct) that lie within the radius."""
    blocks = blocks_for(nodes.count(), radius)
    keyed = nodes.select("fp", F.bit_count("fp").alias("ones"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks(blocks, radius)])).alias("tab", "key"))
    sizes = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for side, fp in tile_arrays(batches, ["tab", "key", "x", "y"], ["side", "fp"]):
            got = np.array(forest(fp.view(np.uint64), side, radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            if len(got):
                yield pa.record_batch([pa.array(np.ascontiguousarray(got[:, k])) for k in (0, 1)], ["a", "b"])

    return tiles(cut(keyed.join(sizes, ["tab", "key"])), ["tab", "key"], "fp", radius, tile).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row (id, text_key, fp long, component_id) per row of docs.

    component_id is the smallest id among the rows that links of fingerprints
    within the radius reach. Null and wordless texts have fingerprint 0 and
    link like any other; null ids never name a component unless it has no
    other; rows that repeat an id each get a row; an empty table gives an
    empty result. Other columns of docs are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # cut, so that a large component's join can be split
    classes = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(classes, "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id stays; the columns are those of docs.

    Rows that repeat the kept row's id and text count once.
    """
    return first_of_each(docs, near_duplicates(docs, radius=radius))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id of each component of found (id, text_key, component_id), once."""
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("text_key").alias("key_"), F.first("id").alias("id_")).select("id_", "key_")
    keyed = docs.withColumn("key__", F.xxhash64("text"))
    out = keyed.join(stay, keyed["doc_id"].cast("long").eqNullSafe(stay["id_"]) & (keyed["key__"] == stay["key_"]), "left_semi").drop("key__")
    twice = found.groupBy("id", "text_key").count().where("count > 1")
    return out if twice.isEmpty() else out.dropDuplicates(["doc_id", "text"])
