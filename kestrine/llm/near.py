"""SimHash near-dedup at a similarity of word shingles, for stages that ask for it.

op2's radius of 4 in 64 bits holds a similarity of about 0.96. A Jaccard
similarity of 0.8 means that about 39 of 256 bits differ, so here a text has a
fingerprint of 256 bits over its distinct five-word shingles, and a radius of
56 (three standard deviations more). No two blocks of bits need agree at such
a radius, and population counts part little, so tiles are cut otherwise: texts
share one if they have the same ROWS smallest shingle hashes, by one of BANDS
orders (a pair of similarity 0.8 shares none with probability
(1 - 0.8^ROWS)^BANDS = 0.0002). Inside a tile everything is compared with
everything by numpy exclusive-or and bit counts; full tiles are cut as op2's.

A tile emits a forest of shortest distances: each text is tied to the nearest
one, groups by their nearest members, so edges don't grow with pairs. Each
edge is then checked exactly on the shingles of both texts, so that unlike
texts stay. But a tie may fall short of the similarity where one farther off
wouldn't. So texts that checked ties join are one from then on, and where
texts of several such groups lie within the radius in a tile, all their pairs
are compared exactly: texts go to blocks of BLOCK in which anything is left to
compare, the sizes of all intersections come from products of matrices, and
again only a forest of links leaves a block. A pair that shares several tiles
is compared in the first. So every pair of a tile within the radius has been
compared exactly, or is joined by links that have; what is shuffled are texts
per block, never pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, swept, text_bytes
from .simhash import TILE, tile_arrays, tiles

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
WORDS, RADIUS = 4, 56
SEED = 42
#: Texts of a block that is compared exactly, at most, with itself or another; hashes that are counted at once.
BLOCK, COLUMNS = 512, 4096
#: Comparisons with one text that share a copy of it; more are dealt to other copies, which may go to other tasks.
SHARE = 64


def shingles(text: bytes, shingle: int = SHINGLE, seed: int = SEED):
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles of words, A-Z lower-cased; no words: none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    k = min(shingle, len(words))
    ends = [*(s - 1 for s in starts[1:]), len(joined)][k - 1 :]
    return np.unique(np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts, ends, strict=False)], dtype=np.uint64))


def similarity(a, b) -> float:
    """Jaccard similarity of two results of shingles(); two empty ones are equal."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _mixed(hashes, n: int):
    """n 64-bit values for each hash, by odd multiples."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    odd, add = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    return hashes[:, None] * (odd * np.uint64(2) + np.uint64(1))[None, :] + add[None, :]


def signature(hashes) -> tuple[list[int], list[int]]:
    """Of shingles(): the keys of its tiles, and the WORDS words of its fingerprint."""
    import numpy as np
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    over = np.zeros(64 * WORDS, dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo : lo + 4096]
        np.minimum(least, _mixed(part, BANDS * ROWS).min(axis=0), out=least)
        wide = _mixed(part ^ (part >> np.uint64(29)), WORDS)
        wide ^= wide >> np.uint64(32)
        wide *= np.uint64(0x9E3779B97F4A7C15)
        wide ^= wide >> np.uint64(29)
        over += np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    keys = [xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist(), np.packbits(over * 2 > len(hashes), bitorder="little").view(np.int64).tolist()


def identity() -> list[Column]:
    """128 bits that tell texts apart, as two columns."""
    return [F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(1), "text").alias("text_key2")]


def signatures(docs: DataFrame) -> DataFrame:
    """One row (id, text_key long, text_key2 long, keys array, fp array) per row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [signature(shingles(t)) for t in text_bytes(b, "text")]
            yield pa.record_batch([*(b.column(c) for c in ("id", "text_key", "text_key2")), *(pa.array([g[k] for g in got], pa.list_(pa.int64())) for k in (0, 1))], ["id", "text_key", "text_key2", "keys", "fp"])

    got = docs.select(F.col("doc_id").cast("long").alias("id"), *identity(), "text")
    return got.mapInArrow(run, "id long, text_key long, text_key2 long, keys array<long>, fp array<long>")


def distances(a, b):
    """Differing bits of each row of a from each of b, both of WORDS columns of 64 bits."""
    import numpy as np

    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    return sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int16) for k in range(a.shape[1]))


def spaced(fps, nodes, sides):
    """(nodes, order, distances) of a tile's nodes, sorted by side and node, or between two tiles if sides has both; beyond the radius and on one side they are `none`, the largest."""
    import numpy as np

    order = np.lexsort((nodes, sides))
    fps, sides = fps[order], sides[order]
    n, none = len(nodes), 64 * WORDS + 1
    far = np.full((n, n), none, dtype=np.int16)
    if sides[0] != sides[-1]:
        m = int(np.searchsorted(sides, 1))
        far[:m, m:] = distances(fps[:m], fps[m:])
        far[m:, :m] = far[:m, m:].T
    else:
        far[:] = distances(fps, fps)
        np.fill_diagonal(far, none)
    far[far > RADIUS] = none
    return nodes[order], order, far


def forest(fps, nodes, sides):
    """Edges (a, b), a < b, of a forest of shortest distances within the radius over a tile's nodes, or between two tiles if sides has both. Ties go by nodes."""
    import numpy as np

    none = 64 * WORDS + 1
    nodes, _, far = spaced(fps, nodes, sides)
    n = len(nodes)
    todo = np.flatnonzero((far < none).any(axis=1))
    edges, best, to = [], np.full(n, none, dtype=np.int16), np.zeros(n, dtype=np.int64)
    waits = np.zeros(n, dtype=bool)
    waits[todo] = True
    for _ in range(len(todo)):
        at = int(np.argmin(np.where(waits, best, none + 1)))  # the nearest that waits, or any: another tree begins
        if best[at] < none:
            edges.append((int(nodes[at]), int(nodes[to[at]])))
        waits[at] = False
        nearer = waits & (far[at] < best)
        best[nearer], to[nearer] = far[at][nearer], at
    return [(min(e), max(e)) for e in edges]


def open_pairs(fps, nodes, sides, roots, keys, own: int):
    """(order, open): a tile's nodes by side and node, and which pairs of them are left: of different roots, within the radius, and in no earlier tile than `own`, a column of keys."""
    import numpy as np

    _, order, far = spaced(fps, nodes, sides)
    roots, keys = roots[order], keys[order]
    left = (far <= RADIUS) & (roots[:, None] != roots[None, :])
    for band in range(own):
        left &= keys[:, None, band] != keys[None, :, band]
    return order, left


def intersections(sets: list):
    """Sizes of the intersections of all pairs of sorted arrays of different hashes."""
    import numpy as np

    n, sizes = len(sets), np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        has = np.zeros((n, COLUMNS), dtype=np.float32)
        has[owner[i:j], column[i:j] - lo] = 1
        out += has @ has.T
    np.fill_diagonal(out, sizes)
    return out


def linked(sets: list, left) -> list[tuple[int, int]]:
    """Places (i, j) of a forest of the pairs that are left and have a similarity of SIMILAR or more."""
    import numpy as np

    both, sizes = intersections(sets), np.array([len(x) for x in sets], dtype=np.float32)
    either = sizes[:, None] + sizes[None, :] - both
    # two texts without words are equal
    like = left & np.where(either > 0, both.astype(np.float64) / np.maximum(either, 1) >= SIMILAR, True)
    up, out = list(range(len(sets))), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in np.argwhere(np.triu(like | like.T, 1)).tolist():
        a, b = top(i), top(j)
        if a != b:
            up[b] = a
            out.append((i, j))
    return out


def candidates(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Different edges (a, b) of the forests of the tiles of rows (key, n, node, ones, f0 ...)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for side, node, *fp in tile_arrays(batches, ["key", "x", "y"], ["side", "node", *(f"f{k}" for k in range(WORDS))]):
            got = np.array(forest(np.stack(fp, axis=1), node, side), dtype=np.int64).reshape(-1, 2)
            if len(got):
                yield pa.record_batch([pa.array(np.ascontiguousarray(got[:, k])) for k in (0, 1)], ["a", "b"])

    return tiles(rows, ["key"], "node", RADIUS + 1, tile).mapInArrow(run, "a long, b long").distinct()


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) have a similarity of SIMILAR or more."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, of_last = None, None
        for r in batches:
            ok = []
            for a, text_a, text_b in zip(r.column("a").to_pylist(), text_bytes(r, "text_a"), text_bytes(r, "text_b"), strict=True):
                if a != last:
                    last, of_last = a, shingles(text_a)
                ok.append(similarity(of_last, shingles(text_b)) >= SIMILAR)
            yield r.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def with_text(rows: DataFrame, side: str, other: str) -> DataFrame:
        """A node with many pairs has its text copied to several keys, so that its pairs don't meet in one task."""
        many = rows.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("copies"))
        dealt = rows.join(many, side).withColumn("salt", F.pmod(F.xxhash64(other), F.col("copies"))).drop("copies")
        copies = many.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
        return dealt.join(copies, [side, "salt"]).drop("salt")

    return with_text(with_text(pairs, "b", "a"), "a", "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


_TILE = ["key", "x", "y"]


def _tile_columns() -> list[str]:
    return ["side", "node", "root", "band", *(f"f{k}" for k in range(WORDS)), *(f"k{k}" for k in range(BANDS))]


def _of_tile(columns: list):
    """(side, node, root, band, fps, keys) of tile_arrays() of _tile_columns()."""
    import numpy as np

    side, node, root, band, *rest = columns
    return side, node, root, int(band[0]), np.stack(rest[:WORDS], axis=1), np.stack(rest[WORDS:], axis=1)


def blocks(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, x, y, p, q, node, side, root, band, f0.., k0..): the rows (key, n, node, root, band, ones, f0.., k0..) of the blocks p and q of tiles in which pairs are left, and have one left themselves."""
    columns = _tile_columns()
    long = [f"{c} long" for c in ("node", "root", *(f"f{k}" for k in range(WORDS)), *(f"k{k}" for k in range(BANDS)))]
    tiled = tiles(rows, ["key"], "node", RADIUS + 1, tile)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for key, x, y, *columns_ in tile_arrays(batches, _TILE, [*_TILE, *columns]):
            side, node, root, band, fps, keys = _of_tile(columns_)
            order, left = open_pairs(fps, node, side, root, keys, band)
            some = np.flatnonzero(left.any(axis=1))
            for lo in range(0, len(some), BLOCK):
                for hi in range(lo, len(some), BLOCK):
                    here, there = some[lo : lo + BLOCK], some[hi : hi + BLOCK]
                    met = left[np.ix_(here, there)]
                    if met.any():
                        at = order[np.union1d(here[met.any(axis=1)], there[met.any(axis=0)])]
                        same = [pa.array(np.full(len(at), v)) for v in (key[0], int(x[0]), int(y[0]), lo // BLOCK, hi // BLOCK)]
                        yield pa.record_batch([*same, *(pa.array(c[at]) for c in columns_)], ["key", "x", "y", "p", "q", *columns])

    return tiled.mapInArrow(run, ", ".join(["key long, x long, y long, p long, q long, side int", *long[:2], "band int", *long[2:]]))


def settled_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Different links (a, b) that span what is left in the blocks() and has a similarity of SIMILAR or more; texts are (node, text)."""
    small_batches(texts.sparkSession)
    columns, job = _tile_columns(), [*_TILE, "p", "q"]

    def sets_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [shingles(t).tobytes() for t in text_bytes(b, "text")]
            yield pa.record_batch([b.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for *columns_, raw in tile_arrays(batches, job, [*columns, "hashes"]):
            side, node, root, band, fps, keys = _of_tile(columns_)
            order, left = open_pairs(fps, node, side, root, keys, band)
            got = linked([np.frombuffer(raw[i], dtype=np.uint64) for i in order.tolist()], left)
            if got:
                ends = [sorted((int(node[order[i]]), int(node[order[j]]))) for i, j in got]
                yield pa.record_batch([pa.array([e[k] for e in ends]) for k in (0, 1)], ["a", "b"])

    hashed = texts.join(members.select("node").distinct(), "node", "left_semi").mapInArrow(sets_of, "node long, hashes binary")
    dealt = members.join(hashed, "node").repartition(*job).sortWithinPartitions(*job)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """One row (id, text_key, text_key2, root, component_id) per row of docs (doc_id, text): components of the checked links, named by their smallest id.

    Null and wordless texts are equal to each other; very long texts are read
    whole; null ids name a component only if it has no other, so root (any
    number) tells components apart; rows that repeat an id or a text each get
    a row; an empty table gives an empty result; other columns are ignored.
    Texts are told apart by 128 bits.
    """
    rows = swept(signatures(docs))
    # nodes are numbered where they are stored, so that a lost task gives the same numbers again
    nodes = swept(rows.groupBy("text_key", "text_key2").agg(F.min("id").alias("least"), F.first(F.struct("keys", "fp")).alias("s")).select("text_key", "text_key2", "least", "s.*")).withColumn("node", F.monotonically_increasing_id())
    words = [F.col("fp")[k].alias(f"f{k}") for k in range(WORDS)]
    ones = sum((F.bit_count(F.col("fp")[k]) for k in range(1, WORDS)), F.bit_count(F.col("fp")[0]))
    # population counts in steps of the radius, so that full tiles are cut into few
    bands = [F.col("keys")[k].alias(f"k{k}") for k in range(BANDS)]
    keyed = nodes.select(F.posexplode("keys").alias("band", "key"), "node", (F.floor(ones / (RADIUS + 1)) * (RADIUS + 1)).cast("int").alias("ones"), *words)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = swept(keyed.join(sizes, "key"))
    pairs = swept(candidates(keyed, tile))
    # a forest spans all that have another within the radius: no later pair needs another text
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    named = nodes.join(used, "node").select("node", "text_key", "text_key2")
    texts = swept(docs.select(*identity(), "text").join(named, ["text_key", "text_key2"]).select("node", "text").dropDuplicates(["node"]))
    edges = swept(checked(pairs, texts))
    stars = components(edges)
    rooted = keyed.join(used, "node", "left_semi").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # tiles with several groups only
    several = rooted.groupBy("key").agg(F.min("root").alias("a_"), F.max("root").alias("b_"), F.count(F.lit(1)).alias("n")).where("a_ < b_").select("key", "n")
    again = swept(rooted.drop("n").join(several, "key").join(nodes.select("node", *bands), "node"))
    # from the stars on, so that there are no paths to shorten but those that the new links make
    roots = components(stars.toDF("a", "b").unionByName(settled_pairs(swept(blocks(again, tile)), texts)))
    rooted = nodes.join(roots, "node", "left").select("text_key", "text_key2", "least", F.coalesce("root", "node").alias("root"))
    named = swept(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # cut, so that a large component's join can be split
    classes = rooted.join(named, "root").select("text_key", "text_key2", "root", "component_id")
    return rows.select("id", "text_key", "text_key2").join(classes, ["text_key", "text_key2"])


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays, once; the columns are those of docs, whatever their names."""
    found = swept(near_duplicates(docs))  # it is read twice
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("text_key", "text_key2")).alias("k_"), F.first("id").alias("id_")).select("id_", F.col("k_.text_key").alias("a_"), F.col("k_.text_key2").alias("b_"))
    keyed = docs.withColumns(dict(zip(("a__", "b__"), identity(), strict=True)))
    out = keyed.join(stay, keyed["doc_id"].cast("long").eqNullSafe(stay["id_"]) & (keyed["a__"] == stay["a_"]) & (keyed["b__"] == stay["b_"]), "left_semi").drop("a__", "b__")
    twice = found.groupBy("id", "text_key", "text_key2").count().where("count > 1")
    return out if twice.isEmpty() else out.dropDuplicates(["doc_id", "text"])
