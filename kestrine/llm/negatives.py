"""Hard negatives by exact search in a GNAT-style tree.

A node has a few split points; a row goes to the nearest one's subtree, so
subtrees are parted by hyperplanes. Each split point keeps the range of its
distances to every sibling's subtree. A query whose score must lie in a window
looks for rows in an annulus: scores are inner products, so with the norms of
a subtree a window of scores is one of distances. A sibling is left out if its
range misses what the triangle inequality leaves of the annulus around any
split point of the node. What is left at the leaves is compared exactly.

Split points are fitted on at most SAMPLE rows, chosen by a hash of their ids;
every row is routed, and ranges are counted over all rows. A leaf is cut by a
hash into blocks of some BLOCK rows, and a block meets the queries that reach
its leaf in packs, so a hot leaf is many blocks in many tasks; what is
broadcast has a row per leaf, of which there are fewer than SAMPLE. Of rows with
equal vectors and labels only those with the smallest ids can be found, as
many as a query takes and its own one; the others aren't compared.

A query is answered in two turns: its home leaf gives the score that its last
answer has at least, which narrows the window with which the tree is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Rows on which split points are fitted, at most.
SAMPLE = 4096
#: Split points of a node, and sample rows of a leaf that isn't split again.
FAN, LEAF = 8, 64
#: Rows of a block and queries of a pack, on average.
BLOCK, PACK = 1024, 256
POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Distances are rounded; by so much ranges are widened.
SLACK = 1e-6
#: Types of stored vectors.
TYPES = ("<i2", "<i4", "<f8")
#: Windows of scores of one query, numbered, so that they share its vector.
WINDOWS = "array<struct<slot: int, low: double, high: double>>"


def vectors(table: DataFrame) -> DataFrame:
    """Different rows (id, label, v: doubles without fraction) of table (vec_id, label, embedding) that take part.

    Null ids, labels and vectors, and vectors with a component that is null or
    not finite, take none. Where the id is divisible by 7 the label is the next of ten.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    told = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    whole = F.transform(x, lambda c: F.floor(c * 256).cast("double"))
    return told.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), whole.alias("v")).distinct()


def split_points(sample) -> list[tuple]:
    """Nodes (points, children) over sample rows; a child is the number of a node, or -1 - the number of a leaf. Node 0 is the root; none if all is one leaf."""
    import numpy as np

    nodes, leaves = [], 0

    def build(x) -> int:
        nonlocal leaves
        far = ((x - x[0]) ** 2).sum(axis=1) if len(x) else np.zeros(0)
        picked = []
        while len(x) > LEAF and len(picked) < FAN and far.max() > 0:
            picked.append(int(far.argmax()))
            d = ((x - x[picked[-1]]) ** 2).sum(axis=1)
            far = d if len(picked) == 1 else np.minimum(far, d)
        if len(picked) < 2:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        own = nearest(x, x[picked])[0]
        nodes[at] = (x[picked], [build(x[own == k]) for k in range(len(picked))])
        return at

    build(np.asarray(sample, dtype=np.float64))
    return nodes


def nearest(x, points):
    """(number of the nearest point, distances to all) of each row of x."""
    import numpy as np

    far = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * x @ points.T, 0))
    return far.argmin(axis=1), far


def routed(nodes: list[tuple], x):
    """(leaf of each row of x, steps): steps are (node, rows, their child, distances to its points)."""
    import numpy as np

    leaf, steps, todo = np.zeros(len(x), dtype=np.int64), [], [(0, np.arange(len(x)))]
    while todo and nodes:
        at, rows = todo.pop()
        points, children = nodes[at]
        own, far = nearest(x[rows], points)
        steps.append((at, rows, own, far))
        for k, child in enumerate(children):
            if (mine := rows[own == k]).size:
                if child < 0:
                    leaf[mine] = -1 - child
                else:
                    todo.append((child, mine))
    return leaf, steps


def matrix(column, width: int):
    """A binary column of numbers as rows of `width`; the first byte of each names their type, and shorter vectors end in zeros."""
    import numpy as np

    out = np.zeros((len(column), width))
    for i, b in enumerate(column.to_pylist()):
        v = np.frombuffer(b, dtype=TYPES[b[0]], offset=1)
        out[i, : len(v)] = v
    return out


def stored(v) -> bytes:
    """A vector as bytes, in the narrowest type that holds it."""
    import numpy as np

    most = max(map(abs, v), default=0)
    kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([kind]) + np.asarray(v, dtype=TYPES[kind]).tobytes()


def placed(rows: DataFrame, nodes: list[tuple], width: int) -> DataFrame:
    """rows with vec (binary) for v, and leaf."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            vec = pa.array([stored(v) for v in b.column("v").to_pylist()], pa.binary())
            yield pa.record_batch([b.column("id"), b.column("label"), vec, pa.array(routed(nodes, matrix(vec, width))[0])], ["id", "label", "vec", "leaf"])

    return rows.mapInArrow(run, "id long, label long, vec binary, leaf long")


def ranges(rows: DataFrame, nodes: list[tuple], width: int) -> dict:
    """(node, point, child) -> least and largest distance, and (node, -1, child) -> norms, of all rows below. Their number is bounded by the sample's."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x, out = matrix(b.column("vec"), width), []
            norms = (x**2).sum(axis=1)
            for at, mine, own, far in routed(nodes, x)[1]:
                for k in set(own.tolist()):
                    here = own == k
                    out += [(at, i, k, float(far[here, i].min()), float(far[here, i].max())) for i in range(far.shape[1])]
                    out.append((at, -1, k, float(norms[mine[here]].min()), float(norms[mine[here]].max())))
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())] * 2, ["node", "point", "child", "low", "high"])

    got = rows.select("vec").mapInArrow(run, "node long, point long, child long, low double, high double").groupBy("node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return {(r.node, r.point, r.child): (r.low, r.high) for r in got}


def reached(nodes: list[tuple], known: dict, x, low, high) -> list[list[int]]:
    """Leaves of each query x (a row) that may hold a score between low and high."""
    import numpy as np

    out: list[list[int]] = [[] for _ in range(len(x))]
    norms, todo = (x**2).sum(axis=1), [(0, np.arange(len(x)))]
    if not nodes:
        return [[0] for _ in out]
    while todo:
        at, rows = todo.pop()
        points, children = nodes[at]
        far = nearest(x[rows], points)[1]
        for k, child in enumerate(children):
            if (at, -1, k) not in known:
                continue  # no row went there
            least, most = known[at, -1, k]
            near = np.sqrt(np.maximum(norms[rows] + least - 2 * high[rows], 0))
            wide = np.sqrt(np.maximum(norms[rows] + most - 2 * low[rows], -1).clip(0))
            ok = norms[rows] + most - 2 * low[rows] >= -SLACK * (1 + norms[rows] + most)
            for i in range(len(points)):
                lo, hi = known[at, i, k]
                slack = SLACK * (1 + hi + far[:, i] + np.sqrt(norms[rows]))
                ok &= (hi + slack >= np.maximum(near - far[:, i], far[:, i] - wide)) & (lo - slack <= far[:, i] + wide)
            if (mine := rows[ok]).size:
                if child < 0:
                    for q in mine.tolist():
                        out[q].append(-1 - child)
                else:
                    todo.append((child, mine))
    return out


def firsts(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank from 1; tasks drop what can't be among them before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


class Tree:
    """The routed rows of a table of vectors, and exact search in them."""

    def __init__(self, rows: DataFrame):
        self.width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
        sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").collect()
        self.nodes = split_points([list(r.v) + [0.0] * (self.width - len(r.v)) for r in sample]) if sample else []
        self.rows = cut(placed(rows, self.nodes, self.width))
        self.known = ranges(self.rows, self.nodes, self.width)

    def queries(self, rows: DataFrame) -> DataFrame:
        """rows (id, label, vec, leaf) of this tree as queries with one window that lets all scores in."""
        return rows.select(F.col("id").alias("q"), F.col("label").alias("q_label"), F.col("vec").alias("q_vec"), F.col("leaf").alias("home"), F.lit(0).alias("slot"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))

    def blocks(self, most: int) -> DataFrame:
        """(leaf, block, ids, labels, vecs) of the rows that a query taking `most` answers, and itself, can be given."""
        few = firsts(self.rows, ["vec", "label"], [F.col("id")], most + 1, "nth").drop("nth")
        sizes = few.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
        dealt = few.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("id", "label"), F.col("n_blocks")))
        return cut(dealt.groupBy("leaf", "n_blocks", "block").agg(F.collect_list(F.struct("id", "label", "vec")).alias("rows")))

    def visits(self, queries: DataFrame) -> DataFrame:
        """(q, q_label, q_vec, windows, leaf): queries with windows, one row for each leaf with the windows that reach it."""
        nodes, known, width = self.nodes, self.known, self.width

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                of, low, high, windows = unpacked(b.column("windows"))
                by_leaf: dict[tuple[int, int], list] = {}
                for k, leaves in enumerate(reached(nodes, known, matrix(b.column("q_vec"), width)[of], low, high)):
                    for leaf in leaves:
                        by_leaf.setdefault((int(of[k]), leaf), []).append(windows[k])
                rows = pa.array(np.array([q for q, _ in by_leaf], dtype=np.int64))
                told = pa.array(list(by_leaf.values()), b.schema.field("windows").type)
                yield pa.record_batch([*(b.column(c).take(rows) for c in ("q", "q_label", "q_vec")), told, pa.array([leaf for _, leaf in by_leaf], pa.int64())], ["q", "q_label", "q_vec", "windows", "leaf"])

        return queries.mapInArrow(run, f"q long, q_label long, q_vec binary, windows {WINDOWS}, leaf long")

    def compared(self, visits: DataFrame, blocks: DataFrame, n_queries: int, alike: bool, most: int) -> DataFrame:
        """(q, q_label, slot, id, score): of each window of a visit and block the first `most` answers, of the query's label or of others."""
        width = self.width
        leaves = F.broadcast(blocks.select("leaf", "n_blocks").distinct())
        dealt = visits.join(leaves, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).withColumn("pack", F.pmod(F.xxhash64("q", "q_label", "q_vec"), F.lit(-(-max(n_queries, 1) // PACK))))
        packs = dealt.groupBy("leaf", "block", "pack").agg(F.collect_list(F.struct("q", "q_label", "q_vec", "windows")).alias("asked"))
        small_batches(blocks.sparkSession)

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for k in range(b.num_rows):
                    rows, asked = b.column("rows")[k].values.flatten(), b.column("asked")[k].values
                    ids, labels, x = rows[0].to_numpy(), rows[1].to_numpy(), matrix(rows[2], width)
                    q = dict(zip((f.name for f in asked.type), asked.flatten(), strict=True))
                    scores = matrix(q["q_vec"], width) @ x.T
                    own = labels[None, :] == q["q_label"].to_numpy()[:, None]
                    able = (own if alike else ~own) & (ids[None, :] != q["q"].to_numpy()[:, None])
                    of, low, high, windows = unpacked(q["windows"])
                    at, to, slots = [], [], []
                    for j, i in enumerate(of.tolist()):
                        ok = np.flatnonzero(able[i] & (scores[i] >= low[j]) & (scores[i] <= high[j]))
                        if len(ok) > 4 * most:  # what is below the last of the first ones is never sorted
                            ok = ok[scores[i, ok] >= np.partition(scores[i, ok], -most)[-most]]
                        best = ok[np.lexsort((ids[ok], -scores[i, ok]))[:most]].tolist()
                        at += [i] * len(best)
                        to += best
                        slots += [windows[j]["slot"]] * len(best)
                    if at:
                        pick = pa.array(at)
                        yield pa.record_batch([*(q[c].take(pick) for c in ("q", "q_label", "q_vec")), pa.array(slots, pa.int32()), pa.array(ids[to]), pa.array(scores[at, to].astype(np.int64))], ["q", "q_label", "q_vec", "slot", "id", "score"])

        met = packs.join(blocks.select("leaf", "block", "rows"), ["leaf", "block"]).select("rows", "asked")
        return met.mapInArrow(run, "q long, q_label long, q_vec binary, slot int, id long, score long")

    def search(self, queries: DataFrame, blocks: DataFrame, n_queries: int, alike: bool, most: int) -> DataFrame:
        """(q, q_label, q_vec, slot, id, score, rank): the first `most` rows with a score in each query's window, by score, then id."""
        by = ["q", "q_label", "q_vec", "slot"]
        order = [F.col("score").desc(), F.col("id")]
        grouped = lambda rows: rows.groupBy("q", "q_label", "q_vec", "home").agg(F.collect_list(F.struct("slot", "low", "high")).alias("windows"))
        home = self.compared(grouped(queries).withColumn("leaf", F.col("home")), blocks, n_queries, alike, most)
        last = firsts(home, by, order, most).where(F.col("rank") == most).select(*by, F.col("score").cast("double").alias("least"))
        narrowed = queries.join(last, by, "left").withColumn("low", F.greatest("low", F.coalesce("least", "low"))).select(*queries.columns)
        return firsts(self.compared(self.visits(grouped(narrowed)), blocks, n_queries, alike, most), by, order, most)


def unpacked(column) -> tuple:
    """Of a column of windows: the row of each window, its bounds, and the windows."""
    import numpy as np

    flat, offsets = column.flatten(), column.offsets.to_numpy()
    _, low, high = flat.flatten()
    return np.repeat(np.arange(len(column)), np.diff(offsets)), low.to_numpy(zero_copy_only=False), high.to_numpy(zero_copy_only=False), flat.to_pylist()


def hard_negatives(table: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of table (vec_id, label, embedding).

    Anchors are rows whose id is divisible by `every`; positives the first of
    their label, negatives the first of other labels whose score lies between
    LOW and HIGH hundredths of the positive's. Scores are inner products of
    vectors() and exact below 2^53; higher ones come first, ties by smaller id.
    Rows that repeat an id, label and vector count once; other rows with an
    anchor's id aren't its positives; shorter vectors end in zeros. Without
    positives or negatives an anchor has no rows; an empty table gives an empty
    result; other columns are ignored.
    """
    tree = Tree(vectors(table))
    anchors = tree.rows.where(F.col("id") % every == 0)
    n = anchors.count()
    blocks = tree.blocks(max(positives, negatives))
    asked = tree.queries(anchors)
    found = cut(tree.search(asked, blocks, n, True, positives))
    # a window in hundredths: 100 scores of it are whole numbers
    windows = found.where("score >= 0").join(asked.select("q", "q_label", "q_vec", "home"), ["q", "q_label", "q_vec"])
    asked = windows.select("q", "q_label", "q_vec", "home", F.col("rank").alias("slot"), F.ceil(F.col("score") * LOW / F.lit(100)).cast("double").alias("low"), F.floor(F.col("score") * HIGH / F.lit(100)).cast("double").alias("high"))
    got = tree.search(asked, blocks, n, False, negatives)
    told = found.select("q", "q_label", "q_vec", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return told.join(got, ["q", "q_label", "q_vec", "slot"]).select(F.col("q").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
