"""Exact duplicates found by Patricia tries over whole texts.

Texts are partitioned by length and content hash, so equal texts meet in one
task, and are inserted as full byte strings into a compressed radix trie
whose terminal nodes hold the owner of a text and its number of copies.
Before the shuffle each task combines its own copies in such a trie, so a
group of copies costs a row for each task however large it is. A trie over
its byte budget spills subtrees: before the shuffle it emits the heaviest as
partial owners; after it, where texts arrive sorted, it emits the subtrees
that later texts can no longer enter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

#: Bytes of labels that a trie holds before it spills subtrees.
BUDGET = 64 << 20
#: Bytes that a node costs besides its label.
NODE = 200


class Node:
    __slots__ = ("children", "copies", "label", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.copies = label, {}, None, 0


class Trie:
    """Compressed radix trie from byte strings to (owner, copies)."""

    def __init__(self, largest: bool = True):
        self.root, self.bytes, self.largest = Node(b""), 0, largest

    def insert(self, key: bytes, owner: int | None, copies: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(child.label) + NODE
                at = len(key)
            elif key.startswith(child.label, at):
                at += len(child.label)
            else:
                child = self._split(node, child, key, at)
                at += len(child.label)
            node = child
        if owner is not None and (node.owner is None or (owner > node.owner) == self.largest):
            node.owner = owner
        node.copies += copies

    def _split(self, parent: Node, child: Node, key: bytes, at: int) -> Node:
        """Puts a node where key leaves the label of child."""
        label, lo, hi = child.label, 1, min(len(child.label), len(key) - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if key.startswith(label[:mid], at) else (lo, mid - 1)
        top = Node(label[:lo])
        child.label = label[lo:]
        top.children[child.label[0]] = child
        parent.children[label[0]] = top
        self.bytes += NODE
        return top

    def _drain(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            if node.copies:
                yield prefix, node.owner, node.copies
                node.copies = 0
            self.bytes -= (len(node.label) + NODE) if node is not self.root else 0
            todo += [(c, prefix + c.label) for c in node.children.values()]
            node.children = {}

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Emits and forgets everything."""
        yield from self._drain(self.root, b"")
        self.bytes = 0

    def spill_heaviest(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Emits the subtrees below the root, heaviest first, until half the bytes are gone."""
        def weight(node: Node) -> int:
            total, todo = 0, [node]
            while todo:
                x = todo.pop()
                total += len(x.label) + NODE
                todo += x.children.values()
            return total

        goal = self.bytes // 2
        for first in sorted(self.root.children, key=lambda k: -weight(self.root.children[k])):
            if self.bytes <= goal:
                break
            child = self.root.children.pop(first)
            yield from self._drain(child, child.label)

    def spill_passed(self, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Emits the subtrees beside the path to key; inserts in byte order don't come back to them."""
        node, at = self.root, 0
        while at < len(key) and (child := node.children.get(key[at])) is not None:
            for k in [k for k in node.children if k != key[at]]:
                gone = node.children.pop(k)
                yield from self._drain(gone, key[:at] + gone.label)
            if not key.startswith(child.label, at):
                break
            node, at = child, at + len(child.label)


def normal(text: bytes) -> bytes:
    """Lower-cases A-Z, and nothing else."""
    return text.lower()


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, budget: int = BUDGET) -> DataFrame:
    """One row per different text: text_sha256, bytes long, keep_id long, group_size long."""
    small_batches(docs.sparkSession)

    def rows(found: list) -> object:
        import pyarrow as pa

        keys = [k for k, _, _ in found]
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array([o for _, o, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.int64())], ["norm", "owner", "copies"])

    def batched(found: Iterator) -> Iterator:
        held, size = [], 0
        for x in found:
            held.append(x)
            size += len(x[0])
            if size > 16 << 20 or len(held) >= 10_000:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def combine(batches: Iterator) -> Iterator:
        def found():
            trie = Trie(largest)
            for b in batches:
                for i, t in zip(b.column("id").to_pylist(), text_bytes(b, "text"), strict=True):
                    trie.insert(normal(t), i)
                    if trie.bytes > budget:
                        yield from trie.spill_heaviest()
            yield from trie.drain()

        yield from batched(found())

    def settle(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def found():
            trie = Trie(largest)
            for b in batches:
                for t, o, c in zip(b.column("norm").to_pylist(), b.column("owner").to_pylist(), b.column("copies").to_pylist(), strict=True):
                    trie.insert(t, o, c)
                    if trie.bytes > budget:
                        yield from trie.spill_passed(t)
            yield from trie.drain()

        for b in batched(found()):
            keys = b.column("norm").to_pylist()
            yield pa.record_batch([pa.array([hashlib.sha256(k).hexdigest() for k in keys]), pa.array([len(k) for k in keys], pa.int64()), b.column("owner"), b.column("copies")], ["text_sha256", "bytes", "keep_id", "group_size"])

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(combine, "norm binary, owner long, copies long")
    dealt = some.withColumns({"len_": F.octet_length("norm"), "hash_": F.xxhash64("norm")}).repartition("len_", "hash_").sortWithinPartitions("norm").select("norm", "owner", "copies")
    return dealt.mapInArrow(settle, "text_sha256 string, bytes long, keep_id long, group_size long")


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, text_sha256) per row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column("id"), pa.array([hashlib.sha256(normal(t)).hexdigest() for t in text_bytes(b, "text")], pa.string())], ["id", "text_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, text_sha256 string")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, budget: int = BUDGET) -> DataFrame:
    """One row (id, text_sha256, keep_id, group_size, kept) per row of docs, dropped rows too.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the largest (or smallest) id stays;
    null ids stay only where no other id has the text; of rows that repeat
    both id and text exactly one is kept. An empty table gives an empty
    result; other columns of docs are ignored.
    """
    found = owners(docs, id_col, text_col, largest, budget).select("text_sha256", "keep_id", "group_size")
    # rows that repeat id and text can't be told apart: they are counted and told out again, one of them kept
    rows = addressed(docs, id_col, text_col).groupBy("text_sha256", "id").agg(F.count(F.lit(1)).alias("rows_"))
    each = rows.join(found, "text_sha256").withColumn("nth_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows_"))))
    return each.select("id", "text_sha256", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth_") == 1)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row for each different text (A-Z lower-cased): that with the largest doc_id; the columns are those of docs.

    Of rows that repeat both doc_id and text one stays.
    """
    found = owners(docs).select("text_sha256", "keep_id")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = docs.withColumn("sha__", F.sha2(F.coalesce(lower, F.lit("")).cast("binary"), 256))
    out = keyed.join(found, (keyed["sha__"] == found["text_sha256"]) & keyed["doc_id"].cast("long").eqNullSafe(found["keep_id"]), "left_semi")
    twice = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1")
    return (out if twice.isEmpty() else out.dropDuplicates(["doc_id", "sha__"])).drop("sha__")
