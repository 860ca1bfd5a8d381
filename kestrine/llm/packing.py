"""Best-fit-decreasing packing of tokenised documents into sequences.

Documents are tokenised in Arrow batches and cut into pieces of at most the
capacity. Pieces are dealt evenly to groups, sorted there by Spark from the
longest on, and each group is packed as it streams by: a segment tree over
remaining capacities finds the tightest open sequence in logarithmic time. A
group loses about one sequence against packing everything at once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CAPACITY = 2048
#: Documents of a group, on average.
GROUP_ROWS = 25_000


#: From this many white-space characters in a row on, the pattern's look-ahead is taken out of the regular expression, which fails on about a million.
LONG_SPACE = 10_000
#: Unicode White_Space, which the pattern's \s stands for. Python's \s has four more.
SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG = re.compile(f"{SPACE}{{{LONG_SPACE},}}")


def encoder(ranks_path: str | None = None):
    """Byte-level BPE from a file of ranks.

    The default has the vocabulary of byte_bpe_50k.json as ranks and its added tokens, and gives the same ids.
    A file of one's own has no added tokens.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {}
    if not ranks_path:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in added.values()}, special_tokens=added)


def encode(enc, text: str) -> list[int]:
    """Ids of a text: added tokens are found first, as tokenizers does, and the rest is ordinary text.

    A long run of white space is one piece of the pattern up to its last
    character, which goes with what follows, or to its end if nothing does;
    what is before it ends in another character, so no piece reaches into it.
    """
    if not LONG.search(text):
        return enc.encode(text, allowed_special="all")
    added = sorted(enc.special_tokens_set, key=len, reverse=True)
    ids: list[int] = []
    for part in re.split(f"({'|'.join(map(re.escape, added))})", text) if added else [text]:
        if part in enc.special_tokens_set:
            ids.append(enc.encode_single_token(part))
            continue
        at = 0
        for run in LONG.finditer(part):
            end = run.end() - (run.end() < len(part))
            ids += enc.encode_ordinary(part[at : run.start()]) + enc._encode_single_piece(part[run.start() : end])
            at = end
        ids += enc.encode_ordinary(part[at:])
    return ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only what is longer is cut, and the first piece takes the rest."""
    first = n if n <= capacity else n % capacity
    return ([(0, first)] if first else []) + [(i, capacity) for i in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit, end_id closes a document.

    Null and empty texts have one id, end_id. Every row of docs is cut by
    itself, so repeated rows and ids give repeated pieces; very long texts
    are encoded whole and give many; an empty table gives none; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc = encoder(ranks_path)
        for b in batches:
            got = ([], [], [], [], [])
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(enc, text or ""), end_id], dtype="<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    for to, x in zip(got, (doc, k, start, n, ids[start : start + n].tobytes()), strict=True):
                        to.append(x)
            yield pa.record_batch([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.int64()), pa.array(got[3], pa.int64()), pa.array(got[4], pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class OpenSequences:
    """Segment tree over remaining capacities; a leaf holds the open sequences with so much left."""

    def __init__(self, capacity: int):
        self.capacity, self.size, self.n = capacity, 1 << capacity.bit_length(), 0
        self.some = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def _mark(self, leaf: int, on: int) -> None:
        i = leaf + self.size
        while i and self.some[i] != on:
            self.some[i] = on
            if not on and self.some[i ^ 1]:
                return
            i >>= 1

    def tightest(self, need: int) -> int:
        """Least remaining capacity of at least need among open sequences, or -1."""
        i = need + self.size
        if self.some[i]:
            return need
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.some[2 * i])
                return i - self.size
            i >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece."""
        left = self.tightest(length)
        if left < 0:
            left, seq = self.capacity, self.n
            self.n += 1
        else:
            stack = self.open[left]
            seq = stack.pop()
            if not stack:
                self._mark(left, 0)
        rest = left - length
        if rest:
            self.open.setdefault(rest, []).append(seq)
            self._mark(rest, 1)
        return seq, self.capacity - left


def pack(rows: DataFrame, n_docs: int, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """rows (with length long, 1 to capacity) and where each goes: sequence_id long, offset long.

    All columns of rows are kept, but for those named sequence_id or offset,
    which are replaced. n_docs sets the number of groups. Offsets of a
    sequence are gapless from 0; no rows make no sequences.
    """
    rows = rows.drop("sequence_id", "offset")
    schema = rows.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, OpenSequences(capacity)
        for b in batches:
            at = [bins.place(n) for n in b.column("length").to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([base + s for s, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], [*b.schema.names, "sequence_id", "offset"])

    groups = max(1, -(-n_docs // group_rows))
    dealt = rows.repartition(groups).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return dealt.mapInArrow(run, f"{out}, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """pieces() of docs and where they go: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack(pieces(docs, capacity=capacity, ranks_path=ranks_path), docs.count(), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order, and the pieces they come from. A sequence holds at most capacity ids."""
    part = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return placed.groupBy("sequence_id").agg(part.alias("parts")).select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"), F.expr("transform(parts, p -> struct(p.offset, p.doc_id, p.piece, p.length))").alias("parts"))
