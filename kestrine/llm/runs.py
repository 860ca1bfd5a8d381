"""Periodic runs of words: stretches that repeat a period at least twice, found by Kruskal over suffixes.

Suffixes of a text's words are sorted; neighbours in that order are edges
whose weight is the length of their common prefix (LCP). Edges are taken by
decreasing LCP and unite classes of suffixes; a class keeps its positions in
order. When two classes meet at LCP l, positions i < j that become neighbours
share exactly l words. If j - i <= l, the words from i to j + l have period
j - i, can't be extended to the right, and j - i is their smallest period: a
smaller one would have put a position of i's class in between. So a run is
seeded once, by its first position; seeds that a word on the left extends are
dropped. A run of 12 words or more needs l >= 6, so lighter edges never
matter, and a text in which no six words repeat is done after three sorts.

Words are numbered, and sorted by doubling: the ranks of 2^k words come from
those of 2^(k-1). Memory is linear in a text, but for the ranks of each
doubling that its repeats need.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

#: Fewest words of a run.
LEAST = 12
#: Positions of a class are kept in lists of at most twice this many.
BLOCK = 512


class Positions:
    """Positions in order, in short lists."""

    def __init__(self, first: int):
        self.lists, self.lows, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Puts x in and returns the positions before and after it, -1 for none."""
        k = max(bisect_left(self.lows, x) - 1, 0)
        own = self.lists[k]
        at = bisect_left(own, x)
        before = own[at - 1] if at else -1
        after = own[at] if at < len(own) else self.lows[k + 1] if k + 1 < len(self.lows) else -1
        own.insert(at, x)
        self.lows[k] = own[0]
        self.size += 1
        if len(own) > 2 * BLOCK:
            self.lists[k : k + 1] = own[:BLOCK], own[BLOCK:]
            self.lows.insert(k + 1, own[BLOCK])
        return before, after

    def __iter__(self) -> Iterator[int]:
        for x in self.lists:
            yield from x


def sorted_suffixes(ids, least: int):
    """(order, lcp) of the suffixes of ids that share `least` words or more with a neighbour; None if there are none.

    lcp[k] is what order[k] and order[k + 1] share, where it is `least` or more, else 0.
    """
    import numpy as np

    n = len(ids)
    ranks, width = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1

    def joined(a, b, by: int):
        """Ranks of what a ranks, followed by what b ranks `by` words on; what ends before ranks first, by itself."""
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: max(n - by, 0)] = b[by:] + 1
        return np.unique(a * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64)

    while 2 * width <= least:
        ranks.append(joined(ranks[-1], ranks[-1], width))
        width *= 2
    grams, have = ranks[-1], width
    for k in reversed(range(len(ranks))):  # exactly `least` words
        while have + (1 << k) <= least:
            grams = joined(grams, ranks[k], have)
            have += 1 << k
    counts = np.bincount(grams, minlength=1)
    repeats = counts[grams] > 1
    repeats[max(n - least + 1, 0) :] = False
    if not repeats.any():
        return None
    while ranks[-1].max() < n - 1:
        ranks.append(joined(ranks[-1], ranks[-1], width))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    order = order[repeats[order]]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), dtype=np.int64)
    for k in reversed(range(len(ranks))):
        step = 1 << k
        inside = (a + step <= n) & (b + step <= n)
        alike = np.zeros(len(a), dtype=bool)
        alike[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        a, b, lcp = a + alike * step, b + alike * step, lcp + alike * step
        a, b = np.minimum(a, n), np.minimum(b, n)
    lcp[lcp < least] = 0
    return order, lcp


def runs_of(ids, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of `least` or more items of an integer array, by start, then period."""
    import numpy as np

    found = sorted_suffixes(ids, (least + 1) // 2) if len(ids) >= least else None
    if found is None:
        return []
    order, lcp = found
    heaviest = np.argsort(-lcp, kind="stable")
    heaviest = heaviest[lcp[heaviest] > 0].tolist()
    order, lcp, items = order.tolist(), lcp.tolist(), ids.tolist()
    up = list(range(len(order)))
    sets: list[Positions | None] = [None] * len(order)
    out = []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def seed(i: int, j: int, shared: int) -> None:
        if i >= 0 and j - i <= shared and j - i + shared >= least and (i == 0 or items[i - 1] != items[j - 1]):
            out.append((i, j - i + shared, j - i))

    for k in heaviest:
        a, b, shared = top(k), top(k + 1), lcp[k]
        for x in (a, b):
            if sets[x] is None:
                sets[x] = Positions(order[x])
        if sets[a].size < sets[b].size:
            a, b = b, a
        up[b], few, last = a, list(sets[b]), -1
        sets[b] = None
        for nth, x in enumerate(few):
            before, after = sets[a].add(x)
            if before != last:
                seed(before, x, shared)
            if after >= 0 and (nth + 1 == len(few) or after < few[nth + 1]):
                seed(x, after, shared)
            last = x
    out.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """words without those that a run holds after its first period, joined by one space."""
    import numpy as np

    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row (id, runs, collapsed) per row of docs (doc_id, text): runs (start, length, period) of words, and the text with one period of each.

    A run has `least` words or more and at least two periods. Null, empty and
    wordless texts have no runs and collapse to nothing; whole texts are read;
    null ids and repeated rows each give a row; an empty table gives an empty
    result; other columns are ignored. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            runs, short = [], []
            for text in text_bytes(b, "text"):
                words = re.findall(rb"[^\x20\x09-\x0D]+", text)
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
                got = runs_of(ids, least)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                short.append(collapsed(words, got))
            yield pa.record_batch([b.column("id"), pa.array(runs, kind), pa.array(short, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The contract's text: where the id's CRC-32 ends in 0, words from some place on repeat the first of them. Null ids change nothing."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def again(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(F.col(text))), 1)
    return F.when(h % 10 == 0, made).otherwise(F.col(text))
