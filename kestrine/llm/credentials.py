"""Secrets in texts: base patterns that tell enough alone, and weak candidates that need their complements.

A credential has up to three parts: an identifier, a secret and an endpoint.
Each text is scanned once for the base patterns and for weak candidates of
each role. Weak ones say little alone: a long mixed run may be anything, a
URL stands in every other text. So all parts of a text are joined with what
lies in their scope, the REACH characters on either side, and a candidate is
reported only if complementary parts are there: for a secret an identifier,
for an identifier a secret, for an endpoint both.

The join is one of intervals: scopes are cut into bins of REACH characters, a
part goes to the bins that it touches, a candidate looks into those and the
next ones. Spans of a kind don't overlap, so a bin holds a bounded list, and
it is gathered before the join: a candidate meets lists, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Parts co-occur if fewer characters than this lie between them.
REACH = 200
#: Kinds in the order in which spans at one place are listed. Fixed values of the contract: the first three, and their patterns and lengths.
KINDS = ("assign", "access", "hex", "key", "user", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Greedy runs of at least the length asked for are the runs of any length less the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak candidates. Who comes first keeps what overlaps.
ENDPOINT = re.compile(r"(?:https?|ftps?|sftp|ssh|s3|jdbc|postgres|postgresql|mysql|mongodb|redis|amqps?)://[A-Za-z0-9.-]+(?::[0-9]+)?")
USER = re.compile(r"""(?<![A-Za-z])(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.I | re.A)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
IDENTIFIER, SECRET, PLACE = 0, 1, 2
ROLE = (SECRET, IDENTIFIER, SECRET, SECRET, IDENTIFIER, PLACE)
#: Roles that must lie within reach of a weak candidate of each role.
NEEDS = {IDENTIFIER: (SECRET,), SECRET: (IDENTIFIER,), PLACE: (IDENTIFIER, SECRET)}

SPANS = "array<struct<start: int, kind: int, end: int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in code points, by start and kind."""
    got = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    got += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(got + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def weak_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak candidates that overlap neither `taken` nor each other."""
    mixed = lambda s: any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)
    found = [(m.start(), kind, m.end()) for kind, pattern in ((5, ENDPOINT), (4, USER), (3, KEY)) for m in pattern.finditer(text) if kind != 3 or mixed(m[0])]
    if not found:
        return []
    used, out = bytearray(len(text)), []
    for s, _, e in taken:
        used[s:e] = b"\1" * (e - s)
    for s, kind, e in found:
        if not any(used[s:e]):
            used[s:e] = b"\1" * (e - s)
            out.append((s, kind, e))
    return sorted(out)


def scanned(docs: DataFrame) -> DataFrame:
    """One row (id, base, weak) per row of docs: the spans of its text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        as_dicts = lambda spans: [{"start": s, "kind": k, "end": e} for s, k, e in spans]
        for b in batches:
            base, weak = [], []
            for text in b.column("text").to_pylist():
                base.append(base_spans(text or ""))
                weak.append(weak_spans(text or "", base[-1]))
            yield pa.record_batch([b.column("id"), *(pa.array(list(map(as_dicts, x)), span) for x in (base, weak))], ["id", "base", "weak"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, f"id long, base {SPANS}, weak {SPANS}")


def _bins(lo: Column, hi: Column, more: int = 0) -> Column:
    """Bins that [lo, hi) touches, and `more` on either side."""
    return F.explode(F.sequence(F.floor(lo / REACH) - more, F.floor((hi - 1) / REACH) + more))


def linked(rows: DataFrame) -> DataFrame:
    """(row, start, kind, end, links) of the weak candidates of rows (row, base, weak) whose complements lie within reach.

    links has the nearest part (start, kind, end) of each other role that is there.
    """
    role = F.array(*map(F.lit, ROLE))
    parts = rows.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")
    around = parts.withColumn("bin", _bins(F.col("start"), F.col("end"))).groupBy("row", "bin").agg(F.collect_list(F.struct("start", "kind", "end")).alias("there"))
    weak = parts.where(F.col("kind") >= 3).withColumn("bin", _bins(F.col("start"), F.col("end"), 1))
    gap = lambda p: F.greatest(F.lit(0), p["start"] - F.col("end"), F.col("start") - p["end"])

    def nearest(r: int) -> Column:
        of_role = F.filter("there", lambda p: (F.get(role, p["kind"]) == r) & (gap(p) < REACH))
        return F.array_min(F.transform(of_role, lambda p: F.struct(gap(p).alias("gap"), p.alias("p"))))

    met = weak.join(around, ["row", "bin"]).groupBy("row", "start", "kind", "end").agg(*[F.min(nearest(r)).alias(f"r{r}") for r in range(3)])
    own = F.get(role, F.col("kind"))
    enough = F.lit(False)
    for r, needs in NEEDS.items():
        there = F.lit(True)
        for n in needs:
            there = there & F.col(f"r{n}").isNotNull()
        enough = enough | ((own == r) & there)
    others = F.filter(F.array(*[F.when(own != r, F.col(f"r{r}.p")) for r in range(3)]), lambda p: p.isNotNull())
    return met.where(enough).select("row", "start", "kind", "end", others.alias("links"))


def secrets(docs: DataFrame) -> DataFrame:
    """One row (id, base, spans, links) per row of docs (doc_id, text): base spans, base and reported weak spans, and the links of the latter.

    Spans are (start, kind, end) in code points, kind an index of KINDS,
    ordered by start and kind; links are (start, kind, end, links). Null and
    empty texts have none; null ids, ids that repeat and repeated rows each
    give a row; an empty table gives an empty result; whole texts are read,
    whatever their length; other columns are ignored.
    """
    # rows are numbered where they are stored, so that a lost task gives the same numbers again
    rows = cut(scanned(docs)).withColumn("row", F.monotonically_increasing_id())
    told = linked(rows).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "links"))).alias("links"))
    more = F.coalesce(F.transform("links", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.array().cast(SPANS))
    return rows.join(told, "row", "left").select("id", "base", F.array_sort(F.concat("base", more)).alias("spans"), F.coalesce("links", F.array()).alias("links"))


def listed(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
