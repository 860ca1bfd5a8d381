"""Document quality by co-training of two naive Bayes classifiers.

One sees the text's content: hashed words and hashed runs of three bytes, and
shares of character classes, words and lines in bins. The other sees the page
metadata: language, source and recorded length. Both start from the labels. In
each round each scores all documents, and its best and worst of those without
labels, by quantiles of its own scores, become examples of the other. At the
end each view's score is calibrated on the labels, every labelled document
scored without its own counts (leave one out), and the calibrated log-odds are
added. Every count is summed by Spark over all documents; the models have a
fixed size. Languages and sources are hashed into META_BUCKETS buckets, so with
many more sources than that, several share their weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_bytes

ROUNDS = 3
#: Share of each class, among documents without labels, that a view gives pseudo-labels to in a round.
CONFIDENT = 0.1
#: Steps of a score in which its quantiles are counted.
FINE = 0.05
#: Weight of a pseudo-label against a label.
PSEUDO_WEIGHT = 0.2
BINS = 16
META_BUCKETS = 1024
N_TEXT, N_META = 16, 3
#: Buckets of hashed words, and as many of hashed runs of three bytes.
GRAMS = 2048
#: A text's buckets count as so many bins together, fewer if it has not many buckets more than FEW.
GRAM_WEIGHT, FEW = 16, 20
#: Rows whose buckets are unpacked at once.
STRIP = 128
#: Steps of a score in which labels are counted for its calibration, and how many each way.
CALIBRATION_STEP, STEPS = 0.25, 400
KEEP_FROM = 0.4


def grams(text: bytes, words: list[bytes]) -> bytes:
    """Bits of the buckets of a text's words and of its runs of three bytes."""
    import numpy as np

    on = np.zeros(2 * GRAMS, dtype=bool)
    on[[zlib.crc32(w) % GRAMS for w in words]] = True
    x = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(x) > 2:
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        on[GRAMS + ((h ^ (h >> np.uint32(15))) % GRAMS)] = True
    return np.packbits(on).tobytes()


def content(text: bytes) -> tuple[list[int], bytes]:
    """Bins and buckets of the content view."""
    import numpy as np

    n = len(text)
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if n else np.zeros(256, dtype=np.int64)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    total = max(1, n)

    def share(part: float, whole: float) -> int:
        return min(BINS - 1, int(np.log2(1 + 4095 * min(1.0, part / max(1.0, whole))) * (BINS - 1) / 12))

    def size(x: float) -> int:
        return min(BINS - 1, int(np.log2(1 + x)))

    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = [w[-2:] for w in words if len(w) > 2 and w[-1] < 65 and w[-2] < 65]  # words that close with two marks
    hashes, marks = sum(int(hist[c]) for c in b"#$%&*@^~=+_\\"), sum(int(hist[c]) for c in b"!?")
    bins = [
        share(upper, upper + lower), share(hashes, total), share(marks, total), share(int(hist[124]), total), share(sum(int(hist[c]) for c in b"<>{}[]()/"), total),
        share(sum(int(hist[c]) for c in b".,;:"), total), share(int(hist[128:].sum()), total), size(len(words)), size(4 * n / nw), share(len(set(words)), nw), share(len(set(lines)), nl), size(n / nl), share(hist[10], nw), share(int(hist.max()), total), share(again, nw), share(sum(not w.isalnum() for w in ends), nw),
    ]
    return bins, grams(text, words)


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Buckets of the metadata view; null is a value of its own."""
    length = 0 if n_chars is None else 1 + min(30, max(0, int(n_chars)).bit_length())
    return [zlib.crc32(f"l{lang}".encode()) % META_BUCKETS, zlib.crc32(f"s{source}".encode()) % META_BUCKETS, length]


class View:
    """Naive Bayes over features with a fixed number of values, perhaps over buckets that are on or off too, and the calibration of its score.

    counts is (2, features, values) and on (2, buckets), of which n (2) would
    be all; both hold a half more than was counted.
    """

    def __init__(self, counts, on=None, n=None):
        import numpy as np

        self.counts, self.on, self.n = counts, on, n
        self.total = counts[:, 0, :].sum(axis=1)
        self.weights = np.log(counts[1] / self.total[1]) - np.log(counts[0] / self.total[0])
        self.prior = float(np.log(self.total[1] / self.total[0]))
        self.slope, self.level = 1.0, 0.0
        if on is not None:
            self.gram_weights = self._centred(np.log(on[1] / n[1]) - np.log(on[0] / n[0]))

    def _centred(self, weights):
        return weights - (weights * self.on.sum(axis=0)).sum(axis=-1, keepdims=True) / self.on.sum()

    def raw(self, x, bits=None):
        """Log-odds before calibration; bits are the rows' packed buckets."""
        import numpy as np

        out = self.prior + self.weights[np.arange(x.shape[1])[None, :], x].sum(axis=1)
        return out if bits is None else out + self._gram_term(bits, lambda on, lo: on @ self.gram_weights)

    def without(self, x, y, bits=None):
        """raw() of labelled documents of classes y, each by the counts of all others."""
        import numpy as np

        own = np.stack([y == 0, y == 1]).astype(float)
        at = np.arange(x.shape[1])[None, :]
        side = lambda k: np.log(np.maximum(self.counts[k][at, x] - own[k][:, None], 0.5)).sum(axis=1) - (x.shape[1] - 1) * np.log(self.total[k] - own[k])
        out = side(1) - side(0)
        if bits is None:
            return out

        def strip(on, lo):
            mine = own[:, lo : lo + len(on)]
            odds = [np.log(np.maximum(self.on[k][None, :] - on * mine[k][:, None], 0.5)) - np.log(self.n[k] - mine[k])[:, None] for k in (0, 1)]
            return (on * self._centred(odds[1] - odds[0])).sum(axis=1)

        return out + self._gram_term(bits, strip)

    @staticmethod
    def _gram_term(bits, total):
        import numpy as np

        out = np.zeros(len(bits))
        for lo in range(0, len(bits), STRIP):
            on = np.unpackbits(bits[lo : lo + STRIP], axis=1).astype(np.float32)
            out[lo : lo + STRIP] = GRAM_WEIGHT * total(on, lo) / (on.sum(axis=1) + FEW)
        return out

    def calibrated(self, raw):
        """Log-odds of good by the labels: a line in the score."""
        return self.slope * raw + self.level


def step(raw):
    import numpy as np

    return np.clip(np.floor(raw / FINE), -(1 << 20), 1 << 20).astype(int)


@dataclass
class Model:
    text: View
    meta: View
    prior: float

    def scores(self, t, g, m):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.text.calibrated(self.text.raw(t, g)) + self.meta.calibrated(self.meta.raw(m)) - self.prior, -30, 30)))


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row (id, t, g, m) per row of docs: bins and buckets of the text, buckets of the metadata."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [content(x) for x in text_bytes(b, "text")]
            meta = [metadata(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
            yield pa.record_batch([b.column("id"), pa.array([x for x, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.binary()), pa.array(meta, pa.list_(pa.int32()))], ["id", "t", "g", "m"])

    return docs.select(F.col(id_col).cast("long").alias("id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, "id long, t array<int>, g binary, m array<int>")


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _views(b) -> tuple:
    """(bins, buckets) of the text view and (buckets, None) of the metadata view, and y, nan where there is no label."""
    import numpy as np

    g = np.frombuffer(b"".join(b.column("g").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
    return (_matrix(b.column("t")), g), (_matrix(b.column("m")), None), b.column("y").to_numpy(zero_copy_only=False).astype(float)


def _rows(view: tuple, which) -> tuple:
    return view[0][which], None if view[1] is None else view[1][which]


def _sums(table: DataFrame, count, keys: str) -> dict:
    """Sums by key over all rows: each task adds up its own, Spark adds the tasks' sums. The keys are of a fixed number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        for b in batches:
            if b.num_rows:
                for k, v in count(b):
                    held[k] = held.get(k, 0.0) + v
        names = keys.split()
        yield pa.record_batch([*(pa.array([k[i] for k in held], pa.int32()) for i in range(len(names))), pa.array(list(held.values()), pa.float64())], [*names, "n"])

    schema = ", ".join(f"{k} int" for k in keys.split()) + ", n double"
    return {tuple(r)[:-1]: r["n"] for r in table.mapInArrow(run, schema).groupBy(*keys.split()).agg(F.sum("n").alias("n")).collect()}


@dataclass
class Sure:
    """The last step of a view's worst and the first of its best documents, and the weights of their pseudo-labels."""

    bad: int
    good: int
    bad_weight: float
    good_weight: float


def _quantile(counts: list[tuple[int, float]], quota: float) -> tuple[int, float]:
    """First step at which counts reach the quota, and the weight that makes it count as the quota: documents that tie there share it."""
    n = 0.0
    for step, c in counts:
        n += c
        if n >= quota:
            break
    return step, min(1.0, quota / n)


def sure_of(table: DataFrame, views: tuple[View, View]) -> tuple[Sure | None, Sure | None]:
    """What each view is confident of: CONFIDENT of each class, by the share of the labels, among documents without. None if its scores don't tell them apart."""

    def count(b):
        import numpy as np

        *both, y = _views(b)
        for v in y[~np.isnan(y)]:
            yield (2, int(v)), 1.0
        for k, (view, x) in enumerate(zip(views, both, strict=True)):
            for s, n in zip(*np.unique(step(view.raw(*_rows(x, np.isnan(y)))), return_counts=True), strict=True):
                yield (k, int(s)), float(n)

    got = _sums(table, count, "view step")
    rate = (got.get((2, 1), 0.0) + 0.5) / (got.get((2, 0), 0.0) + got.get((2, 1), 0.0) + 1)
    out = []
    for k in (0, 1):
        steps = sorted((s, n) for (view, s), n in got.items() if view == k)
        total = sum(n for _, n in steps)
        if not steps:
            out.append(None)
            continue
        bad, bad_weight = _quantile(steps, CONFIDENT * (1 - rate) * total)
        good, good_weight = _quantile(steps[::-1], CONFIDENT * rate * total)
        out.append(Sure(bad, good, PSEUDO_WEIGHT * bad_weight, PSEUDO_WEIGHT * good_weight) if bad < good else None)
    return out[0], out[1]


def _fit(table: DataFrame, text: View | None, meta: View | None) -> tuple[View, View]:
    """Both views from the labels and, for documents without, from what the other view is confident of."""
    sure = sure_of(table, (text, meta)) if text else (None, None)

    def count(b):
        import numpy as np

        t, m, y = _views(b)
        for view, x, other, ox, at in ((0, t, meta, m, sure[1]), (1, m, text, t, sure[0])):
            target, w = y.copy(), np.where(np.isnan(y), 0.0, 1.0)
            if at is not None:
                steps = step(other.raw(*ox))
                for like, quality, weight in ((steps <= at.bad, 0.0, at.bad_weight), (steps >= at.good, 1.0, at.good_weight)):
                    like &= np.isnan(y)
                    target[like], w[like] = quality, weight
            use = w > 0
            bins, buckets = _rows(x, use)
            for f in range(bins.shape[1]):
                code, inverse = np.unique(bins[:, f] * 2 + target[use].astype(int), return_inverse=True)
                for c, v in zip(code, np.bincount(inverse, weights=w[use]), strict=True):
                    yield (view, f, int(c // 2), int(c % 2)), float(v)
            if buckets is not None:
                for k in (0, 1):
                    of = w[use] * (target[use] == k)
                    on = sum((of[lo : lo + STRIP] @ np.unpackbits(buckets[lo : lo + STRIP], axis=1) for lo in range(0, len(of), STRIP)), np.zeros(2 * GRAMS))
                    for f in np.flatnonzero(on):
                        yield (2, int(f), 0, k), float(on[f])

    import numpy as np

    got = _sums(table, count, "view feature value y")
    counts = [np.full((2, N_TEXT, BINS), 0.5), np.full((2, N_META, META_BUCKETS), 0.5), np.full((2, 2 * GRAMS), 0.5)]
    for (v, f, value, y), c in got.items():
        counts[v][(y, f) if v == 2 else (y, f, value)] += c
    return View(counts[0], counts[2], counts[0][:, 0, :].sum(axis=1) - BINS * 0.5 + 1), View(counts[1])


def line(raw, good, bad) -> tuple[float, float]:
    """Slope, not below 0, and level of the log-odds that make counts of good and bad at scores most likely, by Newton steps.

    Each class has a share of 1 / (its count + 2) on the other's side, so that few or
    well-parted labels don't make a view sure of itself; without labels, 0 and 0.
    """
    import numpy as np

    n1, n0 = good.sum(), bad.sum()
    up, down = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    n, hits = good + bad, good * up + bad * down
    scale = max(1.0, float(np.abs(raw).max(initial=0.0)))
    x = np.stack([raw / scale, np.ones(len(raw))])
    w = np.array([0.0, float(np.log((n1 + 1) / (n0 + 1)))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step_ = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + np.eye(2) * 1e-6, x @ (hits - n * p))
        w = w + np.clip(step_, -4, 4)
        if np.abs(step_).max() < 1e-9:
            break
    if w[0] < 0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    return float(w[0] / scale), float(w[1])


def _calibrate(table: DataFrame, views: tuple[View, View]) -> float:
    """Sets each view's calibration by the labels in steps of its score; returns the prior log-odds.

    Each labelled document is scored by the counts of all others, so that the
    score it is calibrated on isn't one that its own label has made.
    """
    import numpy as np

    def count(b):
        *both, y = _views(b)
        use = ~np.isnan(y)
        for k, (view, (x, bits)) in enumerate(zip(views, both, strict=True)):
            raw = view.without(x[use], y[use], None if bits is None else bits[use])
            steps = np.clip(np.floor(raw / CALIBRATION_STEP), -STEPS, STEPS).astype(int)
            for s, good in zip(steps.tolist(), y[use].astype(int).tolist(), strict=True):
                yield (k, s, good), 1.0

    got = _sums(table, count, "view step y")
    all_good, all_bad = (sum(v for (k, _, y), v in got.items() if k == 0 and y == c) for c in (1, 0))
    for k, view in enumerate(views):
        steps = sorted({s for v, s, _ in got if v == k})
        good, bad = (np.array([got.get((k, s, y), 0.0) for s in steps]) for y in (1, 0))
        view.slope, view.level = line((np.array(steps, dtype=float) + 0.5) * CALIBRATION_STEP, good, bad)
    return float(np.log((all_good + 1) / (all_bad + 1)))


def cotrained(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of all docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality 0 or 1), and their features().

    Null ids or qualities are no labels; a document with several is good if
    at least half of them say so. Rows that repeat an id each count, with the
    same label. Without labels, or without documents, everything scores 0.5.
    Very long texts are read whole. Other columns are ignored.
    """
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.round(F.avg("quality")).cast("double").alias("y"))
    table = cut(features(docs).join(y, "id", "left"))
    text, meta = _fit(table, None, None)
    for _ in range(rounds):
        text, meta = _fit(table, text, meta)
    return Model(text, meta, _calibrate(table, (text, meta))), table


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    return cotrained(docs, labels, rounds)[0]


def scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row (id, quality_score) per row of docs, from the features that the model was fitted on; texts are read once."""
    model, table = cotrained(docs, labels, rounds)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            (t, g), (m, _), _ = _views(b)
            yield pa.record_batch([b.column("id"), pa.array(model.scores(t, g, m), pa.float64())], ["id", "quality_score"])

    return table.mapInArrow(run, "id long, quality_score double")


def scored(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with the probability of being good; a column of that name is replaced.

    Null and empty texts and null metadata are values like others, equal rows
    have equal scores, very long texts are read whole, an empty table stays
    empty. Features are made anew, since a join with those of the training
    would shuffle the texts.
    """
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import numpy as np

        for text, lang, source, n in batches:
            got = [content((x or "").encode()) for x in text]
            t = np.array([x for x, _ in got], dtype=int).reshape(len(text), N_TEXT)
            g = np.frombuffer(b"".join(x for _, x in got), dtype=np.uint8).reshape(len(text), -1) if got else np.zeros((0, GRAMS // 4), dtype=np.uint8)
            m = np.array([metadata(None if pd.isna(a) else a, None if pd.isna(b) else b, None if pd.isna(c) else c) for a, b, c in zip(lang, source, n, strict=True)], dtype=int).reshape(len(text), N_META)
            yield pd.Series(model.scores(t, g, m))

    small_batches(docs.sparkSession)
    score = F.pandas_udf(run, "double")
    return docs.withColumn(name, score("text", "lang", "source", F.col("n_chars").cast("long")))


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, rounds: int = ROUNDS) -> DataFrame:
    """docs whose score is at least keep_from; the columns are those of docs, whatever their names."""
    name = "score_" + "_" * max(len(c) for c in docs.columns)
    return scored(docs, train(docs, labels, rounds), name).where(F.col(name) >= keep_from).drop(name)
