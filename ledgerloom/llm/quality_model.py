"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k | x) = sigmoid(w . x - t_k) with one weight vector for all grades
and ordered thresholds t_1 < t_2 < ...; a document gets its expected grade and
its tail probability for selection. Features are hashed: lower-cased words, word
shapes (runs of upper case, lower case, digits and each mark), and a few buckets
of the document (length, distinct words, repeated lines), weighted by log counts
and scaled to unit length.

The model is fitted on at most ``sample`` rated documents (a documented bound;
those of least hash), whose sparse features are brought to the driver, and is
``2**bits`` floats to broadcast. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, fold_ascii, materialize, mix, text_steps

BITS = 18
SAMPLE = 6000
#: Features of the sampled rows together, at most: what the driver holds of them.
CELLS = 8 << 20
ROUNDS = 150

_SHAPE = np.full(256, 97, np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = 65, 97, 48
_SHAPE[[9, 11, 12, 13]] = 32


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bin, value), values of a document of unit length."""
    docs = len(offsets) - 1
    cut = np.uint64(64 - bits)
    w = Words(fold_ascii(data), offsets)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][offsets[:-1] < len(shape)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    s = Words(shape[keep], at)
    # Lines: hash of the words between line ends.
    line_ends = np.concatenate([[0], np.cumsum(data == 10)])[w.start] if len(w.start) else np.empty(0, np.int64)
    first = np.ones(len(w.hash), bool)
    first[1:] = (line_ends[1:] != line_ends[:-1]) | (w.doc[1:] != w.doc[:-1])
    begin = np.flatnonzero(first)
    lines = np.add.reduceat(mix(w.hash + np.arange(len(w.hash), dtype=np.uint64) - np.repeat(begin, np.diff(np.append(begin, len(w.hash)))).astype(np.uint64)), begin) if len(begin) else np.empty(0, np.uint64)
    owner = w.doc[begin]
    ratio = lambda part, whole: np.floor(8 * part / np.maximum(whole, 1)).astype(np.uint64)
    n_lines = np.bincount(owner, minlength=docs)
    distinct_lines = np.bincount(_distinct(owner, lines), minlength=docs)
    distinct_words = np.bincount(_distinct(w.doc, w.hash), minlength=docs)
    one = np.arange(docs)
    buckets = [np.log2(w.count + 1).astype(np.uint64), ratio(n_lines - distinct_lines, n_lines) + 100, ratio(distinct_words, w.count) + 200]
    doc = np.concatenate([w.doc, s.doc, *[one] * len(buckets)])
    name = np.concatenate([mix(w.hash), mix(s.hash ^ np.uint64(0x5A17)), *[mix(b.astype(np.uint64) ^ np.uint64(0xB0C5)) for b in buckets]])
    pair, count = np.unique((doc.astype(np.uint64) << np.uint64(bits)) | (name >> cut), return_counts=True)
    doc, bin_, value = (pair >> np.uint64(bits)).astype(np.int64), (pair & np.uint64((1 << bits) - 1)).astype(np.int64), np.log1p(count)
    length = np.sqrt(np.bincount(doc, value * value, docs))
    return doc, bin_, value / length[doc]


def _distinct(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Documents of the distinct (document, name) pairs."""
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    return doc[keep]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class CumulativeLink:
    """Weights and ordered thresholds; grades are 0 .. len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, row: np.ndarray, bin_: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, bits: int = BITS, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-5) -> CumulativeLink:
        """Maximum likelihood with weight decay, by Adam on all rows at once.
        Thresholds are the first one and positive steps, so they stay ordered."""
        size, n, cuts = 1 << bits, len(grade), max(grades - 1, 1)
        if not n:
            return cls(np.zeros(size), np.arange(cuts, dtype=float))
        share = np.clip([(grade >= k).mean() for k in range(1, cuts + 1)], 1e-3, 1 - 1e-3)
        start = -np.log(share / (1 - share))
        theta = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for turn in range(1, rounds + 1):
            w, steps = theta[:size], np.exp(theta[size + 1 :])
            t = np.cumsum(np.concatenate([theta[size : size + 1], steps]))
            x = np.bincount(row, w[bin_] * value, n)
            # Likelihood of a grade: difference of neighbouring tails; 1 above the first, 0 below the last.
            tail = np.column_stack([np.ones(n), *[sigmoid(x - c) for c in t], np.zeros(n)])
            hi, lo = tail[np.arange(n), grade], tail[np.arange(n), grade + 1]
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            dx = dlo - dhi
            dt = np.zeros(cuts)
            np.add.at(dt, grade[grade > 0] - 1, dhi[grade > 0])
            np.add.at(dt, grade[grade < cuts], -dlo[grade < cuts])
            tails = np.cumsum(dt[::-1])[::-1]
            g = np.concatenate([np.bincount(bin_, dx[row] * value, size) / n + decay * w, tails[:1] / n, tails[1:] * steps / n])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        return cls(theta[:size], np.cumsum(np.concatenate([theta[size : size + 1], np.exp(theta[size + 1 :])])))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. , by column."""
        return np.column_stack([sigmoid(score - t) for t in self.thresholds])


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE, bits: int = BITS, cells: int = CELLS) -> CumulativeLink:
    """``ratings``: doc_id, grade (0 .. grades - 1; others are left out). At most
    ``sample`` rated ids are used, one row of each grade of an id (of several texts the
    first by code point), and of these, in the same order, as many as have ``cells``
    features together: so what the driver gets is bounded, however often an id is
    repeated and however long texts are."""
    rated = ratings.where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, data, offsets in text_steps(part.column(0)):
                doc, bin_, value = features(data, offsets, bits)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                pieces = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(2).slice(lo, hi - lo), part.column(1).slice(lo, hi - lo), pa.array(np.diff(cut), pa.int64()), pieces(bin_.astype(np.int32)), pieces(value.astype(np.float32))], names=["doc_id", "grade", "n", "bins", "vals"])

    texts = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = materialize(texts.select("text", "grade", "doc_id").mapInArrow(run, f"doc_id {kind}, grade int, n bigint, bins binary, vals binary"), "rated_sample")
    # One window over all, of ``sample`` narrow rows.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("doc_id", "grade", F.sum("n").over(order).alias("upto")).where(F.col("upto") <= cells).select("doc_id", "grade")
    found = rows.join(F.broadcast(within), ["doc_id", "grade"]).select("doc_id", "grade", "bins", "vals").collect()
    found.sort(key=lambda r: (str(r["doc_id"]), r["grade"]))
    bins, values = [np.frombuffer(r["bins"], np.int32) for r in found], [np.frombuffer(r["vals"], np.float32) for r in found]
    row = np.repeat(np.arange(len(found)), [len(x) for x in bins])
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return CumulativeLink.fit(row, cat(bins, np.int64), cat(values, float), np.array([r["grade"] for r in found], np.int64), grades, bits)


def score(docs: DataFrame, model: CumulativeLink, bits: int = BITS) -> DataFrame:
    """(doc_id, text) -> doc_id, expected_grade, tails (P(grade >= k), k = 1 ..).

    A null or blank text is scored by its document features alone. Repeated rows
    are scored each; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for part in parts:
            for lo, hi, data, offsets in text_steps(part.column(1)):
                doc, bin_, value = features(data, offsets, bits)
                tails = held.tails(np.bincount(doc, held.weights[bin_] * value, hi - lo))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(hi - lo + 1) * tails.shape[1]).astype(np.int32)), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array(tails.sum(1)), lists], names=["doc_id", "expected_grade", "tails"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tails array<double>")
