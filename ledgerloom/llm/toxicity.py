"""Toxicity behind disguises: noisy-channel restoring, then a text score.

1. Language model. Counts of letter triples over all documents, summed where
   they are; there are 27**3 of them whatever the input.
2. Restoring. A disguised word (look-alike characters, letters set apart, long
   repetitions) is a lattice: every stretch of it could stand for a few letter
   strings, each at a price. Viterbi finds the reading of least price plus
   surprise under the language model. Only words that look disguised are
   decoded; readings are kept in a bounded cache.
3. Score. Hashed words and word beginnings of the restored text, how often they
   occur and what share they make up, those that tell toxic from other documents,
   in a logistic model fitted on at most ``sample`` labelled rows (a documented
   bound). Features are 2**(BITS + LEVEL_BITS) at most, of which the executors
   choose those with a likelihood ratio over ``LEAST_GAIN``; the driver holds the
   chosen ones only. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, materialize, mix, text_steps
from ledgerloom.llm.quality_model import sigmoid

SAMPLE = 8000
THRESHOLD = 0.3
LEAST_GAIN = 6.0
ROUNDS = 400
BITS = 22
LETTERS = 27

# What a look-alike can stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "£": "l", "€": "e", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
LOOK, KEEP_DOUBLE, UNDOUBLE, DROP, WILD = 0.7, 0.0, 1.2, 4.0, 1.5

SEPARATORS = r"[ \t._*/\\|~+,-]+"
SET_APART = re.compile(rf"(?<![\w@$])(?<!\w['’])[a-z0-9@$!](?:{SEPARATORS}[a-z0-9@$!]){{3,}}(?![\w@$])")
MARKED = re.compile(r"(?<![\w@$!|+(<£€*#%.\-])(?=[0-9@$!|+(<£€*#%.\-_]*[a-z])(?=[a-z]*[0-9@$!|+(<£€*#%.\-_])[a-z0-9@$!|+(<£€*#%.\-_]{3,}+(?!\w)")
HAS_MARK = re.compile(r"[a-z][0-9@$|+<£€*#%]|[a-z][!(._\-]+[a-z]|(?<!\w)[0-9@$!|+(<£€]+[a-z]")
REPEATED = re.compile(r"(?<!\w)[a-z]*([a-z])\1\1[a-z]*")
HAS_REPEAT = re.compile(r"([a-z])\1\1")
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
CLOSING = {"(": ")", "<": ">"}
AFTER = re.compile(r"[^\w\s]*")
CACHED_CHARS = 60
CACHE = 200_000


class CharModel:
    """Surprise of a letter after two others; 0 is a word's edge, 1 .. 26 a .. z."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        two = c.sum(0) + 1.0  # letter pairs
        back = (two / two.sum(1, keepdims=True))[None, :, :]
        self.price = -np.log((c + 5 * back) / (c.sum(2, keepdims=True) + 5))
        self.table = self.price.tolist()


_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter triples over all texts; runs of other characters are one edge."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for part in parts:
            for _, _, data, _ in text_steps(part.column(0), 1 << 20):
                c = _CODE[data]
                c = np.concatenate([[0, 0], c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])] if len(c) else c, [0]])
                total += np.bincount(c[:-2] * LETTERS * LETTERS + c[1:-1] * LETTERS + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(LETTERS**3)
    for r in docs.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # 27**3 rows at most
        out[r["gram"]] = r["n"]
    return out


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each stretch of a disguised word the strings it could stand for."""
    out = []
    for m in re.finditer(r"(.)\1*", word, re.S):
        c, n = m[1], m.end() - m.start()
        if "a" <= c <= "z":
            if n == 1:
                out.append([(c, 0.0)])
            elif n == 2:
                out.append([(c + c, KEEP_DOUBLE), (c, UNDOUBLE)])
            else:
                out.append([(c, 0.3), (c + c, 0.5)])
        elif c in LOOKALIKES:
            price = WILD if len(LOOKALIKES[c]) > 2 else LOOK
            options = [(x, price) for x in LOOKALIKES[c]]
            if not c.isdigit():
                options.append(("", DROP))
            if n > 1:
                options += [(x + x, price) for x in LOOKALIKES[c]]
            out.append(options)
        else:  # a separator inside the word
            out.append([("", 0.2)])
    return out


def decode(word: str, model: CharModel) -> str:
    """The best reading: over the stretches, the least-priced way to each pair of
    last letters; a word starts and ends at an edge. What all ways share is said
    once, so a long word costs no more than its length."""
    price, shared = model.table, []
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in lattice(word):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, said) in states.items():
            for letters, extra in options:
                x, y, total = a, b, cost + extra
                for c in letters:
                    z = ord(c) - 96
                    total += price[x][y][z]
                    x, y = y, z
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, said + letters)
        if len(new) == 1:
            (end, (cost, said)), = new.items()
            shared.append(said)
            new = {end: (cost, "")}
        states = new
    return "".join(shared) + min((cost + price[a][b][0], said) for (a, b), (cost, said) in states.items())[1]


class Restorer:
    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def word(self, m: re.Match) -> str:
        """A match's word restored; brackets around it and marks after it stay."""
        core, after = m[0], AFTER.match(m.string, m.end())[0]
        while core[:1] in CLOSING and CLOSING[core[0]] in after:
            core = core[1:]
        seen = core.rstrip(".,;:!?")
        return m[0][: len(m[0]) - len(core)] + self.said(seen) + core[len(seen) :]

    def said(self, seen: str) -> str:
        short = LONG_RUN.sub(r"\1\1\1", seen)
        # Junk marks after a plain word stay as they are; so do numbers and codes.
        if short.isalpha() and not HAS_REPEAT.search(short) or sum(c.isdigit() for c in short) * 2 > len(short) + 1 or re.fullmatch(r"[a-z]+[^a-z0-9]{2,}", short):
            return seen
        if len(short) > CACHED_CHARS:
            return decode(short, self.model)
        if short not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[short] = decode(short, self.model)
        return self.known[short]

    def text(self, text: str) -> str:
        """Lower-cased, disguised words restored."""
        text = text.lower()
        if SET_APART.search(text):
            text = SET_APART.sub(lambda m: re.sub(SEPARATORS, "", m[0]), text)
        if HAS_MARK.search(text):
            text = MARKED.sub(self.word, text)
        if HAS_REPEAT.search(text):
            text = REPEATED.sub(self.word, text)
        return text


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
PREFIXES = (4, 5, 6, 7)
#: A feature is a bin at a level. Level 0: it occurs; the next: so many times at
#: least; the last: that it makes up one of so many words at least, where it occurs
#: twice or more.
TIMES, SHARES = (2, 3, 6), (200, 100, 40)
LEVEL_BITS = 3


def cores(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words from their first letter to their last; those without one are none."""
    w = Words(data, offsets)
    letters = np.append(np.flatnonzero(_LETTER[data]), len(data))
    start = letters[np.searchsorted(letters, w.start)]
    end = letters[np.searchsorted(letters, w.end) - 1] + 1
    some = start < w.end
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[some]] = 1
    edge[end[some]] -= 1
    return Words(np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, data, np.uint8(32)), offsets)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature), sorted: words without outer marks, and the
    first 4 to 7 bytes of longer ones, hashed to 2**bits bins, at every level
    they reach."""
    w = cores(data, offsets)
    size = w.end - w.start
    docs, names = [w.doc[size >= 3]], [mix(w.hash[size >= 3] ^ np.uint64(0xF00D))]
    at, h = np.flatnonzero(size > PREFIXES[0]), None
    for j in range(PREFIXES[-1]):
        if j >= PREFIXES[0]:
            longer = size[at] > j + 1
            at, h = at[longer], h[longer]
        byte = w.data[w.start[at] + j].astype(np.uint64)
        h = mix((np.uint64(0) if h is None else h * np.uint64(0x9E3779B97F4A7C15)) + byte)
        if j + 1 in PREFIXES:
            docs.append(w.doc[at])
            names.append(mix(h ^ np.uint64(j + 1)))
    doc, name = np.concatenate(docs), np.concatenate(names) >> np.uint64(64 - bits)
    pair, count = np.unique((doc.astype(np.uint64) << np.uint64(bits)) | name, return_counts=True)
    words = w.count[(pair >> np.uint64(bits)).astype(np.int64)]
    reached = [pair << np.uint64(LEVEL_BITS)]
    for level, holds in enumerate([*(count >= n for n in TIMES), *((count >= 2) & (count * n >= words) for n in SHARES)], 1):
        reached.append((pair[holds] << np.uint64(LEVEL_BITS)) | np.uint64(level))
    out = np.sort(np.concatenate(reached))
    bits += LEVEL_BITS
    return (out >> np.uint64(bits)).astype(np.int64), (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def restored_steps(texts: pa.Array, restorer: Restorer):
    """As text_steps, over restored texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for at in range(0, len(texts), 200):
        few = pa.array([restorer.text(x or "") for x in texts.slice(at, 200).to_pylist()], pa.large_string())
        for lo, hi, data, offsets in text_steps(few):
            yield at + lo, at + hi, data, offsets


class Score:
    """Selected features (sorted), their weights, a bias."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def of(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        hit, at = places(self.chosen, feature)
        return sigmoid(self.bias + np.bincount(doc[hit], self.weights[at], n))

    @classmethod
    def fit(cls, chosen: np.ndarray, row: np.ndarray, place: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> Score:
        """Logistic weights, none below 0, of ``place`` (in ``chosen``) by row. Half
        of the occurrences are left out at random in each round, so each feature
        learns to tell without the others; the seed is fixed."""
        n, pos = len(toxic), int(toxic.sum())
        if not n or not pos or pos == n:
            return cls(np.empty(0, np.int64), np.empty(0), -3.0 if not pos else 3.0)
        w, bias = np.zeros(len(chosen)), np.log(pos / (n - pos))
        m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        draw = np.random.default_rng(1)
        for turn in range(1, rounds + 1):
            some = draw.random(len(row)) < 0.5
            r, c = row[some], place[some]
            p = sigmoid(bias + 2 * np.bincount(r, w[c], n)) - toxic
            g = np.append(2 * np.bincount(c, p[r], len(chosen)) / n + 2e-5 * w, p.mean())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
            w, bias = np.maximum(w - step[:-1], 0), bias - step[-1]
        return cls(chosen, w, float(bias))


def places(chosen: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``feature`` are chosen, and where."""
    if not len(chosen):
        return np.zeros(len(feature), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
    hit = chosen[at] == feature
    return hit, at[hit]


def sample_features(docs: DataFrame, labels: DataFrame, restorer: Restorer, sample: int) -> DataFrame:
    """toxic, features (binary) of at most ``sample`` labelled ids, written: one row of
    each label of an id, of several texts the first by code point."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, data, offsets in restored_steps(part.column(0), restorer):
                doc, feature = features(data, offsets)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([part.column(1).slice(lo, hi - lo), pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["toxic", "features"])

    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialize(texts.select("text", "toxic").mapInArrow(run, "toxic int, features binary"), "toxic_sample")


def telling(rows: DataFrame, n: int, pos: int) -> np.ndarray:
    """Features that are much more frequent in toxic rows, by likelihood ratio.
    They are counted on executors (added up in each batch, then by a shuffle);
    only those that are chosen come back, 2**(BITS + LEVEL_BITS) whatever the input."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = np.diff(np.frombuffer(part.column(1).buffers()[1], np.int32)[part.column(1).offset :][: len(part) + 1]) // 4
            toxic = np.repeat(part.column(0).to_numpy(), sizes)
            feature = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in part.column(1)])
            for lo in range(0, len(feature), 1 << 20):
                names, at = np.unique(feature[lo : lo + (1 << 20)], return_inverse=True)
                both, toxic_ = np.bincount(at), np.bincount(at, toxic[lo : lo + (1 << 20)])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(both), pa.array(toxic_.astype(np.int64))], names=["feature", "n", "a"])

    rate, b = F.lit(pos / n), F.col("n") - F.col("a")
    fitted = (F.col("a") + 0.5 * rate) / (F.col("n") + 0.5)
    gain = 2 * (F.col("a") * F.log(fitted / rate) + b * F.log(F.greatest(1 - fitted, F.lit(1e-9)) / (1 - rate)))
    counted = rows.mapInArrow(count, "feature int, n bigint, a bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    found = counted.where((F.col("a") >= 2) & (fitted > 2 * rate) & (gain > LEAST_GAIN)).select("feature").toPandas()
    return np.sort(found["feature"].to_numpy().astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame, restorer: Restorer, sample: int = SAMPLE) -> Score:
    """``labels``: doc_id, toxic 0/1, of rows that may be learnt from. The driver
    gets the chosen features and, of each sampled row, which of them it has."""
    rows = sample_features(docs, labels, restorer, sample)
    n, pos = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not pos or pos == n:
        return Score.fit(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.full(n, float(bool(pos))))
    chosen = telling(rows, n, pos)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = [places(chosen, np.frombuffer(x.as_buffer(), np.int32))[1].astype(np.int32).tobytes() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.binary())], names=["toxic", "places"])

    # In one order, whatever that of the files, so that reruns agree.
    found = sorted((r["toxic"], bytes(r["places"])) for r in rows.mapInArrow(run, "toxic int, places binary").collect())
    held = [np.frombuffer(x, np.int32) for _, x in found]
    row = np.repeat(np.arange(len(found)), [len(x) for x in held])
    return Score.fit(chosen, row, np.concatenate(held).astype(np.int64), np.array([t for t, _ in found], float))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text), (doc_id, toxic) -> doc_id, score (0 to 1), predicted, and
    the columns ``keep`` of the row that was scored.

    A null or blank text has the score of a text without any telling word. Words of
    under three bytes are no features, and letters set apart are restored from four
    on: what is written in fewer has no say.
    Repeated rows are scored each; without labels all scores are low; an empty
    table gives an empty result.
    """
    read = ["doc_id", "text", *(c for c in keep if c != "text")]
    kept = [read.index(c) for c in keep]
    kinds = {c: docs.schema[c].dataType.simpleString() for c in read}
    restorer = Restorer(CharModel(letter_counts(docs)))
    shared = docs.sparkSession.sparkContext.broadcast((restorer.model, fit(docs, labels, restorer, sample)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = shared.value
        mine = Restorer(model)
        for part in parts:
            for lo, hi, data, offsets in restored_steps(part.column(1), mine):
                score = held.of(*features(data, offsets), hi - lo)
                same = [part.column(k).slice(lo, hi - lo) for k in (0, *kept)]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(score), pa.array((score >= threshold).astype(np.int32)), *same[1:]], names=["doc_id", "score", "predicted", *keep])

    return docs.select(*read).mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}, score double, predicted int", *(f"`{c}` {kinds[c]}" for c in keep)]))
