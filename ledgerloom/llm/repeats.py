"""Removal of long repeated word sequences by recompression.

A word covered by a window of ``window`` words whose sequence also starts in a
document of a smaller id is removed. Windows are found without listing them all:

1. Recompression. In a few rounds every document's words are renamed, first
   runs of one symbol, then pairs of a left and a right symbol (a symbol's side
   is a bit of its hash). A name is a 64-bit hash of what it stands for, so all
   executors agree on names without an exchange. With every symbol goes the
   stretch of words that its existence depends on (its neighbours' included):
   a window that holds the stretch holds the symbol, wherever it occurs.
2. Anchors. A window's anchor is the symbol of the highest round whose stretch
   lies in it, of those the longest, of least hash, leftmost. Equal windows have
   equal anchors, at equal places. Windows in a row with one anchor make one
   row (anchor's name, digest of all their words): about one for eighteen words.
3. Shared anchors. Rows that agree in anchor and words with a row of a smaller
   document are repeats as a whole. Anchors that occur with different words
   mark the ends of repeats; only there the windows of one row for each content
   are listed and compared one by one, by the digest of all their words.

Hot anchors: smallest ids are pre-aggregated on the map side, and the joins back
are plain sort-merge joins that adaptive execution splits where they are skewed.
Ids, places and hashes are all that is shuffled; texts are not, as long as the
table of spans is at most ``broadcast_bytes`` (its size is summed before; past
that the spans are joined by a shuffle). Spans of all documents are a written
table in the shared folder.

Names only find what may repeat. That it does is verified on the words themselves,
by their BLAKE2 digest: 64 bits beside the 64 of the anchor's name, or 128 bits for
single windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import _IS_SPACE, Words, materialize, mix, small_enough, text_steps

WINDOW = 50
ROUNDS = 3
BROADCAST_BYTES = 32 << 20

_RUN, _PAIR, _SIDE, _ORDER = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def salted(base: np.uint64, turn: int) -> np.uint64:
    return np.uint64(int(base) * (turn + 1) & (1 << 64) - 1)


class Level:
    """Symbols in text order: name, first word, stretch [dl, dr), document."""

    def __init__(self, name, lo, dl, dr, doc):
        self.name, self.lo, self.dl, self.dr, self.doc = name, lo, dl, dr, doc


def name_runs(s: Level, first: np.ndarray) -> Level:
    """A run of one symbol becomes a symbol. Every symbol now also depends on its
    neighbours being different; at a document's edge on the edge itself."""
    n = len(s.name)
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    size = end - at
    name = np.where(size > 1, mix(s.name[at] * _RUN + size.astype(np.uint64)), s.name[at])
    doc = s.doc[at]
    dl, dr = s.dl[np.maximum(at - 1, 0)], s.dr[np.minimum(end, n - 1)]
    left_edge = np.ones(len(at), bool)
    left_edge[1:] = doc[1:] != doc[:-1]
    right_edge = np.append(left_edge[1:], True)
    dl = np.where(left_edge, first[doc] - 1, dl)
    dr = np.where(right_edge, first[doc + 1] + 1, dr)
    return Level(name, s.lo[at], dl, dr, doc)


def name_pairs(s: Level, first: np.ndarray, turn: int) -> Level:
    """A left symbol and the right symbol after it become a symbol. One left
    alone depends on the neighbour that didn't fit."""
    n = len(s.name)
    right = (mix(s.name ^ salted(_SIDE, turn)) & np.uint64(1)).astype(bool)
    together = s.doc[1:] == s.doc[:-1]
    pair = np.zeros(n, bool)
    pair[:-1] = ~right[:-1] & right[1:] & together
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    edge_before, edge_after = np.ones(n, bool), np.ones(n, bool)
    edge_before[1:] = edge_after[:-1] = ~together
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[0], before[1:] = 0, s.dl[:-1]
    after[-1], after[:-1] = 0, s.dr[1:]
    before = np.where(edge_before, first[s.doc] - 1, before)
    after = np.where(edge_after, first[s.doc + 1] + 1, after)
    dl = np.where(right & ~second, before, s.dl)
    dr = np.where(pair | ~right, after, s.dr)
    follow = np.empty(n, np.uint64)
    follow[-1], follow[:-1] = 0, s.name[1:]
    name = np.where(pair, mix(mix(s.name ^ _PAIR) * _PAIR + follow), s.name)
    keep = ~second
    return Level(name[keep], s.lo[keep], dl[keep], dr[keep], s.doc[keep])


class Digests:
    """BLAKE2 of stretches of words, one space between: equal for equal words."""

    def __init__(self, w: Words):
        space = _IS_SPACE[w.data]
        keep = ~space
        keep[1:] |= ~space[:-1]
        self.text = memoryview(np.where(space, np.uint8(32), w.data)[keep].tobytes())
        place = np.cumsum(keep) - 1
        self.start, self.end = place[w.start], place[w.end - 1] + 1

    def of(self, first: np.ndarray, last: np.ndarray, longs: int = 1) -> np.ndarray:
        """Of words first .. last of each pair, as rows of ``longs`` integers."""
        text, size = self.text, 8 * longs
        found = b"".join([blake2b(text[a:b], digest_size=size).digest() for a, b in zip(self.start[first].tolist(), self.end[last].tolist(), strict=True)])
        return np.frombuffer(found, np.int64).reshape(-1, longs)


def anchors(w: Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(doc, first window in it, number of windows, anchor) of each stretch of
    windows that have one anchor."""
    total = len(w.hash)
    none = np.empty(0, np.int64)
    if total < window:
        return none, none, none, none.astype(np.uint64)
    place = np.arange(total)
    level = Level(w.hash, place, place, place + 1, w.doc)
    levels = [level]
    for turn in range(rounds):
        level = name_pairs(name_runs(level, w.first), w.first, turn)
        levels.append(level)
    starts = place[: total - window + 1]
    starts = starts[w.doc[: total - window + 1] == w.doc[window - 1 :]]
    chosen, depth = np.full(len(starts), -1, np.int64), np.zeros(len(starts), np.int8)
    todo = np.arange(len(starts))
    for k in range(rounds, -1, -1):
        if not len(todo):
            break
        s = levels[k]
        lo = np.cumsum(np.bincount(s.dl + 1, minlength=total + 2))[starts[todo]]
        hi = np.cumsum(np.bincount(s.dr, minlength=total + 2))[starts[todo] + window]
        has = hi > lo
        words = np.diff(np.append(s.lo, total))
        rank = (np.uint64(15) - np.minimum(words, 15).astype(np.uint64) << np.uint64(60)) | (mix(s.name ^ salted(_ORDER, k)) >> np.uint64(4))
        chosen[todo[has]] = least(rank, lo[has], hi[has])
        depth[todo[has]] = k
        todo = todo[~has]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (depth[1:] != depth[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    key = np.empty(len(at), np.uint64)
    for k, s in enumerate(levels):
        mine = depth[at] == k
        key[mine] = mix(s.name[chosen[at[mine]]] + np.uint64(k))
    first = starts[at]
    doc = w.doc[first]
    return doc, first - w.first[doc], n, key


def least(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least rank in each [lo, hi), leftmost: a table of minima over
    powers of two, two of which cover any range."""
    out = np.empty(len(lo), np.int64)
    size = hi - lo
    best, low, step = np.arange(len(rank)), rank, 1
    while len(lo):
        mine = np.flatnonzero((size >= step) & (size < 2 * step))
        if len(mine):
            a, b = lo[mine], hi[mine] - step
            out[mine] = np.where(low[b] < low[a], best[b], best[a])
        if not (size >= 2 * step).any():
            return out
        a, b = low[:-step], low[step:]
        best = np.where(b < a, best[step:], best[:-step])
        low = np.minimum(a, b)
        step *= 2
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _with_spans(docs: DataFrame, spans: DataFrame, how: str, broadcast_bytes: int) -> DataFrame:
    fits = small_enough(spans, F.lit(64) + F.size("spans") * 16, broadcast_bytes)
    return docs.join(F.broadcast(spans) if fits else spans, "doc_id", how)


def repeated_spans(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, spans array<struct<at, n>>: windows ``at`` .. ``at + n - 1`` of the
    document also start in a document of a smaller id. Documents without such a
    window have no row."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, data, offsets in text_steps(part.column(1)):
                w = Words(data, offsets)
                doc, at, n, key = anchors(w, window, rounds)
                ids = part.column(0).slice(lo, hi - lo).take(pa.array(doc))
                first = w.first[doc] + at
                sig = Digests(w).of(first, first + n + window - 2)[:, 0]
                yield pa.RecordBatch.from_arrays([ids, _signed(key), pa.array(sig), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "anchor", "sig", "at", "n"])

    rows = materialize(docs.mapInArrow(find, f"doc_id {kind}, anchor bigint, sig bigint, at int, n int"), "anchors")
    firsts = materialize(rows.groupBy("anchor", "sig").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")), "owners")
    repeats = rows.join(firsts.where("other > owner").select("anchor", "sig", "owner"), ["anchor", "sig"]).where("doc_id > owner").select("doc_id", "at", "n")
    # Written, as the owners below, so that the next join can split a hot anchor.
    ends = materialize(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.min("owner").alias("least"), F.max("owner").alias("most")).where("contents > 1 and most > least").select("anchor"), "ends")
    unsure = rows.join(firsts.join(ends, "anchor").select("anchor", "sig", F.col("owner").alias("doc_id")), ["anchor", "sig", "doc_id"])
    listed = materialize(unsure.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "listed")

    def unfold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans = part.column(2)
            for lo, hi, data, offsets in text_steps(part.column(1)):
                w = Words(data, offsets)
                mine = spans.slice(lo, hi - lo)
                size = np.diff(mine.offsets.to_numpy())
                flat = mine.flatten()
                at, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
                doc = np.repeat(np.repeat(np.arange(hi - lo), size), n)
                each = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                first = w.first[doc] + each
                words = Digests(w).of(first, first + window - 1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(each.astype(np.int32))], names=["doc_id", "words", "more", "at"])

    single = materialize(_with_spans(docs, listed, "inner", broadcast_bytes).select("doc_id", "text", "spans").mapInArrow(unfold, f"doc_id {kind}, words bigint, more bigint, at int"), "windows")
    owners = materialize(single.groupBy("words", "more").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).where("other > owner").select("words", "more", "owner"), "window_owners")
    more = single.join(owners, ["words", "more"]).where("doc_id > owner").select("doc_id", "at", F.lit(1).alias("n"))
    found = repeats.unionByName(more).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("found"))
    # Spans that touch or overlap become one.
    merged = F.aggregate(
        F.slice("found", 2, F.size("found")),
        F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("done"), F.col("found")[0]["at"].alias("at"), (F.col("found")[0]["at"] + F.col("found")[0]["n"]).alias("stop")),
        lambda a, x: F.when(x["at"] <= a["stop"], F.struct(a["done"].alias("done"), a["at"].alias("at"), F.greatest(a["stop"], x["at"] + x["n"]).alias("stop"))).otherwise(
            F.struct(F.concat(a["done"], F.array(F.struct(a["at"].alias("at"), (a["stop"] - a["at"]).alias("n")))).alias("done"), x["at"].alias("at"), (x["at"] + x["n"]).alias("stop"))
        ),
        lambda a: F.concat(a["done"], F.array(F.struct(a["at"].alias("at"), (a["stop"] - a["at"]).alias("n")))),
    )
    return materialize(found.select("doc_id", merged.alias("spans")), "repeats")


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_text (kept words, one
    space between).

    Null and blank texts have no words. Texts shorter than a window keep all. An
    id names one document: repeated rows of an id must have one text, and each
    gets the same result. A row without an id loses nothing and takes nothing
    from others. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, window, rounds, broadcast_bytes)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, len(part), 100):
                few = part.slice(at, 100)
                total, gone, kept = [], [], []
                for text, found in zip(few.column(1).to_pylist(), few.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    total.append(len(words))
                    if found:
                        keep = np.ones(len(words), bool)
                        for x in found:
                            keep[x["at"] : x["at"] + x["n"] + window - 1] = False
                        words = list(compress(words, keep.tolist()))
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    joined = _with_spans(docs.select("doc_id", F.col("text").cast("binary").alias("text")), spans, "left", broadcast_bytes)
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")
