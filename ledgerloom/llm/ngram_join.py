"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of distinct word shingles; two link when
``100 * |x & y| >= percent * |x | y|``. The result is exact.

Order. Shingles are counted in a fixed table of hashed bins over all documents;
those in bins well above the mean form the frequent class. The global order has
rare shingles first, then frequent ones, each by hash. Only the efficiency
depends on the classes, not the result.

Keys. Sizes are cut into classes such that linked sets lie in one class or two
neighbouring ones; a pair belongs to the class of its larger set, and a set has
keys for its own class and the next. In a class, linked sets share a shingle of
their prefixes (the first ``n - least overlap + 1``). Rare shingles of the
prefix are keys by themselves. If the prefix runs into the frequent class, it is
extended and combinations of k = 2 frequent shingles are the keys: the class is
dealt by hash into partitions, of about three shingles of a set each, the order has
one partition after the other, and all pairs inside a partition are keys. A
partition with m shingles of the prefix covers m - 1 of them (two sets without a
common pair share one at most), so the prefix is extended by whole partitions
until rare shingles and covers add up to its size. Sets of one or two shingles,
which hold no pairs, have single keys in both classes.

Pairs. Equal sets are one. In a round each key pairs its members with the
smallest of them only; links found so far join members into components, and a
key whose members are all in one component is done. After ``rounds`` such rounds
members of different components are joined for what is left, large keys in salted
parts. A pair must agree
in sizes and in a parity sketch (its differing bits bound the symmetric
difference from below) before it leaves the join, and is verified by the
shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, fold_ascii, materialize, mix, salted, small_enough, text_steps
from ledgerloom.llm.components import components

BIN_BITS, BLOCK = 24, 1 << 14
SKETCH_WORDS = 32
ROUNDS = 1
#: Members of one key that meet the others in one task.
SALTED = 500
BROADCAST_BYTES = 32 << 20
#: Frequent shingles of a set that fall into one partition, on average.
PER_PARTITION = 3
#: Frequent: a bin so many standard deviations, and so many counts, over the mean.
FREQUENT_DEVIATIONS, FREQUENT_AT_LEAST = 4, 8

_K = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all shingles of n words, repeats included; a document
    of fewer words, but some, has its whole sequence as the only one."""
    h = mix(w.hash)
    if len(h) >= n:
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = mix(out * _K[0] + h[i : len(h) - n + 1 + i])
        inside = w.doc[: len(out)] == w.doc[n - 1 :]
        out, doc = out[inside], w.doc[: len(inside)][inside]
    else:
        out, doc = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.uint64(0)
            for y in w.hash[w.first[d] : w.first[d + 1]]:
                x = mix(np.array([x]) * _K[1] + y)[0]
            extra[i] = mix(np.array([x ^ np.uint64(w.count[d])]))[0]
        out, doc = np.append(out, extra), np.append(doc, short)
    return out, doc


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, by document and hash; row bounds of the documents."""
    h, doc = shingle_hashes(w, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(w.count) + 1))


def size_class(n: int, percent: int, bounds: list[int]) -> int:
    """Class c holds sizes bounds[c] .. bounds[c + 1] - 1; ``bounds`` grows."""
    while bounds[-1] <= n * 100 // percent + 2:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return int(np.searchsorted(bounds, n, "right")) - 1


def overlap(total: int, percent: int) -> int:
    """Least overlap of linked sets whose sizes add up to ``total``."""
    return -(-percent * total // (100 + percent))


def partitions(c: int, percent: int, bounds: list[int]) -> int:
    """Into how many partitions class c deals its frequent shingles: about
    ``PER_PARTITION`` of a set fall into one, and so few of a set's shingles are
    the only or the odd one of theirs that pairs cover the prefix of any set. 0
    where sets are too small for pairs."""
    low, high = bounds[max(c - 1, 0)], bounds[c]
    least = -(-percent * high // 100)
    sure = min(overlap(high + max(least, low), percent), overlap(max(low, least) + high, percent)) - 1
    return max(min((bounds[c + 1] - 1) // PER_PARTITION, sure), 0)


def keys_of(tokens: np.ndarray, frequent: np.ndarray, percent: int, bounds: list[int]) -> np.ndarray:
    """Keys of one set; ``tokens`` by hash, ``frequent`` marks their class."""
    n = len(tokens)
    own = size_class(n, percent, bounds)
    size_class(bounds[own + 1], percent, bounds)
    rare, common = tokens[~frequent], tokens[frequent]
    out = []
    for c in (own, own + 1):
        partner = max(-(-percent * n // 100), bounds[max(c - 1, 0)]) if c == own else bounds[c]
        if c != own and percent * partner > 100 * n:
            continue
        size = n - overlap(n + partner, percent) + 1
        salt = mix(np.array([c], np.uint64))  # an array of one, whose sums wrap around silently
        if size > 0:
            out.append(mix(rare[:size] ^ salt))
        if len(rare) < size:
            parts = partitions(c, percent, bounds)
            if not parts:
                out.append(mix(common ^ salt))
                continue
            part = (mix(common ^ (salt * _K[2])) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            count = np.bincount(part, minlength=parts)
            last = int(np.searchsorted(len(rare) + np.cumsum(np.maximum(count - 1, 0)), size))
            end = int(count[: last + 1].sum())
            part, token = part[order][:end], common[order][:end]
            for gap in range(1, int(count[: last + 1].max())):
                same = part[gap:] == part[:-gap]
                out.append(mix(mix(token[:-gap][same] ^ (salt + _K[4])) * _K[0] + token[gap:][same]))
    return np.unique(np.concatenate(out)) if out else tokens[:0]


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(tokens ^ _K[4]) & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def frequent_bins(docs: DataFrame, n: int) -> np.ndarray:
    """Bits of the bins of frequent shingles, packed: 2**BIN_BITS bits whatever
    the input. A task sends its counts in compressed blocks; blocks are added
    up where they meet, streaming."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BIN_BITS, np.uint32)
        for part in parts:
            for _, _, data, offsets in text_steps(part.column(0)):
                np.add.at(total, (shingle_hashes(Words(fold_ascii(data), offsets), n)[0] >> np.uint64(64 - BIN_BITS)).astype(np.int32), np.uint32(1))
        if not total.any():
            return
        np.minimum(total, 255, out=total)
        blocks = total.astype(np.uint8).reshape(-1, BLOCK)
        pack = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([pack.compress(x.tobytes()) for x in blocks], pa.binary())], names=["block", "counts"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for part in parts:
            for block, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                row = np.frombuffer(unpack.decompress(raw), np.uint8)
                if block in sums:
                    sums[block] += row
                else:
                    sums[block] = row.astype(np.uint64)
        pack = zstandard.ZstdCompressor(level=1)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([int(x.sum()) for x in sums.values()], pa.int64()), pa.array([pack.compress(x.tobytes()) for x in sums.values()], pa.binary())], names=["block", "total", "sums"])

    counted = docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, total bigint, sums binary")
    counted = materialize(counted, "bins")
    mean = (counted.agg(F.sum("total").alias("n")).first()["n"] or 0) / (1 << BIN_BITS)
    least = mean + FREQUENT_DEVIATIONS * mean**0.5 + FREQUENT_AT_LEAST

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in parts:
            bits = [np.packbits(np.frombuffer(unpack.decompress(x), np.uint64) >= least, bitorder="little").tobytes() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits, pa.binary())], names=["block", "bits"])

    out = np.zeros(1 << BIN_BITS - 3, np.uint8)
    for row in counted.select("block", "sums").mapInArrow(mark, "block int, bits binary").collect():  # 2**BIN_BITS bits, whatever the input
        out[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bins(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest (two longs), sketch, keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(frequent_bins(docs, n))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bounds = shared.value, [1, 2]
        for part in parts:
            for lo, hi, data, offsets in text_steps(part.column(1)):
                h, first = shingle_sets(Words(fold_ascii(data), offsets), n)
                often = in_bins(h, frequent)
                keys, sketch = [], []
                low, high = mix(h ^ _K[0]), mix(h ^ _K[1])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (low, high)]
                for a, b in zip(first[:-1], first[1:], strict=True):
                    keys.append(keys_of(h[a:b], often[a:b], percent, bounds) if b > a else h[:0])
                    sketch.append(parity_sketch(h[a:b]))
                size = np.diff(first)
                bound = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bound), pa.array(np.concatenate(keys).view(np.int64)))
                sketches = pa.ListArray.from_arrays(pa.array((np.arange(hi - lo + 1) * SKETCH_WORDS).astype(np.int32)), pa.array(np.concatenate(sketch)))
                digest = [pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in sums]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), *digest, sketches, lists], names=["doc_id", "n_shingles", "d1", "d2", "sketch", "keys"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, sketch array<bigint>, keys array<bigint>"), "signatures")


class Join:
    """The state of one join: signatures, links so far, written tables."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent
        self.kind = docs.schema["doc_id"].dataType.simpleString()

    def fits(self, df: DataFrame, row_bytes: int = 32) -> DataFrame:
        return F.broadcast(df) if small_enough(df, F.lit(row_bytes), BROADCAST_BYTES) else df

    def sets(self, ids: DataFrame) -> DataFrame:
        n, kind = self.n, self.kind

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for lo, hi, data, offsets in text_steps(part.column(1)):
                    h, first = shingle_sets(Words(fold_ascii(data), offsets), n)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "tokens"])

        ids = materialize(ids.distinct(), "wanted")
        return self.docs.select("doc_id", "text").join(self.fits(ids), "doc_id", "left_semi").mapInArrow(run, f"doc_id {kind}, tokens binary")

    def side(self, c: str) -> DataFrame:
        return self.reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def alike(self):
        """Sizes and sketches of a and b allow a link."""
        least = F.ceil((F.col("n_a") + F.col("n_b")) * self.percent / (100 + self.percent))
        apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return (least <= F.least("n_a", "n_b")) & (apart <= F.col("n_a") + F.col("n_b") - 2 * least)

    def verified(self, near: DataFrame) -> DataFrame:
        """Those of the written pairs (a, b) that link."""
        percent = self.percent
        sets = materialize(self.sets(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id")))), "sets")
        full = near.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                keep = []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return materialize(full.select("a", "b", "x", "y").mapInArrow(run, f"a {self.kind}, b {self.kind}"), "verified")

    def run(self, rounds: int) -> DataFrame:
        sig = signatures(self.docs.where(F.col("doc_id").isNotNull()), self.n, self.percent)
        some = sig.where("n_shingles > 0")
        classes = materialize(some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
        # Copies: rows of a set that another document has, smaller by id.
        copies = materialize(some.select("doc_id", "d1", "d2", "n_shingles").join(classes.where("last > rep").drop("last"), ["d1", "d2", "n_shingles"]).where("doc_id > rep").select("doc_id", "rep").distinct(), "copies")
        self.reps = some.join(self.fits(copies.select("doc_id")), "doc_id", "left_anti")
        keyed = self.reps.select("doc_id", F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("last > pivot").select("key", "pivot")
        members = materialize(keyed.join(shared, "key"), "members")
        links, found = None, None
        for turn in range(rounds + 1):
            if turn:
                members = self.open_members(members, found)
                if members.isEmpty():
                    break
            if turn < rounds:
                pairs = members.where("doc_id > pivot")
                if turn:
                    pairs = pairs.where("component <> pivot_component")
                pairs = pairs.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
                pairs = pairs.join(self.side("a"), "a").join(self.side("b"), "b").where(self.alike())
            else:  # the rest, pair by pair; only pairs that may link leave the join
                pairs = self.rest(members)
            new = self.verified(materialize(pairs.select("a", "b").distinct(), "near"))
            links = new if links is None else links.unionByName(new)
            found = materialize(components(links), "components")
        out = sig.select("doc_id", "n_shingles").join(copies.select("doc_id", "rep").distinct(), "doc_id", "left")
        out = out.withColumn("node", F.coalesce("rep", "doc_id")).join(found.withColumnRenamed("component", "least"), "node", "left")
        named = out.select("doc_id", "n_shingles", F.coalesce("least", "node").alias("component_id"))
        lost = self.docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), "doc_id")
        return named.unionByName(lost.toDF("doc_id", "n_shingles", "component_id"))

    def rest(self, members: DataFrame) -> DataFrame:
        """Pairs under one key of members in different components that may link. A
        key of many members is dealt over salts, one for each ``SALTED`` of them."""
        dealt = salted(members, SALTED, BROADCAST_BYTES)
        left = dealt.select("key", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"), F.col("doc_id").alias("a"), F.col("component").alias("ca")).join(self.side("a"), "a")
        right = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("doc_id").alias("b"), F.col("component").alias("cb")).join(self.side("b"), "b")
        return left.join(right, ["key", "salt"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & self.alike())

    def open_members(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Members without the last pivots, of keys that still hold members of
        more than one component, with the next pivots."""
        rest = members.where("doc_id > pivot").select("key", "doc_id")
        rest = rest.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        heads = rest.groupBy("key").agg(F.min(F.struct("doc_id", "component")).alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        # Written, so that the members of a hot key can be split over tasks by the join.
        heads = materialize(heads.select("key", F.col("head.doc_id").alias("pivot"), F.col("head.component").alias("pivot_component")), "heads")
        return materialize(rest.join(self.fits(heads), "key"), "members")


def ngram_components(docs: DataFrame, shingle: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id (smallest id reachable
    by links, a document's own included).

    A-Z count as a-z. A text without words, or null, has no shingles and no
    links. An id names one document: repeated rows of an id must have one text
    and get one result each. A row without an id gets 0 shingles and no
    component. An empty table gives an empty result.
    """
    return Join(docs, shingle, percent).run(rounds)
