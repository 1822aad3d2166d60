"""Helpers shared by the corpus operators: input, shared-folder tables, words.

``WORD`` is the corpus word everywhere: a maximal run of characters other than
the space and U+0009..U+000D.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one numpy step works on; a longer document is one step.
STEP_BYTES = 2 << 20
#: Bytes hashed at once inside a step, cut at white space.
HASH_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared tables
def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local master
    (tests) gets a temporary folder, recorded in the session; a cluster, whose
    executors share no such folder, gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="corpus_")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: the
    lineage is cut, and a lost executor loses nothing that was written. The table
    goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, bytes_per_row: Column, limit: int) -> bool:
    """Whether a written table takes at most ``limit`` bytes, by a sum over it."""
    size = df.agg(F.sum(bytes_per_row.cast("long")).alias("b")).first()["b"]
    return (size or 0) <= limit


def salted(members: DataFrame, most: int, limit: int) -> DataFrame:
    """``members`` with ``salts``: into how many parts its ``key`` is dealt, one for
    each ``most`` members. Only the large keys are looked up, a table of at most
    1 / ``most`` of the rows."""
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = materialize(large.select("key", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("many")), "large_keys")
    found = members.join(F.broadcast(large) if small_enough(large, F.lit(16), limit) else large, "key", "left")
    return found.withColumn("salts", F.coalesce("many", F.lit(1))).drop("many")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batches(spark: SparkSession, records: int = 1000) -> None:
    """Rows an Arrow batch holds from now on; documents are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


# ---------------------------------------------------------------- native words
def words(text: Column) -> Column:
    """array<string> of the words; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def n_words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_RUN))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- numpy words
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x + _M1
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


_BYTE = mix(np.arange(256, dtype=np.uint64) * np.uint64(2) + np.uint64(0x5DEECE66D))
_BASE = np.uint64(0xD1342543DE82EF95)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 4096), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.cumprod(more, dtype=np.uint64)
    return _POWERS


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, bytes of UTF-8."""
    return _FOLD[data]


class Words:
    """Words of consecutive documents: their 64-bit hash, the document each
    belongs to, and byte bounds in ``data``. Row ``d`` of ``first`` is the index
    of document d's first word; ``first[-1]`` is the number of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        hashes, starts, ends, at, n = [], [], [], 0, len(data)
        while at < n:
            stop = min(n, at + HASH_BYTES)
            if stop < n:
                back = np.flatnonzero(_IS_SPACE[data[at:stop]])
                if len(back):
                    stop = at + int(back[-1]) + 1
                else:
                    ahead = np.flatnonzero(_IS_SPACE[data[stop:]])
                    stop = stop + int(ahead[0]) + 1 if len(ahead) else n
            h, s, e = _block(data[at:stop], offsets[(offsets >= at) & (offsets <= stop)] - at)
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
            at = stop
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.hash, self.start, self.end = cat(hashes, np.uint64), cat(starts, np.int64), cat(ends, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)


def _block(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _IS_SPACE[data]
    n = len(data)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[cuts[cuts < n]] = True
    after[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    owner = np.zeros(n, np.int64)
    owner[starts[1:]] = np.diff(starts)
    rank = np.arange(n) - starts[0] - np.cumsum(owner)
    rank[: starts[0]] = 0
    part = _BYTE[data] * _powers(int(rank.max()) + 1)[rank]
    part[space] = 0
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(part, out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64)), starts, ends


def text_steps(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets) of rows that
    together take about ``step`` bytes. A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def digest_words(w: Words, d: int) -> bytes:
    """The words of document d joined by one space, UTF-8."""
    return b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True))
