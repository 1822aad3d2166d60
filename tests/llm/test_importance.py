"""Importance resampling against plain Python, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import importance
from ledgerloom.operators.prefix import ranked
from tests.llm.test_operators import LONG, none, odd, odd_rows  # noqa: F401 (fixtures)


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, target, percent, least, orders=3, buckets=10_000):
    def hashed(text):
        w = terms(text)
        runs = [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(x.encode()) % buckets for x in runs]

    docs, count, aim = [(i, *hashed(t)) for i, t in rows], [0] * buckets, [0] * buckets
    for _, _, b in docs:
        for x in b:
            count[x] += 1
    for t in target:
        for x in hashed(t)[1]:
            aim[x] += 1
    S, T = sum(count) + buckets, sum(aim) + buckets
    gain = [math.floor(1000 * math.log((t + 1) * S / ((s + 1) * T))) for s, t in zip(count, aim, strict=True)]
    out = []
    for i, n, b in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        out.append((i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    first = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    first = first[: percent * len(first) // 100]
    place = {id(r): k for k, r in enumerate(first, 1)}
    return sorted([(*r, place.get(id(r))) for r in out], key=repr)


def got(docs, target, percent, least, **more):
    rows = importance.resample(docs, target, percent, least, **more)
    return sorted(map(tuple, rows.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("orders,percent", [(1, 50), (2, 7), (3, 5), (4, 100)])
def test_matches_plain_python(spark, orders, percent):
    rng = random.Random(orders)
    vocab = ["alpha", "Beta", "gämma", "delta-x", "ÉCOLE", "漢字", "seven7", "a", "🙂z", "it's"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12)))) for i in range(400)]
    target = [(t,) for _, t in rows[:9]] + [(None,), ("",)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(docs, spark.createDataFrame(target, "text string"), percent, 3, orders=orders) == brute(rows, [t for t, in target], percent, 3, orders)


def test_odd_rows(spark, odd, none):  # noqa: F811
    """Repeated rows each take part; a null id comes last among equals; a table of
    target texts without words is a uniform target; an empty input gives no rows."""
    rows = [(r[0], r[1]) for r in odd_rows()]
    target = spark.createDataFrame([("alpha beta lorem ipsum",), (None,)], "text string")
    assert got(odd, target, 60, 0) == brute(rows, ["alpha beta lorem ipsum"], 60, 0)
    assert got(odd, none, 50, 3) == brute(rows, [], 50, 3)
    assert got(none, target, 50, 3) == []


def test_very_long_texts(spark):
    rows = [(1, "lorem ipsum é dolor " * 150_000), (2, "x" * 1_000_000), (3, LONG), (4, "," * 1_000_000)]
    target = [LONG[:4000]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, spark.createDataFrame([(t,) for t in target], "text string"), 100, 1) == brute(rows, target, 100, 1)


def test_ranks_of_equal_rows(spark):
    """Each of equal rows has a rank of its own, whatever the partitions."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("__x")).repartition(9)
    out = ranked(rows, [F.col("a").desc()], "place").collect()
    assert sorted(r.place for r in out) == list(range(1, 1001))
    assert [r.a for r in sorted(out, key=lambda r: r.place)] == sorted((r.a for r in out), reverse=True)
