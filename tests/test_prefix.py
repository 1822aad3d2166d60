"""Running values in blocks against windows; no task holds a large key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import prefix, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """Nine rows in ten belong to one key; null keys, ties in nothing but ``at``."""
    rng = random.Random(2)
    data = [(rng.choice([None, 1, 2, 3]) if i % 10 == 0 else 7, rng.randrange(50) if i % 11 else None, i, rng.randrange(-9, 9) if i % 3 else None, f"v{i}" if i % 37 == 0 else None) for i in range(6000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k long, at long, id long, x long, s string").repartition(4)


def shown(df):
    return sorted(map(tuple, df.select("k", "id", "total", "seen", "row").collect()), key=repr)


def test_blocks_equal_windows(spark, skewed):
    get = lambda most: prefix.along(skewed, ["k"], ["at", "id"], sums={"total": F.col("x")}, lasts={"seen": F.col("s"), "row": F.struct("x")}, most=most)
    plain = shown(get(None))
    assert shown(get(300)) == plain and shown(get(60)) == plain and shown(get(10**9)) == plain


def test_no_task_holds_a_large_key(spark, skewed, monkeypatch):
    """Neither when rows are dealt nor in the windows' exchange."""
    dealt, deal = [], prefix.written
    monkeypatch.setattr(prefix, "written", lambda df, name: (dealt.append((name, deal(df, name))), dealt[-1][1])[1])
    prefix.along(skewed, ["k"], ["at", "id"], sums={"total": F.col("x")}, most=500).count()
    blocks = dict(dealt)["blocks"].groupBy("k", "__block").count().collect()
    assert len(blocks) >= 10 and max(r["count"] for r in blocks) <= 1000


def test_empty_and_one_row(spark, skewed):
    none = skewed.where("false")
    assert prefix.along(none, ["k"], ["id"], sums={"total": F.col("x")}, lasts={"seen": F.col("s")}, most=0).collect() == []
    one = skewed.where("id = 37")
    assert [r.seen for r in prefix.along(one, ["k"], ["id"], lasts={"seen": F.col("s")}, most=0).collect()] == [None]


def test_row_operators_with_large_keys(spark):
    data = [(1 if i % 10 else 2, i, ["deposit", "withdrawal"][i % 2], 100 + i % 13, f"2024-01-{1 + i // 200:02d}" if i % 40 == 3 else None) for i in range(3000)]
    book = spark.createDataFrame(data, "k long, id long, side string, cents long, date string").withColumn("date", F.col("date").cast("date"))
    keys, order = ["k"], ["id"]
    for f in (
        lambda m: rows.running_balance(book, keys, order, F.lit(5), m),
        lambda m: rows.balance_step(rows.running_balance(book, keys, order, F.lit(5), m).withColumns({"signed": F.when(F.col("id") % 4 > 0, F.col("signed")), "balance": F.when(F.col("id") % 5 > 0, F.col("balance"))}), keys, order, F.lit(5), m),
        lambda m: rows.inherit_date(book, keys, order, F.lit("2023-12-31").cast("date"), m),
        lambda m: rows.segments(book, keys, order, F.col("id") % 50 == 0, m),
    ):
        assert sorted(map(tuple, f(None).collect()), key=repr) == sorted(map(tuple, f(50).select(*f(None).columns).collect()), key=repr)
