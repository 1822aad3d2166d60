"""Streams against batches: files shuffled, repeated and late, and a restart between."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from ledgerloom.operators import reconcile
from ledgerloom.plans.extract import extract
from ledgerloom.streaming import documents, tieout
from tests.test_extract import WORDS, statement

LEDGER = "account long, ts timestamp, event_id long, cents long, side string"
FIGURES = "account long, ts timestamp, beginning long, ending long, deposits_total long, withdrawals_total long, deposits_count long, withdrawals_count long"
WEEK = [dt.datetime(2025, 1, 6) + dt.timedelta(days=7 * k) for k in range(3)]
LATE = "30 days"


def test_tied_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(a, w + dt.timedelta(hours=rng.randrange(168)), i * 100 + k * 10 + a, rng.randrange(100, 999), rng.choice(["deposit", "withdrawal"])) for a in range(5) for k, w in enumerate(WEEK) for i in range(6) if (a, k) != (2, 1)]
    figures = []
    for a in range(5):
        for w in WEEK:
            own = [r for r in rows if r[0] == a and w <= r[1] < w + dt.timedelta(days=7)]
            sums = [sum(r[3] for r in own if r[4] == s) for s in ("deposit", "withdrawal")]
            figures.append((a, w + dt.timedelta(days=6), 1000, 1000 + sums[0] - sums[1] + (a == 3), *sums, *(sum(r[4] == s for r in own) for s in ("deposit", "withdrawal"))))
    figures = [(*f[:2], 1000, 1500, 500, 0, 1, 0) if f[0] == 2 and f[1] == WEEK[1] + dt.timedelta(days=6) else f for f in figures]
    rng.shuffle(rows)
    put = lambda name, data, schema: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def go():
        read = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
        tieout.drain(tieout.tied(read("figures"), read("rows"), ["account"], late=LATE), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").collect() if any(x.endswith(".parquet") for x in os.listdir(f"{tmp_path}/out")) else []

    put("rows", rows[:40], LEDGER)
    put("figures", figures[:7], FIGURES)
    assert go() == []
    # A new run goes on: the rest, and a file that comes a second time.
    put("rows", rows[40:], LEDGER)
    put("rows", rows[10:30], LEDGER)
    put("figures", figures[7:], FIGURES)
    assert go() == []
    far = dt.datetime(2025, 6, 1)
    put("rows", [(99, far, 999_999, 1, "deposit")], LEDGER)
    put("figures", [(99, far, 0, 0, 0, 0, 0, 0)], FIGURES)
    got = go()
    week = F.to_date(F.date_trunc("week", "ts")).alias("period")
    printed = spark.createDataFrame(figures, FIGURES).select("*", week)
    batch = reconcile.reconcile(printed, spark.createDataFrame(rows, LEDGER).select("*", week), ["account", "period"]).collect()
    key = lambda r: (r.account, r.period, r.dep_cents, r.wd_cents, r.dep_n, r.wd_n, r.residual, r.reconciled, r.n_ok)
    assert sorted(map(key, got)) == sorted(map(key, batch)) and len(got) == 15
    assert {(r.account, r.period) for r in got if r.dep_n + r.wd_n == 0} == {(2, WEEK[1].date())}
    # What comes after its week has closed changes nothing.
    put("rows", [(0, WEEK[0], 888_888, 5, "deposit")], LEDGER)
    assert sorted(map(key, go())) == sorted(map(key, batch))


def test_document_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    sheets = {d: statement(d, kind, i)[0] for i, (d, kind) in enumerate([("a", "two_columns"), ("b", "signed"), ("c", "sections")])}
    start = dt.datetime(2025, 5, 1)
    words = [(*w[:2], i, *w[2:], start + dt.timedelta(seconds=rng.randrange(300))) for d in sheets for i, w in enumerate(sheets[d])]
    rng.shuffle(words)
    schema = f"{documents.WORDS}, arrived timestamp"
    put = lambda data: spark.createDataFrame(data, schema).coalesce(2).write.mode("append").parquet(f"{tmp_path}/words")

    def go():
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/words").schema).parquet(f"{tmp_path}/words")
        documents.read_documents(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted(os.listdir(f"{tmp_path}/out")) if os.path.isdir(f"{tmp_path}/out") else []

    put(words[: len(words) // 2])
    assert go() == []
    put(words[len(words) // 2 :])
    put(words[20:200])
    assert go() == []
    put([("~", 0, 0, "end", 0.0, 1.0, 0.0, 1.0, start + dt.timedelta(hours=2))])
    assert go() == ["checks", "transactions"]
    batch = extract(spark.createDataFrame([w for ws in sheets.values() for w in ws], WORDS))
    for name, order in (("checks", ["doc_id", "period"]), ("transactions", ["doc_id", "period", "row_index"])):
        plain = lambda df, o=order: [r.asDict(True) for r in df.orderBy(*o).collect()]
        got, expect = documents.results(spark, f"{tmp_path}/out", name), batch[name]
        assert plain(got.select(expect.columns)) == plain(expect) and expect.count() > 2
    # Words of a closed document aren't read as one of their own.
    put([("a", 9, 999, "Beginning", 0.0, 1.0, 0.0, 1.0, start + dt.timedelta(hours=2))])
    assert go() == ["checks", "late", "transactions"]
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/out/late").collect()] == ["Beginning"]
    assert documents.results(spark, f"{tmp_path}/out", "checks").count() == 3
