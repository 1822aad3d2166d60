"""Functions and operators on small cases with known answers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.operators import diagnose, geometry, reconcile
from ledgerloom.sources import words as edges
from ledgerloom.streaming import tieout

KEY = ["k"]
PRINTED = "k int, beginning bigint, ending bigint, deposits_total bigint, withdrawals_total bigint, deposits_count bigint, withdrawals_count bigint"
ROWS = "k int, side string, cents bigint"
BASE = (100_000, 125_000, 30_000, 5_000, 2, 1)


def values(spark, column, inputs):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_money(spark):
    plus = ["1,234.56", "$1,234.56", "1234.56", "1,234.56 CR", "1,234.56CR", "  $1,234.56  "]
    minus = ["-1,234.56", "(1,234.56)", "1,234.56-", "1,234.56 DR", "1,234.56DR", "($1,234.56)", "-$1,234.56"]
    wrong = ["", "   ", "abc", "1234", "1,234.5", "1,234.567", "01/28/2025", "2025", "12.34.56", "1,234.56 XX"]
    got = values(spark, money.parse_money, plus + minus + wrong + ["12,345,678.90", "0.00"])
    assert got == [123456] * len(plus) + [-123456] * len(minus) + [None] * len(wrong) + [1234567890, 0]


def test_money_marks(spark):
    texts = ["(1,234.56) CR", "(-5.00)", "5.00 CR-", "100.00 DR", "5.00 CR", "(5.00", "5.00)", "- 5.00", "100.00 DRAFT", "-5.00-"]
    assert values(spark, money.parse_money, texts) == [-123456, -500, -500, -10000, 500, None, None, None, None, -500]
    found = lambda t: F.transform(money.find_money(t), lambda x: x["cents"])
    assert values(spark, found, ["5.00 CR-", "100.00 DRAFT", "fee 1.00DR and (2.00) CR"]) == [[-500], [-10000], [-100, -200]]


def test_find_money(spark):
    found = lambda t: F.transform(money.find_money(t), lambda x: x["cents"])
    assert values(spark, found, ["a 1.00 b (2.00) -3.00 4.00-", "é4.20 5.201 x6.00 7.00", "(8.00 and 9.00)", ""]) == [[100, -200, -300, -400], [700], [], []]


def test_dates(spark):
    got = values(spark, dates.parse_date, ["01/28/2025", "1/2/25", "2025-01-02", "2 Jan 2025", "January 2, 2025", "1-2-1999", "04/02", "29 Feb", "13/45/2025", "x", "2 Jan"])
    assert got == [dt.date(2025, 1, 28), dt.date(2025, 1, 2), dt.date(2025, 1, 2), dt.date(2025, 1, 2), dt.date(2025, 1, 2), dt.date(1999, 1, 2), dt.date(1904, 4, 2), dt.date(1904, 2, 29), None, None, dt.date(1904, 1, 2)]
    year = lambda t: dates.with_year(dates.parse_date(t), F.lit(dt.date(2024, 12, 15)))
    assert values(spark, year, ["12/20", "01/05", "02/03/2023"]) == [dt.date(2024, 12, 20), dt.date(2025, 1, 5), dt.date(2023, 2, 3)]


def test_date_spellings(spark):
    got = values(spark, dates.parse_date, ["1 April 25", "01-02-25", "February 01,2026", "DECEMBER 31, 2024:", "sept 3", "May 1 2025.", "2025-1-5", "Apr1", "31 June 2025", "1,809.28", "4/5;", ""])
    assert got == [dt.date(2025, 4, 1), None, dt.date(2026, 2, 1), dt.date(2024, 12, 31), None, dt.date(2025, 5, 1), dt.date(2025, 1, 5), None, None, None, dt.date(1904, 4, 5), None]
    lines = ["February 1,2026-February 28,2026", "from 01/02/2025 to 02/03/2025: LAST", "Apr 11 and 3 May 2025", "no date 12.5", None]
    assert values(spark, dates.find_dates, lines) == [[dt.date(2026, 2, 1), dt.date(2026, 2, 28)], [dt.date(2025, 1, 2), dt.date(2025, 2, 3)], [dt.date(1904, 4, 11), dt.date(2025, 5, 3)], [], []]


def test_scan(spark):
    from ledgerloom.functions import scan

    box = "array<struct<text:string,x0:double,x1:double>>"
    at = lambda *t: [(x, a, b) for x, a, b in t]
    rows = [
        (0, at(("01/02", 0.0, 30.0), ("1,2", 100.0, 120.0), ("34.", 121.0, 140.0), ("56", 141.0, 150.0), ("x", 160.0, 170.0))),
        (1, at(("1,234", 0.0, 30.0), ("56", 32.0, 40.0), ("9.00", 60.0, 90.0))),
        (2, at(("1,234.", 0.0, 30.0), ("56", 39.0, 50.0))),
        (3, at(("0", 0.0, 6.0), ("1-2", 7.0, 20.0), ("i", 21.0, 27.0), ("5.00", 90.0, 99.0), ("Jan", 120.0, 140.0), ("3", 144.0, 150.0))),
        (4, []),
    ]
    df = spark.createDataFrame(rows, f"i int, w {box}")
    got = df.select("i", scan.amounts(F.col("w")).alias("m"), scan.dates(F.col("w")).alias("d"), scan.is_summary(scan.amounts(F.col("w")), scan.dates(F.col("w"))).alias("s")).orderBy("i").collect()
    assert [[(m.cents, m.k) for m in r.m] for r in got] == [[(123456, 3)], [(123456, 2), (900, 1)], [], [(500, 1)], []]
    assert [[(d.date, d.k) for d in r.d] for r in got] == [[(dt.date(1904, 1, 2), 1)], [], [], [(dt.date(1904, 1, 21), 3), (dt.date(1904, 1, 3), 2)], []]
    assert [r.s for r in got] == [False, False, False, True, False]


def test_lines_take_time_in_proportion(spark):
    """Words on one height, on a slope that never breaks, and far apart."""
    words = spark.range(3000).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("string").alias("text"), (F.col("id") % 10 * 5.0).alias("x0"), (F.col("id") % 10 * 5.0 + 4).alias("x1"), (F.floor(F.col("id") / 10) * 2.0).alias("top"), F.lit(9.0).alias("height"))
    got = [r.n for r in geometry.lines(words, ["doc_id", "page"]).orderBy("line_idx").select(F.size("words").alias("n")).collect()]
    tops, lines, line = [i // 10 * 2.0 for i in range(3000)], [], []
    for t in tops:
        if line and t - sum(line) / len(line) > 3:
            lines.append(line)
            line = []
        line.append(t)
    assert got == [len(x) for x in [*lines, line]]


def test_repair_is_all_or_nothing(spark):
    from ledgerloom.operators import rows

    printed = spark.createDataFrame([(1, 0, 300, 300, 0, None, None), (2, 0, 300, 300, 0, None, None)], PRINTED)
    found = spark.createDataFrame([(1, 10, D, 100), (2, 20, D, 100)], "k int, id int, side string, cents bigint")
    edits = spark.createDataFrame([("insert", 1, 11, D, 200), ("insert", 2, 21, D, 199)], "op string, k int, id int, side string, cents bigint")
    got = {tuple(r) for r in rows.repaired(found, edits, printed, KEY, "id").collect()}
    assert got == {(1, 10, D, 100, True), (1, 11, D, 200, True), (2, 20, D, 100, False)}


def test_segment_edges(spark):
    from ledgerloom.operators import recognised

    boxes = [(0, [(0.0, 10.0), (50.0, 15.0), (50.0, 30.0), (0.0, 25.0)]), (1, [(5.0, 1.0), (5.0, 1.0), (6.0, 9.0), (5.0, 9.0)])]
    df = spark.createDataFrame(boxes, "i int, b array<struct<x:double,y:double>>")
    assert [r[0] for r in df.orderBy("i").select(recognised.rise_of(F.col("b"))).collect()] == [5.0, 0.0]
    assert values(spark, recognised.repaired, ["32/537.69", "1.234.56", "04.01.2025", "Ixonia", "|1.20", "x1.20"]) == ["32,537.69", "1,234.56", "04.01.2025", "Ixonia", "11.20", "x1.20"]


def test_text(spark):
    assert values(spark, text.tokens, ["DepositTotal:12ab **1234"]) == [["Deposit", "Total", "12", "ab", "**", "1234"]]
    assert values(spark, text.last4, ["Acct XXXX1234", "maxXX1234", "none"]) == ["1234", None, None]


def tie(spark, printed, rows):
    p = spark.createDataFrame([(1, *printed)], PRINTED)
    r = spark.createDataFrame([(1, s, c) for s, c in rows], ROWS)
    checks = diagnose.count_signature(reconcile.reconcile(p, r, KEY))
    pages = spark.createDataFrame([(1, 7, 45_000)], "k int, page int, cents bigint")
    return diagnose.diagnose(diagnose.residual_matches(checks, r, pages, KEY)).first()


D, W = "deposit", "withdrawal"
GOOD = [(D, 10_000), (D, 20_000), (W, 5_000)]


@pytest.mark.parametrize(
    ("rows", "printed", "expect"),
    [
        (GOOD, BASE, (None, None, None)),
        ([(D, 10_000), (W, 5_000)], BASE, ("dropped_row", D, 20_000)),
        ([(D, 10_000), (D, 20_000)], BASE, ("dropped_row", W, 5_000)),
        ([*GOOD, (D, 7_500)], BASE, ("duplicated_row", D, 7_500)),
        ([*GOOD, (W, 1_200)], BASE, ("duplicated_row", W, 1_200)),
        ([(W, 10_000), (D, 20_000), (W, 5_000)], BASE, ("side_flip", D, 10_000)),
        ([(D, 10_000), (D, 20_000), (D, 5_000)], BASE, ("side_flip", W, 5_000)),
        (GOOD, (*BASE[:4], 3, 1), ("zero_amount_rows", None, None)),
        ([(W, 10_000), (D, 20_000), (W, 5_000)], (*BASE[:4], None, None), ("side_flip", None, 10_000)),
        ([(D, 30_000), (D, 20_000), (W, 5_000)], (*BASE[:4], None, None), ("amount_matches_row", None, 20_000)),
        ([(D, 10_000), (W, 30_000)], (*BASE[:4], None, None), ("dropped_row", None, 45_000)),
        ([(D, 10_000), (D, 12_345), (W, 5_000)], (*BASE[:4], None, None), ("unknown", None, None)),
        (GOOD, (None,) * 6, ("no_printed_summary", None, None)),
        (GOOD, (None, None, None, None, 2, 1), ("no_transaction_evidence", None, None)),
    ],
)
def test_diagnosis(spark, rows, printed, expect):
    r = tie(spark, printed, rows)
    assert (r.diagnosis, r.diag_side, r.diag_amount) == expect and r.reconciled == (expect[0] is None)


def test_one_cent_fails(spark):
    r = tie(spark, BASE, [(D, 10_001), (D, 20_000), (W, 5_000)])
    assert not r.reconciled and r.residual == 1 and r.check_printed_block_closes == "ok"


def test_one_wrong_row_is_named(spark):
    """Any single error in a period that closes is named by its signature."""
    rng = random.Random(4)
    cases = []
    for k in range(60):
        rows = [(rng.choice([D, W]), c) for c in rng.sample(range(100, 99_999), rng.randint(2, 12))]
        dep, wd = sum(c for s, c in rows if s == D), sum(c for s, c in rows if s == W)
        printed = (1_000, 1_000 + dep - wd, dep, wd, sum(s == D for s, _ in rows), sum(s == W for s, _ in rows))
        at, kind = rng.randrange(len(rows)), rng.choice(["dropped_row", "duplicated_row", "side_flip"])
        side, cents = rows[at]
        seen = list(rows)
        if kind == "dropped_row":
            seen.pop(at)
        elif kind == "duplicated_row":
            seen.append(rows[at])
        else:
            seen[at] = (W if side == D else D, cents)
        cases.append((k, printed, seen, (kind, side, float(cents))))
    p = spark.createDataFrame([(k, *x) for k, x, _, _ in cases], PRINTED)
    r = spark.createDataFrame([(k, s, c) for k, _, rows, _ in cases for s, c in rows], ROWS)
    got = diagnose.count_signature(reconcile.reconcile(p, r, KEY)).collect()
    assert {x.k: (x.sig_kind, x.sig_side, x.sig_amount) for x in got} == {k: e for k, _, _, e in cases}


WORD = "page int, text string, x0 double, x1 double, top double, height double"


def test_lines_follow_the_mean(spark):
    tops = [100.0, 102.9, 104.3, 112.0]
    page = spark.createDataFrame([(1, f"w{i}", 50.0 - 10 * i, 55.0 - 10 * i, t, 10.0) for i, t in enumerate(tops)], WORD)
    got = {r.line_idx: r.text for r in geometry.lines(page, ["page"]).collect()}
    assert got == {0: "w2 w1 w0", 1: "w3"}


def test_columns(spark):
    cells = [(1, float(x), float(x) + 30, r) for r, x in enumerate([400, 401, 400, 300, 301])]
    df = spark.createDataFrame(cells, "page int, x0 double, x1 double, row int").withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    found = geometry.columns(geometry.gap_clusters(df, ["page"], "c"), ["page"], "row").orderBy("x0").collect()
    assert [(r.x0, r.x1, r.n_rows) for r in found] == [(298.0, 333.0, 2), (398.0, 433.0, 3)]


def test_skew_is_undone(spark):
    rows = [(1, "w", x, x + 5.0, 100.0 + 12 * r + x * 0.02, 8.0) for r in range(8) for x in (30.0, 130.0, 230.0, 330.0, 430.0)]
    page = spark.createDataFrame(rows, WORD)
    slopes = F.transform(F.sequence(F.lit(-6), F.lit(6)), lambda i: i / 100)
    found = geometry.best_slope(geometry.sharpness(page, ["page"], slopes), ["page"]).first().slope
    assert found == pytest.approx(0.02)
    flat = geometry.deskew(page, F.lit(found)).groupBy(F.round("top")).count().count()
    assert flat <= 9


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=7 * i), 100 + i, D if i % 3 else W) for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, cents long, side string")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = tieout.run_once(stream, "weekly", str(tmp_path / "state")).collect()
    expect = batch.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("period"), "side").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expect))


def test_edges(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    assert [r.problem for r in edges.document_bytes(spark, str(tmp_path)).collect()] == [None, "not_pdf"]
    assert tie(spark, BASE, GOOD).reconciled
    p = spark.createDataFrame([(1, *BASE)], PRINTED)
    checks = reconcile.reconcile(p, spark.createDataFrame([(1, s, c) for s, c in GOOD], ROWS), KEY).withColumn("diagnosis", F.lit(None).cast("string"))
    assert checks.agg(edges.exit_code(checks)).first()[0] == 0
    assert edges.report_lines(checks, KEY).first().line == "1 ++++++ 0.00"
    assert '"reconciled":true' in edges.log_lines(checks, KEY).first().line


def test_dates_behind_leaders_and_blanks(spark):
    """Marks and blanks don't count towards a date's length; other text does."""
    from ledgerloom.functions import dates, scan

    said = [("March 5, 2024" + "." * 60, 1), ("September   5,      2024" + " " * 40, 1), ("03/05/2024" + ";" * 50 + " and 04/05/2024:", 2), ("x" * 100_000 + " 03/05/2024", 1), ("7" * 1000, 0), (" 03/05/2024 ", 1)]
    rows = spark.createDataFrame(said, "t string, n int").select("n", F.size(dates.find_dates(F.col("t"))).alias("found"), dates.parse_date(F.col("t")).alias("d")).collect()
    assert [r.found for r in rows] == [n for _, n in said] and [r.d is not None for r in rows] == [True, True, False, False, False, True]
    boxes = spark.createDataFrame([([("September", 0.0, 50.0), ("5,", 54.0, 60.0), ("2024" + "." * 30, 64.0, 300.0)],)], "w array<struct<text string, x0 double, x1 double>>")
    assert str(boxes.select(scan.date_at(F.col("w"), F.lit(0))["date"]).first()[0]) == "2024-09-05"
