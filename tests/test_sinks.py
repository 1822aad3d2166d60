"""Requests, sinks with observed counts, invariants, exception lists, stated periods."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation, requests
from ledgerloom.plans.extract import extract
from ledgerloom.sources import results as sinks
from ledgerloom.sources import words as edges
from tests.test_extract import WORDS, Sheet, statement

ASKED = "k int, request int, kind string, amount string, first int, until int, number int"


def test_requests(spark):
    rows = spark.createDataFrame([(1, i, f"2025-01-{i + 1:02d}", f"ROW {i}", ("deposit", "withdrawal")[i % 2], 100 + i % 3) for i in range(30)], "k int, row_index int, date string, description string, side string, cents long")
    checks = spark.createDataFrame([(1, False, 7, 15, 15)], "k int, reconciled boolean, residual long, dep_n long, wd_n long")
    shown = spark.createDataFrame([(1, 1, -101), (1, 3, 101), (1, 3, 101), (1, 2, 999), (2, 1, 101)], "k int, page int, cents long")
    pages = spark.createDataFrame([(1, 3, "one 1.01\ntwo")], "k int, page int, text string")
    data = [
        (1, 0, "state", None, None, None, None), (2, 1, "state", None, None, None, None), (1, 2, "find_amount", "(1.01)", None, None, None), (1, 3, "find_amount", "9.99", None, None, None), (1, 4, "find_amount", "1.00", None, None, None),
        (1, 5, "find_amount", "5.55", None, None, None), (1, 6, "find_amount", "lots", None, None, None), (1, 7, "list_rows", None, None, None, None), (1, 8, "list_rows", None, 28, 40, None), (1, 9, "list_rows", None, 30, None, None),
        (1, 10, "list_rows", None, 5, 5, None), (1, 11, "read_page", None, None, None, 3), (1, 12, "read_page", None, None, None, 9), (1, 13, "dance", None, None, None, None), (1, 13, None, None, None, None, None),
    ]
    got = {(r.request, r.kind): r for r in requests.answers(spark.createDataFrame(data, ASKED), checks, rows, shown, pages, ["k"]).collect()}
    assert len(got) == len(data)
    at = lambda i: next(r for k, r in got.items() if k[0] == i)
    assert (at(0).reconciled, at(0).residual, at(0).n_rows, at(0).note) == (False, 7, 30, None) and at(1).note == "no such period"
    assert at(2).on_pages == [1, 3] and at(2).row_indexes == list(range(1, 30, 3)) and at(2).note is None
    assert (at(3).on_pages, at(3).row_indexes, at(3).note) == ([2], [], "on a page, in no row")
    assert at(4).note == "in a row, on no page" and at(5).note == "nowhere" and at(6).note == "not an amount"
    assert at(7).row_indexes == list(range(20)) and at(7).lines[0] == "[0] 2025-01-01 ROW 0 deposit 1.00"
    assert at(8).row_indexes == [28, 29] and at(9).note == at(10).note == "no rows there"
    assert at(11).lines == ["one 1.01", "two"] and at(12).note == "no such page" and at(13).note == "unknown request"


@pytest.fixture(scope="module")
def read(spark):
    words = statement("ties", "two_columns", 1)[0] + statement("lost", "signed", 2, lose=4)[0] + statement("bare", "sections", 3, counts=False)[0]
    return {k: v.cache() for k, v in extract(spark.createDataFrame(words, WORDS).repartition(3)).items()}


def test_written_results_tell_their_counts(spark, read, tmp_path):
    path = str(tmp_path / "json")
    told = sinks.write_results(read, path)
    assert told == {"documents": 3, "periods": 3, "reconciled": 2, "rows": 41, "recovered": 0, "warnings": 0, "exit_code": 1}
    objects = [json.loads(line) for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert {o["doc_id"]: len(o["periods"][0]["transactions"]) for o in objects} == {"ties": 14, "lost": 13, "bare": 14}
    nothing = {k: v.where("false") for k, v in read.items()}
    assert sinks.write_results(nothing, str(tmp_path / "none"))["exit_code"] == 2
    closed = {k: v.where("doc_id <> 'lost'") for k, v in read.items()}
    assert sinks.write_results(closed, path)["exit_code"] == 0


def test_text_report(spark, read):
    warned = spark.createDataFrame([("lost", 0, "zero_amount", 2), ("lost", 0, "amount_from_balance", 1)], "doc_id string, period int, warning string, n long")
    text = {r.doc_id: r.text for r in sinks.text_reports(read | {"warnings": warned}).collect()}
    assert text["ties"].split("\n")[0] == "ties" and "period 1: reconciled" in text["ties"] and "warning" not in text["ties"]
    assert "period 1: DID NOT RECONCILE" in text["lost"] and "FAIL  balance_equation" in text["lost"] and "account 6426" in text["lost"]
    assert text["lost"].endswith("warning: period 1, amount_from_balance (1)\nwarning: period 1, zero_amount (2)")
    assert "  --  deposits_count" in text["bare"]


def test_exceptions_begin_with_the_residual(spark, read):
    from ledgerloom.operators import audit

    doubts = spark.createDataFrame([("lost", 0, "amount_from_balance", "vouch_amount", 5, 3), ("lost", 0, "zero_amount", "confirm_no_amount", None, None), ("ties", 0, "date_from_row_before", "confirm_date", 9, 1)], "doc_id string, period int, kind string, action string, amount long, page int")
    checks = read["checks"].withColumn("detail", F.when(F.col("doc_id") == "lost", F.lit("9.00 on page 12 may not have been read")))
    got = audit.exceptions(checks, doubts).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position, r.action, r.page) for r in got] == [("lost", 1, "inspect_page", 12), ("lost", 2, "vouch_amount", 3), ("lost", 3, "confirm_no_amount", None), ("ties", 1, "confirm_date", 1)]
    files = {r.doc_id: (r.verdict, r.n_exceptions) for r in read["files"].collect()}
    assert files == {"ties": ("tied", 0), "lost": ("exceptions_identified", 1), "bare": ("tied_with_notes", 0)}


def test_invariants_and_evaluation(spark, read, tmp_path):
    none = evaluation.invariants(read["transactions"], read["checks"], read["files"], ["doc_id"], ["period"])
    assert none.collect() == []
    bad = read["transactions"].withColumn("cents", F.when((F.col("doc_id") == "ties") & (F.col("row_index") == 1), 0).otherwise(F.col("cents")))
    fewer = read["checks"].withColumn("dep_n", F.when(F.col("doc_id") == "bare", F.col("dep_n") + 1).otherwise(F.col("dep_n")))
    other = read["files"].withColumn("ending", F.when(F.col("doc_id") == "lost", F.lit(None)).otherwise(F.col("ending")))
    broken = evaluation.invariants(bad, fewer, other, ["doc_id"], ["period"])
    assert {(r.doc_id, r.kind, r.n) for r in broken.collect()} == {("ties", "row_without_one_positive_side", 1), ("bare", "counts_disagree_with_rows", 1), ("lost", "file_differs_from_its_period", 1)}
    figures = ["beginning", "ending"]
    truth = read["checks"].select("doc_id", "period", *figures)
    report = evaluation.report(truth, read["checks"], ["doc_id"], ["period"], figures, broken.where("doc_id = 'ties'"))
    assert {r.doc_id: r.status for r in report.collect()} == {"ties": "fail", "lost": "reported", "bare": "pass"}
    told = sinks.write_evaluation(report, str(tmp_path / "report"))
    assert told == {"files": 3, "passed": 1, "failed": 1, "exit_code": 1}
    assert spark.read.json(str(tmp_path / "report")).count() == 3
    assert sinks.write_evaluation(report.where("false"), str(tmp_path / "report"))["exit_code"] == 2


def test_first_labelled_line_tells_the_period(spark):
    from ledgerloom.functions.money import find_money
    from ledgerloom.plans.extract import page_anchors

    pages = {1: ["Statement date 03/31/2025", "For the period 01/01/2024 to 02/01/2024"], 2: ["Statement period", "Statement period 01/01/2024 to 02/01/2024", "Statement date 03/31/2025"]}
    rows = [("d", p, i, t, False) for p, texts in pages.items() for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string, dated boolean").withColumn("money", find_money(F.col("text")))
    got = {r.page: (r.cycle.start and str(r.cycle.start), str(r.cycle.end)) for r in page_anchors(lines).collect()}
    assert got == {1: (None, "2025-03-31"), 2: ("2024-01-01", "2024-02-01")}


def test_pages_are_put_together_by_lines(spark):
    s = Sheet("d", 1)
    s.line(("left", 30.0), ("right", 200.0))
    s.line(("below", 30.0))
    # A word set a little lower than its line comes where the line has it.
    words = [(*w[:5], w[5] + (1.0 if w[2] == "left" else 0.0), w[6]) for w in s.words]
    assert edges.pages_of(spark.createDataFrame(words, WORDS)).first().text == "left right\nbelow"
