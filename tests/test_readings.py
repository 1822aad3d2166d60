"""Pages that show a column once, and listings that repeat a table which lost a row."""

from __future__ import annotations

from datetime import datetime, timedelta

import __spark_entry__
from ledgerloom.plans import extract

from .compare import both


def band(a, b):
    return (float(a), float(b))


def test_layout_of_the_balance_alone_goes_behind_one_of_its_columns_and_more(spark):
    shape = "doc_id string, period int, candidate int, amount_columns array<struct<x0: double, x1: double>>, balance_column struct<x0: double, x1: double>, strategy string"
    narrow, wide, balance = [band(428, 472)], [band(350, 382), band(420, 472)], band(508, 562)
    rows = [
        ("once", 0, 1, narrow, balance, "balance_delta"), ("once", 0, 3, wide, balance, "two_columns"),
        ("elsewhere", 0, 1, [band(100, 140)], balance, "balance_delta"), ("elsewhere", 0, 2, wide, balance, "two_columns"),
        ("signed", 0, 1, narrow, balance, "signed"), ("signed", 0, 2, wide, balance, "two_columns"),
        ("bare", 0, 1, narrow, balance, "balance_delta"), ("bare", 0, 2, wide, None, "two_columns"),
        ("alone", 0, 2, narrow, balance, "balance_delta"), ("alone", 1, 1, wide, balance, "two_columns"),
    ]
    out = extract.wider_first(spark.createDataFrame(rows, shape))
    got = {(r.doc_id, r.period, r.candidate): r.strategy for r in out.collect()}
    assert got == {
        ("once", 0, 1): "two_columns", ("once", 0, 3): "balance_delta", ("elsewhere", 0, 1): "balance_delta", ("elsewhere", 0, 2): "two_columns",
        ("signed", 0, 1): "signed", ("signed", 0, 2): "two_columns", ("bare", 0, 1): "balance_delta", ("bare", 0, 2): "two_columns",
        ("alone", 0, 2): "balance_delta", ("alone", 1, 1): "two_columns",
    }


def test_listing_that_repeats_the_table_stays_out_of_a_period_that_is_open_anyway(spark):
    found = "doc_id string, period int, candidate int, variant int, date string, side string, cents long"
    table = [("a", "d1", 500), ("a", "d1", 500), ("a", "d2", 700), ("b", "d1", 500), ("c", "d1", 500)]
    listing = [("a", "d1", 500), ("a", "d2", 700), ("b", "d1", 500), ("b", "d1", 500), ("c", "d3", 500)]
    rows = [(d, 0, 1, v, day, "withdrawal", cents) for v in (0, 1) for d, day, cents in table]
    sided = spark.createDataFrame([(d, 0, day, "withdrawal", cents) for d, day, cents in listing], "doc_id string, period int, date string, side string, cents long")
    tried = spark.createDataFrame([(d, 0, 1) for d in "abc"], "doc_id string, period int, candidate int")
    repeats = extract._repeating(spark.createDataFrame(rows, found), sided, tried)
    assert {r.doc_id: r.repeats for r in repeats.collect()} == {"a": True, "b": False, "c": False}
    tries = "doc_id string, period int, candidate int, variant int, reconciled boolean, n_ok int, n_recovered long, residual long, repeats boolean"
    attempts = [
        ("a", 0, 1, 0, False, 3, 0, 900, False), ("a", 0, 1, 1, False, 3, 0, -300, True),
        ("b", 0, 1, 0, False, 3, 0, 900, False), ("b", 0, 1, 1, False, 3, 0, -300, False),
        ("c", 0, 1, 0, False, 3, 0, 900, False), ("c", 0, 1, 1, True, 6, 0, 0, True),
    ]
    best = extract._best(spark.createDataFrame(attempts, tries))
    assert {r.doc_id: r.variant for r in best.collect()} == {"a": 0, "b": 1, "c": 1}


def test_repair_starts_from_the_table_alone_where_its_listing_repeats(spark, tmp_path):
    # Sections with a listing that repeats the table; the row lost is dearer than half of
    # the listing, so with the listing's rows the residual would be the smaller one.
    start, rows = datetime(2024, 1, 1, 9), []
    for account in (6, 182, 270, 358):  # turns: the row at once, a wrong amount, none, wrong and dropped again
        for i in range(58):
            paid, last = i % 3 == 0, i == 57
            rows.append((account * 1000 + i, start + timedelta(hours=12 * i), account, "purchase" if paid and not last else "view", 900.5 if last else 20.25 + i, "{}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    names, mine, sql_names, sql = both(spark, __spark_entry__.queries()["extract_repaired"], __spark_entry__.oracle_sql()["extract_repaired"], str(tmp_path))
    assert names == sql_names and mine == sql
    at = {n: i for i, n in enumerate(names)}
    assert {(r[at["doc_id"]], r[at["path"]], r[at["calls"]], r[at["n_edits"]]) for r in sql if r[at["period"]] == "1"} == {("6", "repaired", "2", "1"), ("182", "deterministic", "1", None), ("270", "deterministic", "1", None), ("358", "repaired", "3", "3")}


def test_column_that_no_page_shows_twice_is_read_of_all_pages_together(spark, tmp_path):
    # Two amount columns; a page has one dated deposit, one has an undated one too.
    plain = (i for i in range(12_000, 13_000) if i % 37 != 5 and i % 41 != 7 and i % 23 != 4 and i % 29 != 3)
    undated = next(i for i in range(12_000, 13_000) if i % 41 == 7 and i % 37 != 5 and i % 23 != 4 and i % 29 != 3)
    rows = []
    for page, said in enumerate(("dwwwuww", "wdwww")):
        for n, kind in enumerate(said):
            rows.append((undated if kind == "u" else next(plain), datetime(2024, 1, 2 + 7 * page, 9 + n), 12, "view" if kind == "w" else "purchase", 33.25 + 7 * n, "{}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    names, mine, sql_names, sql = both(spark, __spark_entry__.queries()["extract_repaired"], __spark_entry__.oracle_sql()["extract_repaired"], str(tmp_path))
    assert names == sql_names and mine == sql and len(sql) == 1


def event_ids(account, **wanted):
    """Event ids of an account that set rows as wanted: undated, split, listed; else whole and dated."""
    for i in range(account * 1000, account * 1000 + 1000):
        said = {"no_amount": i % 37 == 5, "undated": i % 41 == 7, "split": i % 23 == 4, "wraps": i % 29 == 3, "listed": i % 3 == 0}
        if all(v == wanted.get(k, False) for k, v in said.items()):
            yield i


def test_what_one_page_does_not_show_is_read_of_its_periods_other_pages(spark, tmp_path):
    # d, w: deposit, withdrawal; D: undated deposit, s: deposit in two boxes, L: withdrawal that only a listing has.
    said = {
        12: ("Dwwwww", "dwwww"),  # two columns: one deposit is dated, the other stands before the first dated row
        24: ("dwwwww", "swwww"),  # one deposit stands in two boxes
        21: ("dddddd", "ddww"),  # signed: the densest page shows no sign
        10: ("dddddLL", "dddww"),  # sections: the densest page calls withdrawals by its listing's heading
    }
    rows = []
    for account, pages in said.items():
        ids = {k: event_ids(account, **v) for k, v in {"d": {}, "D": {"undated": True}, "s": {"split": True}, "L": {"listed": True}}.items()}
        for page, kinds in enumerate(pages):
            for n, kind in enumerate(kinds):
                rows.append((next(ids["d" if kind == "w" else kind]), datetime(2024, 1, 2 + 7 * page, 9 + n), account, "view" if kind in "wL" else "purchase", 33.25 + 7 * n + page, "{}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for query in ("extract_transactions", "extract_checks", "extract_audit", "extract_warnings", "extract_layouts", "extract_frontier"):
        names, mine, sql_names, sql = both(spark, __spark_entry__.queries()[query], __spark_entry__.oracle_sql()[query], str(tmp_path))
        assert names == sql_names and mine == sql, query


def test_what_stands_below_a_table_goes_below_a_long_one_and_counts_may_pass_999(spark, tmp_path):
    start, rows = datetime(2024, 1, 1, 1), []
    for account, n in ((13, 160), (2, 180), (6, 170), (20, 1100)):  # a line of dates, a listing alone, one that repeats, counts
        rows += [(account * 10_000 + i, start + timedelta(minutes=5 * i), account, "view" if i % 11 == 5 or (account < 20 and i % 3) else "purchase", 20.25 + i % 97, "{}") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for query in ("extract_transactions", "extract_checks", "extract_warnings", "extract_header"):
        names, mine, sql_names, sql = both(spark, __spark_entry__.queries()[query], __spark_entry__.oracle_sql()[query], str(tmp_path))
        assert names == sql_names and mine == sql, query
