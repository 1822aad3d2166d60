"""Bounded repair against a plain replay of the turns, one edit after another."""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile, repair
from ledgerloom.plans.extract import extract
from tests.test_extract import WORDS, statement

ROWS = "doc_id string, period int, row_index int, side string, cents long, date date, description string, page int"
PRINTED = "doc_id string, period int, beginning long, ending long, deposits_total long, withdrawals_total long, deposits_count long, withdrawals_count long"
TURNS = "doc_id string, period int, turn int, tokens_in long, tokens_out long, calls array<struct<name string, arguments string>>"
SIDES = ("deposit", "withdrawal")
PRICES = (1.0, 2.0)


def closes(printed, rows):
    b, e, d, w, nd, nw = printed
    sums = {s: sum(r[1] for r in rows if r[0] == s) for s in SIDES}
    n = {s: sum(r[0] == s for r in rows) for s in SIDES}
    return b + sums["deposit"] - sums["withdrawal"] == e and (sums["deposit"], sums["withdrawal"], n["deposit"], n["withdrawal"]) == (d, w, nd, nw) and b + d - w == e


def apply(rows, name, raw):
    """Whether the call was an edit with effect."""
    try:
        a = json.loads(raw or "{}")
    except ValueError:
        a = {}
    if sorted(a) != repair.ARGUMENTS.get(name):
        return False
    if name != "insert_row" and not (isinstance(a["index"], int) and 0 <= a["index"] < len(rows)):
        return False
    if name != "drop_row" and a["side"] not in SIDES:
        return False
    if name == "drop_row":
        rows.pop(a["index"])
    elif name == "set_side":
        rows[a["index"]] = (a["side"], *rows[a["index"]][1:])
    else:
        m = re.fullmatch(r"(\d+)\.(\d\d)", a["amount"])
        if not m or not re.fullmatch(r"\d{4}-\d\d-\d\d", a["when"]) or a["when"].endswith("-99") or int(m[1] + m[2]) == 0:
            return False
        rows.append((a["side"], int(m[1] + m[2]), a["description"]))
    return True


def replay(docs, budget):
    """docs: doc -> [(period, printed, rows, turns)] in order; -> period -> (rows, edits or None, turns taken)."""
    out = {}
    for doc, periods in docs.items():
        spent = 0.0
        for period, printed, rows, turns in periods:
            now, edits, taken, closed = list(rows), 0, 0, False
            for tin, tout, calls in turns[: repair.TURNS]:
                if spent >= budget:
                    break
                taken += 1
                spent += (tin * PRICES[0] + tout * PRICES[1]) / 1_000_000
                if not calls:
                    break
                edits += sum(apply(now, *c) for c in calls)
                closed = closes(printed, now)
                if closed:
                    break
            out[doc, period] = (now if closed else rows, edits if closed else None, taken)
    return out


def random_docs(rng):
    docs = defaultdict(list)
    for d in range(60):
        for period in range(rng.randrange(1, 4)):
            truth = [(rng.choice(SIDES), rng.randrange(100, 400), f"R{i}") for i in range(rng.randrange(1, 7))]
            sums = {s: sum(r[1] for r in truth if r[0] == s) for s in SIDES}
            printed = (1000, 1000 + sums["deposit"] - sums["withdrawal"], sums["deposit"], sums["withdrawal"], sum(r[0] == "deposit" for r in truth), sum(r[0] == "withdrawal" for r in truth))
            rows, gone = list(truth), truth[0]
            what = rng.randrange(3)
            if what == 0:
                rows.pop(0)
            elif what == 1:
                rows.insert(0, gone)
            else:
                rows[0] = (SIDES[gone[0] == "deposit"], *gone[1:])
            insert = lambda c, s: ("insert_row", json.dumps({"when": "2025-01-02", "description": "NEW", "side": s, "amount": f"{c // 100}.{c % 100:02d}"}))
            fix = [insert(gone[1], gone[0]), ("drop_row", '{"index": 0}'), ("set_side", json.dumps({"index": 0, "side": gone[0]}))][what]
            noise = [insert(7, "deposit"), ("drop_row", json.dumps({"index": len(rows)})), ("drop_row", '{"index": -1}'), ("set_side", '{"index": 0}'), ("set_side", '{"index": 0, "side": "up"}'), ("insert_row", "{no json"), ("insert_row", json.dumps({"when": "2025-01-99", "description": "x", "side": "deposit", "amount": "1.00"})), insert(0, "deposit"), ("list_rows", '{"start": 0}'), ("drop_row", '{"index": 0, "why": 1}'), ("drop_row", None)]
            turns = []
            for _ in range(rng.randrange(0, 15)):
                calls = [rng.choice(noise) for _ in range(rng.randrange(0 if rng.random() < 0.2 else 1, 4))]
                if rng.random() < 0.3:
                    calls.append(("drop_row", json.dumps({"index": rng.randrange(len(rows) + 2)})))
                turns.append((rng.choice([0, 10_000, 90_000]), rng.choice([0, 5_000]), calls))
            if rng.random() < 0.7:
                # What a wrong first try put in goes again, then the right edit comes.
                turns = [(10_000, 100, [insert(7, "withdrawal")]), (20_000, 100, [("drop_row", json.dumps({"index": len(rows)})), fix]), *turns] if rng.random() < 0.5 else [(60_000, 0, [("state", "{}")]), (1_000, 0, [fix]), *turns]
            docs[f"d{d}"].append((period, printed, rows, turns))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_replay(spark, seed):
    docs, budget = random_docs(random.Random(seed)), 0.25
    expect = replay(docs, budget)
    flat = [(d, *p) for d, ps in docs.items() for p in ps]
    rows = spark.createDataFrame([(d, p, i, s, c, None, t, 1) for d, p, _, rs, _ in flat for i, (s, c, t) in enumerate(rs)], ROWS).repartition(3)
    printed = spark.createDataFrame([(d, p, *x) for d, p, x, _, _ in flat], PRINTED)
    turns = spark.createDataFrame([(d, p, 10 * k, i, o, c) for d, p, _, _, ts in flat for k, (i, o, c) in enumerate(ts)], TURNS).repartition(3)
    failed = reconcile.reconcile(printed, rows, repair.PERIOD)
    assert failed.where("reconciled").count() == 0
    counts = rows.groupBy(*repair.PERIOD).agg(F.count(F.lit(1)).alias("n"))
    taking = repair.numbered(turns).cache()
    located = repair.placed(repair.edits_of(taking), counts).cache()
    played = repair.outcome(taking, located, rows, failed, PRICES, budget).cache()
    taken = {(r.doc_id, r.period): r["count"] for r in played.where("taken").groupBy(*repair.PERIOD).count().collect()}
    assert taken == {k: v[2] for k, v in expect.items() if v[2]}
    closed = played.where("closes").select(*repair.PERIOD, F.col("turn").alias("upto"), "n_edits")
    assert {(r.doc_id, r.period): r.n_edits for r in closed.collect()} == {k: v[1] for k, v in expect.items() if v[1] is not None}
    got = defaultdict(list)
    for r in repair.edited(rows, located, closed).orderBy("doc_id", "period", "row_index").collect():
        assert r.row_index == len(got[r.doc_id, r.period])
        got[r.doc_id, r.period].append((r.side, r.cents, r.description))
    mended = {k: v[0] for k, v in expect.items() if v[1] is not None}
    assert dict(got) == {k: v for k, v in mended.items() if v} and 20 < len(mended) < len(expect)


def test_end_to_end(spark):
    """The lost row comes back; a budget that earlier turns took, a turn without calls
    and edits that don't close leave the rows as they were read."""
    sheets, lost = [], {}
    for doc in ("mended", "wrong", "dear", "ended", "whole"):
        words, rows = statement(doc, "two_columns", 9, lose=None if doc == "whole" else 5)
        sheets += words
        lost[doc] = rows[5]
    day, side, cents = lost["mended"]
    put = lambda c: ("insert_row", json.dumps({"when": f"2025-04-{day}", "description": "FOUND", "side": side, "amount": f"{c / 100:,.2f}"}))
    turns = [("mended", 0, 1, 100, 10, [put(cents + 1)]), ("mended", 0, 2, 100, 10, [("drop_row", '{"index": 13}'), put(cents)]), ("mended", 0, 3, 100, 10, [put(5)]), ("wrong", 0, 1, 100, 10, [put(cents + 1)]), ("dear", 0, 1, 10_000_000, 0, [("state", "{}")]), ("dear", 0, 2, 1, 1, [put(cents)]), ("ended", 0, 1, 1, 1, []), ("ended", 0, 2, 1, 1, [put(cents)]), ("whole", 0, 1, 1, 1, [("drop_row", '{"index": 0}')])]
    out = extract(spark.createDataFrame(sheets, WORDS).repartition(3), turns=spark.createDataFrame(turns, TURNS), prices=PRICES)
    checks = {r.doc_id: r for r in out["checks"].collect()}
    assert {k: r.path for k, r in checks.items()} == {"mended": "repaired", "wrong": "deterministic", "dear": "deterministic", "ended": "deterministic", "whole": "deterministic"}
    assert {k for k, r in checks.items() if r.reconciled} == {"mended", "whole"}
    assert checks["mended"].n_ok == 6 and checks["mended"].residual == 0 and checks["mended"].diagnosis is None
    assert checks["wrong"].diagnosis == "row_level_break" and checks["wrong"].dep_n + checks["wrong"].wd_n == 13
    found = out["transactions"].where("doc_id = 'mended'").orderBy("row_index").collect()
    assert [r.row_index for r in found] == list(range(14)) and (found[-1].description, found[-1].side, found[-1].cents, found[-1].page) == ("FOUND", side, cents, None)
    assert [(r.doc_id, r.n) for r in out["warnings"].where("warning = 'rows_repaired'").collect()] == [("mended", 3)]
    assert {r.doc_id: (r.calls, r.tokens_in) for r in out["usage"].collect()} == {"mended": (2, 200), "wrong": (1, 100), "dear": (1, 10_000_000), "ended": (1, 1)}


def test_frontier(spark):
    """A period closed under its first layout is read under no other; one that isn't
    closed is read under all it has, with the same end as if all had been read."""
    words = [w for doc, lose in (("ties", None), ("fails", 5)) for p, seed in ((1, 9), (2, 30)) for w in _page(doc, p, seed, lose)]
    out = extract(spark.createDataFrame(words, WORDS).repartition(2))
    n = {(r.doc_id, r.period): r["count"] for r in out["layouts"].groupBy("doc_id", "period").count().collect()}
    assert n == {("ties", 0): 2, ("fails", 0): 2}
    tried = {r.doc_id: (r["n"], r["last"]) for r in out["attempts"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("candidate").alias("last")).collect()}
    assert tried == {"ties": (1, 1), "fails": (2, 2)}


def _page(doc, page, seed, lose):
    """Two pages of one period; the second's columns stand elsewhere, so it has a layout of its own."""
    from tests.test_extract import Sheet, show

    rng = random.Random(7)
    rows = [(rng.choice(SIDES), rng.randint(1_000, 99_999)) for _ in range(14)]
    s = Sheet(doc, page)
    sums = {x: sum(c for s, c in rows if s == x) for x in SIDES}
    if page == 1:
        for text in ("Statement period 04/01/2025 through 04/30/2025", "Beginning balance 1,000.00", f"Total deposits {show(sums['deposit'])}", f"Total withdrawals {show(sums['withdrawal'])}", f"Ending balance {show(100_000 + sums['deposit'] - sums['withdrawal'])}"):
            s.line((text,))
    s.top += 12
    for i, (side, cents) in list(enumerate(rows))[(page - 1) * 9 : 9 if page == 1 else 14]:
        if i != lose:
            s.line((f"04/{1 + i:02d}/2025", 30.0), (f"PAYMENT {i}", 100.0), (show(cents), 0, (380.0 if side == "deposit" else 470.0) + (page - 1) * 4))
    return s.words
