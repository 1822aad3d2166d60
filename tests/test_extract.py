"""Whole statements, set as words at fixed places, from words to tie-out."""

from __future__ import annotations

import random

import pytest

from ledgerloom.plans.extract import extract, nested

CHAR, GAP = 6.0, 4.0
WORDS = "doc_id string, page int, text string, x0 double, x1 double, top double, height double"


class Sheet:
    def __init__(self, doc, page):
        self.doc, self.page, self.top, self.words = doc, page, 40.0, []

    def put(self, text, x0=30.0, right=None):
        if right is not None:
            x0 = right - sum(len(w) * CHAR + GAP for w in text.split()) + GAP
        for w in text.split():
            self.words.append((self.doc, self.page, w, x0, x0 + len(w) * CHAR, self.top, 10.0))
            x0 += len(w) * CHAR + GAP

    def line(self, *cells):
        for c in cells:
            self.put(c[0], *c[1:])
        self.top += 12.0


def show(cents):
    return f"{'-' if cents < 0 else ''}{abs(cents) // 100:,}.{abs(cents) % 100:02d}"


def statement(doc, kind, seed, page=1, opening=100_000, n=14, lose=None, counts=True):
    rng = random.Random(seed)
    rows = [(f"{1 + i // 2:02d}", rng.choice(["deposit", "withdrawal"]), rng.randint(1_000, 99_999)) for i in range(n)]
    rows[0], rows[1] = ("01", "deposit", 50_000), ("01", "withdrawal", 1_234)
    if kind == "sections":
        rows.sort(key=lambda r: r[1])
    dep, wd = [sum(c for _, s, c in rows if s == x) for x in ("deposit", "withdrawal")]
    nd, nw = [sum(s == x for _, s, _ in rows) for x in ("deposit", "withdrawal")]
    s = Sheet(doc, page)
    s.line(("Statement period 04/01/2025 through 04/30/2025",))
    s.line(("Account XXXX6426",))
    s.line((f"Beginning balance {show(opening)}",))
    s.line((f"{nd} " * counts + f"Total deposits {show(dep)}",))
    s.line((f"{nw} " * counts + f"Total withdrawals {show(wd)}",))
    s.line((f"Ending balance {show(opening + dep - wd)}",))
    s.top += 12
    balance, last = opening, None
    for i, (day, side, cents) in enumerate(rows):
        balance += cents if side == "deposit" else -cents
        if i == lose:
            continue
        if kind == "sections" and side != last:
            s.line(("Deposits and credits" if side == "deposit" else "Withdrawals and debits",))
            last = side
        cells = [(f"04/{day}/2025", 30.0), (f"PAYMENT {i}", 100.0)]
        if kind == "two_columns":
            cells += [(show(cents), 0, 380.0 if side == "deposit" else 470.0), (show(balance), 0, 560.0)]
        elif kind == "signed":
            cells += [(show(cents if side == "deposit" else -cents), 0, 400.0), (show(balance), 0, 560.0)]
        elif kind == "sections":
            cells += [(show(cents), 0, 400.0)]
        else:
            cells += [(show(cents), 0, 400.0), (show(balance), 0, 560.0)]
        s.line(*cells)
        if i == 2:
            s.line(("CONTINUED HERE", 100.0))
    return s.words, rows


def run(spark, *sheets):
    words = [w for s in sheets for w in s]
    return extract(spark.createDataFrame(words, WORDS).repartition(3))


@pytest.fixture(scope="module")
def results(spark):
    sheets = [statement(k, k, i)[0] for i, k in enumerate(("two_columns", "signed", "sections", "balance_delta"))]
    sheets.append(statement("lost", "two_columns", 9, lose=5)[0])
    # A beginning balance on every page would be a running header, not a start.
    notes = Sheet("binder", 2)
    notes.line(("Nothing else this month",))
    two = [statement("binder", "two_columns", 20 + p, page=p)[0] for p in (1, 3)] + [notes.words]
    return {k: v.cache() for k, v in run(spark, *sheets, *two).items()}


@pytest.mark.parametrize(("seed", "kind"), list(enumerate(("two_columns", "signed", "sections", "balance_delta"))))
def test_every_strategy_reconciles(results, seed, kind):
    _, rows = statement(kind, kind, seed)
    check = results["checks"].where(f"doc_id = '{kind}'").first()
    layout = results["layouts"].where(f"doc_id = '{kind}'").first()
    assert layout.strategy == kind
    found = results["transactions"].where(f"doc_id = '{kind}'").orderBy("row_index").collect()
    assert [(r.side, r.cents, r.date.day) for r in found] == [(s, c, int(d)) for d, s, c in rows]
    assert check.reconciled and check.residual == 0 and check.n_ok == 6
    assert check.last4 == "6426" and str(check.start) == "2025-04-01"
    assert found[2].description == "PAYMENT 2 CONTINUED HERE"


def test_a_lost_row_is_named(results):
    _, rows = statement("lost", "two_columns", 9)
    check = results["checks"].where("doc_id = 'lost'").first()
    assert not check.reconciled and check.diagnosis == "row_level_break" and check.break_index == 5
    assert (check.sig_kind, check.sig_side, check.sig_amount) == ("dropped_row", rows[5][1], rows[5][2])


def test_binder_has_two_periods(results):
    got = results["checks"].where("doc_id = 'binder'").orderBy("period").collect()
    assert len(got) == 2
    whole = nested(results).where("doc_id = 'binder'").first()
    assert len(whole.periods) == 2 and [len(p.transactions) for p in whole.periods] == [14, 14]


def test_page_anchors(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.money import find_money
    from ledgerloom.plans.extract import page_anchors, periods

    pages = {
        1: (["Account number: x x x x 6426"], ("6426", None, None)),
        2: (["Account 0012345678", "Acct *6427"], ("6427", None, None)),
        3: (["Account 1234 5678 9012 since 04/01/2025"], ("9012", None, None)),
        4: (["Routing 99999", "Account 12345 0012345678"], ("5678", None, None)),
        5: (["Statement date 04/30/2025", "Beginning balance as of 04/01/2025 10.00", "Ending balance as of 04/29/2025 12.00"], (None, "2025-04-01", "2025-04-30")),
        6: (["Statement period 05/01/2025 through 05/31/2025", "Beginning balance as of 04/30/2025"], (None, "2025-05-01", "2025-05-31")),
        7: (["Previous balance 06/01/2025 1.00", "New balance 06/30/2025 2.00"], (None, "2025-06-01", "2025-06-30")),
        8: (["Nothing here"], (None, None, None)),
    }
    rows = [("d", p, i, t, False) for p, (texts, _) in pages.items() for i, t in enumerate(texts)]
    rows += [("n", p, 0, f"Account 12345{p}", False) for p in (1, 2)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string, dated boolean").withColumn("money", find_money(F.col("text")))
    anchors = page_anchors(lines)
    got = {r.page: (r.last4, *(r.cycle and (r.cycle.start and str(r.cycle.start), r.cycle.end and str(r.cycle.end)) or (None, None))) for r in anchors.where("doc_id = 'd'").collect()}
    assert got == {p: x for p, (_, x) in pages.items()}
    assert [r.period for r in periods(anchors.where("doc_id = 'n'")).orderBy("page").collect()] == [0, 1]


def test_no_words(spark):
    assert all(v.count() == 0 for v in extract(spark.createDataFrame([], WORDS)).values())


def test_given_layout_stays_only_where_it_reconciles(spark):
    """Two rows are no table, so no layout is found; a given one is tried."""
    from pyspark.sql import functions as F

    def short(doc, ending):
        s = Sheet(doc, 1)
        s.line(("Beginning balance 100.00",))
        s.line((f"Ending balance {ending}",))
        s.top += 12
        s.line(("04/01/2025", 30.0), ("ONE", 110.0), ("50.00", 0, 400.0))
        s.line(("04/02/2025", 30.0), ("TWO", 110.0), ("-20.00", 0, 400.0))
        return s.words

    words = spark.createDataFrame(short("ties", "130.00") + short("fails", "131.00"), WORDS)
    band = lambda a, b: f"named_struct('x0', {a}D, 'x1', {b}D)"
    given = spark.createDataFrame([("ties", 0), ("fails", 0)], "doc_id string, period int").select(
        "doc_id", "period", F.expr(band(28, 95)).alias("date_column"), F.expr(f"array({band(340, 402)})").alias("amount_columns"), F.expr("cast(null as struct<x0:double,x1:double>)").alias("balance_column"),
        F.lit("signed").alias("strategy"), F.expr("cast(array() as array<struct<name:string,side:string>>)").alias("sections"), F.array(F.lit("M/d/yyyy")).alias("date_formats"),
    )
    got = {r.doc_id: r for r in extract(words, given)["checks"].collect()}
    assert got["ties"].reconciled and got["ties"].path == "given_layout" and got["ties"].dep_n == 1 and got["ties"].wd_n == 1
    assert not got["fails"].reconciled and got["fails"].path == "deterministic" and got["fails"].dep_n == 0 and got["fails"].verdict == "not_tied"
