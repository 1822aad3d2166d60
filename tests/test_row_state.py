"""Lines as rows against a reader that goes line by line with its state."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from ledgerloom.plans.extract import told_rows

LINES = "doc_id string, period int, candidate int, page int, line_no int, day date, amount long, column int, balance long, heading string, is_summary boolean, said string, alone boolean, strategy string, opening long, start date, end date"
KINDS = ("two_columns", "signed", "sections", "balance_delta")


def plain(lines, strategy, opening, start):
    """(line_no, date, side, cents, recovered, inherited) of the rows, in order."""
    prev, section, last, out = opening, None, None, []

    def side_of(amount, column, balance):
        if strategy == "two_columns":
            return ("deposit", "withdrawal")[column]
        if strategy == "signed":
            return "withdrawal" if amount < 0 else "deposit"
        if strategy == "sections":
            return section
        if balance is None or prev is None:
            return None
        return "deposit" if balance > prev else "withdrawal"

    for no, day, amount, column, balance, heading, summary in lines:
        def emit(when, inherited):
            nonlocal prev, last
            if amount == 0:
                prev = prev if balance is None else balance
                return
            side = side_of(amount, column, balance)
            if side is None:
                return
            out.append((no, when, side, abs(amount), False, inherited))
            last = when
            prev = prev if balance is None else balance

        if day is not None and amount is not None:
            if not summary:
                emit(day, False)
            continue
        if day is None and amount is not None and balance is not None and prev is not None and amount != 0:
            side = side_of(amount, column, balance)
            if side is not None and prev + (abs(amount) if side == "deposit" else -abs(amount)) == balance:
                if (last or start) is not None:
                    emit(last or start, True)
                continue
        if day is not None and amount is None and balance is not None and prev is not None:
            step, prev = balance - prev, balance
            if step:
                out.append((no, day, "deposit" if step > 0 else "withdrawal", abs(step), True, False))
            continue
        if day is None and amount is None and balance is None and heading:
            section = heading
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_reader_line_by_line(spark, seed):
    rng = random.Random(seed)
    docs, rows = {}, []
    for d in range(120):
        strategy, opening = rng.choice(KINDS), rng.choice([None, 100])
        start = rng.choice([None, dt.date(2025, 1, 1)])
        lines, at = [], opening if opening is not None else 50
        for no in range(rng.randrange(1, 25)):
            kind = rng.random()
            column = rng.randrange(2)
            amount = rng.choice([0, 1, 2, 3, 5, -1, -2])
            day = dt.date(2025, 1, 1 + no) if rng.random() < 0.55 else None
            moved = at + (abs(amount) if (strategy == "two_columns" and column == 0) or (strategy == "signed" and amount > 0) or (strategy in KINDS[2:] and rng.random() < 0.5) else -abs(amount))
            balance = moved if rng.random() < 0.75 else rng.choice([None, 100, at, moved + 1])
            if kind < 0.12:
                lines.append((no, None, None, None, None, rng.choice(["deposit", "withdrawal"]) if strategy == "sections" else None, False))
            elif kind < 0.25:
                lines.append((no, day, None, None, balance, None, False))
            else:
                lines.append((no, day, amount, column, balance, None, day is not None and rng.random() < 0.1))
            if balance is not None and rng.random() < 0.8:
                at = balance
        docs[f"d{d}"] = plain(lines, strategy, opening, start)
        rows += [(f"d{d}", 0, 1, 1, no, day, a, c, b, h, s, "x", False, strategy, opening, start, None) for no, day, a, c, b, h, s in lines]
    read = told_rows(spark.createDataFrame(rows, LINES).repartition(4)).where("kept").orderBy("line_no").collect()
    got = {d: [] for d in docs}
    for r in read:
        got[r.doc_id].append((r.line_no, r.date, r.side, r.cents, r.recovered, r.date_inherited))
    assert got == docs
    every = [x for v in docs.values() for x in v]
    assert sum(x[5] for x in every) > 20 and sum(x[4] for x in every) > 20 and len(every) > 300


def test_no_undated_lines(spark):
    rows = [("d", 0, 1, 1, i, dt.date(2025, 1, 1 + i), 5, 0, 105 + 5 * i, None, False, "x", False, "two_columns", 100, None, None) for i in range(3)]
    assert [(r.side, r.cents) for r in told_rows(spark.createDataFrame(rows, LINES)).orderBy("line_no").collect()] == [("deposit", 5)] * 3
    assert told_rows(spark.createDataFrame([], LINES)).collect() == []
