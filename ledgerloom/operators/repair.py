"""Bounded repair: recorded turns of edits, taken as far as bounds and budget go,
kept only where the period then reconciles.

``turns``: doc_id, period, turn, tokens_in, tokens_out and calls, an array of
(name, arguments as JSON), as an assistant that sees the rows gave them. A turn's calls
are one move: after it the six checks are run again, on running totals, without
touching a row. A period's turns end with the first that reconciles, with one without
calls, after ``TURNS``, or before one when its document has spent its budget. The rows
of a period change only if it closes; else they stay as they were.

A row is named by its place in the list as it then is: dropped rows close the gap,
inserted ones go to the end. Places are resolved by a fold over a period's few edits;
rows are met by joins on resolved places, and only those of periods that have turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_money
from ledgerloom.operators import reconcile

# Turns a period, dollars a document, the arguments each edit takes.
TURNS = 12
BUDGET = 0.25
ARGUMENTS = {"insert_row": ["amount", "description", "side", "when"], "drop_row": ["index"], "set_side": ["index", "side"]}
DOC, PERIOD = ["doc_id"], ["doc_id", "period"]
EDIT = ["turn", "call"]
_SHAPE = "when string, description string, side string, amount string, index bigint"


def numbered(turns: DataFrame) -> DataFrame:
    """The turns of a period from 1, up to ``TURNS``."""
    order = Window.partitionBy(*PERIOD).orderBy("turn")
    return turns.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= TURNS)


def edits_of(turns: DataFrame) -> DataFrame:
    """PERIOD, turn, call, op, index, side, cents, date, description of the calls that
    are edits; arguments that are none (a missing or unknown name, no date, no side, no
    amount or zero) leave the call without effect."""
    each = turns.select(*PERIOD, "turn", F.posexplode("calls").alias("call", "c")).select(*PERIOD, *EDIT, F.col("c.name").alias("op"), F.col("c.arguments").alias("raw"))
    names = F.array_sort(F.json_object_keys("raw"))
    fits = F.lit(False)
    for op, needed in ARGUMENTS.items():
        fits |= (F.col("op") == op) & (names == F.array(*map(F.lit, needed)))
    said = each.where(fits).withColumn("a", F.from_json("raw", _SHAPE))
    when = F.trim("a.when")
    day = F.try_to_timestamp(F.when(when.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), when), F.lit("yyyy-M-d")).cast("date")
    out = said.select(*PERIOD, *EDIT, "op", "a.index", "a.side", F.abs(parse_money(F.col("a.amount"))).alias("cents"), day.alias("date"), "a.description")
    sided = F.col("side").isin("deposit", "withdrawal")
    whole = F.when(F.col("op") == "insert_row", F.col("date").isNotNull() & sided & (F.col("cents") > 0)).when(F.col("op") == "set_side", sided & F.col("index").isNotNull()).otherwise(F.col("index").isNotNull())
    return out.where(F.coalesce(whole, F.lit(False)))


def placed(edits: DataFrame, counts: DataFrame) -> DataFrame:
    """``edits`` with ``pos``, the row each is about: its place in the list of the
    period's rows (``counts``: PERIOD, n) and, after them, all inserted ones. An edit of
    a row that isn't there goes."""
    listed = edits.groupBy(*PERIOD).agg(F.array_sort(F.collect_list(F.struct(*EDIT, "op", "index"))).alias("log"))
    start = F.struct(F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("gone"), F.array().cast("array<struct<turn:int,call:int,pos:bigint>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        # Every dropped row at or before a place moves it on by one.
        at = F.aggregate(s["gone"], e["index"], lambda p, d: F.when(d <= p, p + 1).otherwise(p))
        there = (e["index"] >= 0) & (e["index"] < s["n"] - F.size(s["gone"]))
        inserts, drops = e["op"] == "insert_row", e["op"] == "drop_row"
        pos = F.when(inserts, s["n"]).when(there, at)
        noted = F.when(pos.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(e["turn"].alias("turn"), e["call"].alias("call"), pos.alias("pos")))))
        gone = F.when(drops & there, F.array_sort(F.concat(s["gone"], F.array(at)))).otherwise(s["gone"])
        return F.struct((s["n"] + inserts.cast("bigint")).alias("n"), gone.alias("gone"), noted.alias("out"))

    found = listed.join(counts, PERIOD, "left").select(*PERIOD, F.explode(F.aggregate("log", start, step)["out"]).alias("x")).select(*PERIOD, "x.*")
    return edits.join(found, [*PERIOD, *EDIT])


def moves(located: DataFrame, rows: DataFrame) -> DataFrame:
    """What each edit does to the totals: dep_cents, wd_cents, dep_n, wd_n, added."""
    c = F.col
    inserts = located.where("op = 'insert_row'")
    known = rows.join(located.select(*PERIOD).distinct(), PERIOD, "left_semi").select(*PERIOD, c("row_index").cast("bigint").alias("pos"), c("side").alias("own_side"), c("cents").alias("own_cents"))
    known = known.unionByName(inserts.select(*PERIOD, "pos", c("side").alias("own_side"), c("cents").alias("own_cents")))
    order = Window.partitionBy(*PERIOD, "pos").orderBy(*EDIT)
    seen = located.join(known, [*PERIOD, "pos"]).withColumn("before", F.coalesce(F.lag("side").over(order), "own_side"))
    new = F.when(c("op") != "drop_row", c("side"))
    old = F.when(c("op") != "insert_row", c("before"))
    held = lambda x, side: F.coalesce((x == side).cast("bigint"), F.lit(0))
    change = {f"{k}_n": held(new, side) - held(old, side) for k, side in (("dep", "deposit"), ("wd", "withdrawal"))}
    return seen.select(*PERIOD, *EDIT, *[(n * c("own_cents")).alias(k.replace("_n", "_cents")) for k, n in change.items()], *[n.alias(k) for k, n in change.items()])


def outcome(turns: DataFrame, located: DataFrame, rows: DataFrame, failed: DataFrame, prices: tuple[float, float], budget: float, spent: DataFrame | None = None) -> DataFrame:
    """PERIOD, turn, cost, taken, closes, n_edits: one row a turn that bounds leave.

    ``failed`` has the printed figures and totals of the periods that don't reconcile;
    ``spent`` (PERIOD, cost) what a period took before its turns, of the same budget.
    """
    c, totals = F.col, ("dep_cents", "wd_cents", "dep_n", "wd_n")
    of_turn = moves(located, rows).groupBy(*PERIOD, "turn").agg(*[F.sum(t).alias(f"d_{t}") for t in totals], F.count(F.lit(1)).alias("edits"))
    run = Window.partitionBy(*PERIOD).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    book = turns.join(of_turn, [*PERIOD, "turn"], "left").join(failed.select(*PERIOD, *reconcile.PRINTED, *totals), PERIOD)
    book = book.withColumns({t: c(t) + F.coalesce(F.sum(f"d_{t}").over(run), F.lit(0)) for t in totals}).withColumn("n_edits", F.coalesce(F.sum("edits").over(run), F.lit(0)))
    judged = reconcile.judged(book).withColumn("ends", c("reconciled") | (F.coalesce(F.size("calls"), F.lit(0)) <= 0))
    before = Window.partitionBy(*PERIOD).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    wanted = judged.withColumn("over", F.max("ends").over(before)).where("coalesce(not over, true)")
    cost = (F.coalesce("tokens_in", F.lit(0)) * prices[0] + F.coalesce("tokens_out", F.lit(0)) * prices[1]) / 1_000_000
    wanted = wanted.select(*PERIOD, "turn", cost.alias("cost"), "reconciled", "n_edits")
    if spent is not None:
        wanted = wanted.unionByName(spent.select(*PERIOD, F.lit(0).alias("turn"), c("cost").cast("double").alias("cost"), F.lit(False).alias("reconciled"), F.lit(0).cast("bigint").alias("n_edits")))
    # The budget is the document's: what its earlier turns took counts.
    past = Window.partitionBy(*DOC).orderBy("period", "turn").rowsBetween(Window.unboundedPreceding, -1)
    paid = F.coalesce(F.sum("cost").over(past), F.lit(0.0)) < budget
    return wanted.withColumn("taken", paid).where("turn > 0").withColumn("closes", c("taken") & c("reconciled")).drop("reconciled")


def edited(rows: DataFrame, located: DataFrame, closed: DataFrame) -> DataFrame:
    """The rows of the periods of ``closed`` (PERIOD, upto) with all edits up to that
    turn, numbered anew; inserted ones have null in all other columns."""
    c = F.col
    done = located.join(closed.select(*PERIOD, "upto"), PERIOD).where(c("turn") <= c("upto"))
    own = rows.join(closed, PERIOD, "left_semi").withColumn("pos", c("row_index").cast("bigint"))
    new = done.where("op = 'insert_row'").select(*PERIOD, "pos", "side", "cents", "date", "description")
    whole = own.unionByName(new, allowMissingColumns=True)
    last = done.where("op <> 'insert_row'").groupBy(*PERIOD, "pos").agg(F.bool_or(c("op") == "drop_row").alias("dropped"), F.max_by(F.when(c("op") == "set_side", c("side")), F.when(c("op") == "set_side", F.struct(*EDIT))).alias("new_side"))
    out = whole.join(last, [*PERIOD, "pos"], "left").where("coalesce(not dropped, true)").withColumn("side", F.coalesce("new_side", "side"))
    order = Window.partitionBy(*PERIOD).orderBy("pos")
    return out.withColumn("row_index", (F.row_number().over(order) - 1).cast("int")).select(*rows.columns)
