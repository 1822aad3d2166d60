"""Statements set as positioned words, made of the events table: what the engine
reads in its own queries, where the ledger says what it should find.

One document an account, two periods (up to the 14th of the month and after), one
page a week and period. By account the table has two columns, signed amounts,
sections, or amounts beside a balance; the summary stands line by line or as labels
over amounts; dates have a year or not; some documents are recognised, tilted and
off their margin. By event id rows lose their amount or their date, amounts are
split over two boxes, descriptions wrap; some sections end in a listing, alone or
as a repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_cents
from ledgerloom.plans.ledger import ledger

#: Large enough that no balance is negative: a minus sign anywhere in a table makes
#: its amounts signed.
OPENING = 10_000_000
CHAR, GAP, PITCH, HEIGHT = 6.0, 4.0, 12.0, 10.0
TILT, OFF_MARGIN = 0.01, 12.0
KINDS = ("two_columns", "signed", "sections", "balance_delta")
BANKS = ("HARBOUR BANK", "Union Trust", "First Mutual Savings")


def facts(spark: SparkSession, sf: str, book: DataFrame | None = None) -> DataFrame:
    """The ledger's rows (or those of ``book``) with what decides how each is set:
    account, half, page, kind, side, cents, balance, opening (of the half), and flags."""
    c = F.col
    full = (ledger(spark, sf) if book is None else book).where("cents <> 0").withColumn("half", (F.to_date("ts") > F.lit("2024-01-14").cast("date")).cast("int")).withColumn("day", F.to_date("ts"))
    full = full.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (c("account") % 4 + 1).cast("int"))).withColumn("page", (F.least(F.weekofyear("ts"), F.lit(4)) + c("half")).cast("int"))
    full = full.withColumn("signed", F.when(c("side") == "deposit", c("cents")).otherwise(-c("cents")))
    table_order = [c("page"), F.when(c("kind") == "sections", c("side")), c("ts"), c("event_id")]
    run = Window.partitionBy("account", "half").orderBy(*table_order)
    whole = Window.partitionBy("account", "half")
    before = Window.partitionBy("account").orderBy("half").rangeBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("opening", F.lit(OPENING) + F.coalesce(F.sum("signed").over(before), F.lit(0))).withColumn("balance", c("opening") + F.sum("signed").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    full = full.withColumn("nth", F.row_number().over(run)).withColumn("rows", F.count(F.lit(1)).over(whole))
    balanced = c("kind") != "sections"
    listed = (c("kind") == "sections") & (c("side") == "withdrawal") & (c("event_id") % 3 == 0)
    full = full.withColumns({
        "lost": (c("account") % 11 == 6) & (c("account") % 5 != 4) & (c("half") == 1) & (c("nth") == c("rows")),
        "no_amount": balanced & (c("event_id") % 37 == 5),
        "no_date": balanced & (c("event_id") % 41 == 7) & (c("event_id") % 37 != 5),
        "split": c("event_id") % 23 == 4,
        "wraps": c("event_id") % 29 == 3,
        "only_listed": listed & (c("account") % 8 == 2),
        "also_listed": listed & (c("account") % 8 == 6),
    })
    return full.withColumns({"in_table": ~c("lost") & ~c("only_listed"), "in_listing": ~c("lost") & (c("only_listed") | c("also_listed"))})


def shown(cents: Column) -> Column:
    """Cents with commas."""
    whole = F.format_number(F.floor(F.abs(cents) / 100).cast("bigint"), 0)
    return F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def date_text(account: Column, day: Column) -> Column:
    return F.when(account % 3 == 0, F.date_format(day, "MM/dd/yyyy")).when(account % 3 == 1, F.date_format(day, "MM/dd")).otherwise(F.date_format(day, "MMM d"))


def cell(text: Column, left=None, right=None, height: float = HEIGHT, tight: bool = False) -> Column:
    """A stretch of text on a line, at a left or right edge; null text is nothing.
    ``tight`` words touch."""
    return F.struct(text.cast("string").alias("text"), F.lit(left).cast("double").alias("left"), F.lit(right).cast("double").alias("right"), F.lit(height).alias("height"), F.lit(0.0 if tight else GAP).alias("gap"))


def words_of(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line, cells) -> one row a word."""
    cells = lines.select("doc_id", "page", "line", F.explode("cells").alias("c")).where("c.text is not null and c.text <> ''")
    w = F.split("c.text", " ")
    width = F.length(F.regexp_replace("c.text", " ", "")) * CHAR + (F.size(w) - 1) * F.col("c.gap")
    placed = cells.select("doc_id", "page", "line", "c.height", "c.gap", w.alias("w"), F.coalesce(F.col("c.left"), F.col("c.right") - width).alias("x"))
    each = placed.select("doc_id", "page", "line", "height", "gap", "x", "w", F.posexplode("w").alias("i", "text"))
    x0 = F.col("x") + F.aggregate(F.slice("w", 1, F.col("i")), F.lit(0.0), lambda s, t: s + F.length(t) * CHAR) + F.col("i") * F.col("gap")
    return each.select("doc_id", "page", "text", x0.alias("x0"), (x0 + F.length("text") * CHAR).alias("x1"), (F.col("line") * PITCH + 40.0).alias("top"), "height")


def render(spark: SparkSession, sf: str, book: DataFrame | None = None) -> DataFrame:
    """doc_id, page, text, x0, x1, top, height, source."""
    c = F.col
    page = Window.partitionBy("account", "page")
    full = facts(spark, sf, book).withColumn("in_page", F.sum(c("in_table").cast("int")).over(page))
    a = c("account")
    # What stands below a page's table starts at its place, or under a table that reaches it.
    below = lambda place: F.greatest(F.lit(place), c("in_page") * 2 + 20).cast("int")
    sums = lambda s, f: f(F.when(c("side") == s, c("cents")))
    tops = full.groupBy("account", "half", "kind").agg(F.min("page").alias("page"), F.min_by("in_page", "page").alias("in_page"), F.min("opening").alias("opening"), F.coalesce(sums("deposit", F.sum), F.lit(0)).alias("dep"), F.coalesce(sums("withdrawal", F.sum), F.lit(0)).alias("wd"), sums("deposit", F.count).alias("n_dep"), sums("withdrawal", F.count).alias("n_wd"))
    start = F.when(c("half") == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-15")).cast("date")
    end = F.when(c("half") == 0, F.lit("2024-01-14")).otherwise(F.lit("2024-01-31")).cast("date")
    d = lambda x: F.date_format(x, "MM/dd/yyyy")
    bank = F.element_at(F.array(*map(F.lit, BANKS)), (a % 3 + 1).cast("int"))
    closing = c("opening") + c("dep") - c("wd")
    across = a % 5 == 4
    counted = lambda n, what, v: F.concat(F.format_number(n, 0), F.lit(f" {what} "), shown(v))
    lines = {
        0: [cell(bank, 54.0, height=17.0)],
        1: [cell(F.concat(F.lit("Account XXXX"), F.lpad((a % 10000).cast("string"), 4, "0")), 30.0)],
        2: [cell(F.concat(F.lit("Statement period "), d(start), F.lit(" through "), d(end)), 30.0)],
        4: [cell(F.when(across, "Beginning balance").otherwise(F.concat(F.lit("Beginning balance "), shown(c("opening")))), 30.0), *[cell(F.when(across, t), x) for t, x in (("Total deposits", 180.0), ("Total withdrawals", 310.0), ("Ending balance", 450.0))]],
        5: [cell(F.when(across, shown(c("opening"))).otherwise(counted(c("n_dep"), "Total deposits", c("dep"))), 40.0), *[cell(F.when(across, shown(v)), x) for v, x in ((c("dep"), 190.0), (-c("wd"), 330.0), (closing, 460.0))]],
        6: [cell(F.when(~across, counted(c("n_wd"), "Total withdrawals", -c("wd"))), 30.0)],
        7: [cell(F.when(~across, F.concat(F.lit("Ending balance "), shown(closing))), 30.0)],
    }
    head = tops.select(a.alias("doc_id"), "page", F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.array(*cells).alias("cells")) for n, cells in lines.items()])).alias("l")).select("doc_id", "page", "l.*")
    table = full.where("in_table").withColumn("line", F.lit(12) + 2 * F.row_number().over(Window.partitionBy("account", "page").orderBy(F.when(c("kind") == "sections", c("side")), "ts", "event_id")))
    table = table.withColumn("line", c("line") + F.when((c("kind") == "sections") & (c("side") == "withdrawal"), 4).otherwise(0))
    two, signed = c("kind") == "two_columns", c("kind") == "signed"
    amount = F.when(~c("no_amount"), shown(F.when(signed, c("signed")).otherwise(c("cents"))))
    parts = F.when(c("split"), F.concat(F.substring(amount, F.lit(1), F.length(amount) - 3), F.lit(" "), F.right(amount, F.lit(3)))).otherwise(amount)
    right = F.when(two & (c("side") == "deposit"), 380.0).when(two, 470.0).otherwise(460.0)
    placed = F.struct(parts.alias("text"), F.lit(None).cast("double").alias("left"), right.alias("right"), F.lit(HEIGHT).alias("height"), F.lit(0.0).alias("gap"))
    name = F.concat(F.lit("PAYMENT E"), c("event_id").cast("string"))
    row = F.array(cell(F.when(~c("no_date"), date_text(a, c("day"))), 30.0), cell(name, 110.0), placed, cell(F.when(c("kind") != "sections", shown(c("balance"))), right=560.0))
    body = table.select(a.alias("doc_id"), "page", "line", row.alias("cells"))
    wrapped = table.where("wraps").select(a.alias("doc_id"), "page", (c("line") + 1).alias("line"), F.array(cell(F.concat(F.lit("REF E"), c("event_id").cast("string")), 110.0)).alias("cells"))
    first = table.where("kind = 'sections'").groupBy("account", "page", "side").agg(F.min("line").alias("line"))
    titles = first.select(a.alias("doc_id"), "page", (c("line") - 1).alias("line"), F.array(cell(F.when(c("side") == "deposit", "Deposits and credits").otherwise("Withdrawals and debits"), 30.0)).alias("cells"))
    slot = Window.partitionBy("account", "page").orderBy("ts", "event_id")
    listed = full.where("in_listing").withColumn("k", F.row_number().over(slot) - 1)
    record = F.concat_ws(" ", date_text(a, c("day")), F.concat(F.lit("C"), c("event_id").cast("string")), shown(c("cents")))
    entries = listed.select(a.alias("doc_id"), "page", (below(300) + 2 + F.floor(c("k") / 2)).cast("int").alias("line"), F.array(F.struct(record.alias("text"), F.when(c("k") % 2 == 0, 30.0).otherwise(300.0).alias("left"), F.lit(None).cast("double").alias("right"), F.lit(HEIGHT).alias("height"), F.lit(GAP).alias("gap"))).alias("cells"))
    over = listed.select(a.alias("doc_id"), "page", "in_page").distinct()
    over = over.select("*", F.explode(F.array(F.struct(below(300).alias("line"), F.array(cell(F.lit("Checks paid"), 30.0), cell(F.lit(None), 30.0)).alias("cells")), F.struct((below(300) + 1).alias("line"), F.array(cell(F.lit("Date Check No. Amount"), 30.0), cell(F.lit("Date Check No. Amount"), 300.0)).alias("cells")))).alias("l")).select("doc_id", "page", "l.*")
    # A line of several dates and amounts that is no transaction.
    extra = tops.where((a % 6 == 1) & (c("half") == 0)).select(a.alias("doc_id"), "page", below(290).alias("line"), F.array(cell(date_text(a, start), 30.0), placed_amount(two, c("opening")), cell(date_text(a, end), right=560.0)).alias("cells"))
    words = words_of(head.unionByName(body).unionByName(wrapped).unionByName(titles).unionByName(entries).unionByName(over).unionByName(extra))
    # A page of few words is never turned back, so it isn't turned.
    enough = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page")) >= 40
    words = words.withColumn("tilted", (c("doc_id") % 9 == 8) & enough)
    recognised, tilted = c("doc_id") % 9 == 8, c("tilted")
    off = F.when(tilted & (c("page") % 3 == 0), OFF_MARGIN).otherwise(0.0)
    moved = {"x0": c("x0") + off - F.when(tilted, c("top") * TILT).otherwise(0.0), "x1": c("x1") + off - F.when(tilted, c("top") * TILT).otherwise(0.0), "top": c("top") + F.when(tilted, c("x0") * TILT).otherwise(0.0)}
    return words.withColumns(moved).withColumn("doc_id", c("doc_id").cast("string")).withColumn("source", F.when(recognised, "ocr").otherwise("text")).drop("tilted")


def placed_amount(two: Column, cents: Column) -> Column:
    return F.struct(shown(cents).alias("text"), F.lit(None).cast("double").alias("left"), F.when(two, 380.0).otherwise(460.0).alias("right"), F.lit(HEIGHT).alias("height"), F.lit(GAP).alias("gap"))
