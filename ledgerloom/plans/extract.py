"""From positioned words to reconciled periods, for many documents at once.

Every step is a relation over all documents: lines, line facts, pages in
periods, printed figures, candidate layouts (as data), rows under each
candidate, tie-outs, and the best candidate of each period. State that runs
down a page (sections, balances, dates) is a window over (document, period,
candidate); all of these share one exchange by document.

The balance a row is measured against is that of the last row before it that
printed one, a row of amount zero among them; lines that became no row leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scan
from ledgerloom.functions.dates import NOTATIONS, SENTINEL_YEAR, find_dates, with_year
from ledgerloom.functions.money import find_money, parse_money
from ledgerloom.functions.text import CYCLE_PAIR, PERIOD_LABELS, has_label, labelled_last4, masked_last4, names_side, squash
from ledgerloom.operators import audit, diagnose, geometry, header, listing, reconcile, repair, rows
from ledgerloom.sources.shared import written

DOC, PERIOD = ["doc_id"], ["doc_id", "period"]
CAND = ["doc_id", "period", "candidate"]
TRIED = [*CAND, "variant"]
CANDIDATES = 3
# Rank of the layout that all pages of a period show together, behind those of single pages.
POOLED = CANDIDATES + 1
#: Rank of layouts that were given, after all that were found.
GIVEN = 100
MIN_ROWS = 3
MIN_BALANCE_PAIRS = 2
RECOGNISED = ("ocr",)


def upright(words: DataFrame) -> DataFrame:
    """Words of recognised pages (column ``source``: ocr) without tilt, and moved
    to the margin of their document; other words as they are, as are all without
    such a column."""
    if "source" not in words.columns:
        return words
    flag = F.coalesce(F.col("source").isin(*RECOGNISED), F.lit(False))
    square = written(geometry.squared(words, flag), "squared")
    facts = line_facts(lines_of(square.where(flag), "recognised_lines")).where("dated and size(money) > 0")
    return geometry.registered(square, facts.select("doc_id", "page", F.get("words", 0)["x0"].alias("left")), flag)


def lines_of(words: DataFrame, name: str = "lines") -> DataFrame:
    """Lines of all pages; written."""
    return written(geometry.lines(words, ["doc_id", "page"]), name)


def line_facts(lines: DataFrame) -> DataFrame:
    """Lines (of lines_of) with their leading date (longest of up to four words) and its
    words' extent, amounts word by word (cells) and over touching boxes (paid), both with
    places, amounts in the text (money), and what they are."""
    lines = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_idx")))
    lead = F.when(F.exists(F.slice("words", 1, 4), lambda w: w["text"].rlike(r"\d")), scan.date_at(F.col("words"), F.lit(0)))
    cells = F.filter(F.transform("words", lambda w: F.struct(parse_money(w["text"]).alias("cents"), w["x0"].alias("x0"), w["x1"].alias("x1"), ((w["x0"] + w["x1"]) / 2).alias("c"))), lambda m: m["cents"].isNotNull())
    out = lines.withColumns({"lead": lead, "cells": cells, "money": find_money(F.col("text"))})
    out = out.withColumn("dated", F.col("lead").isNotNull()).withColumn("paid", F.when(F.col("text").rlike(r"\d"), scan.amounts(F.col("words"))))
    # Only a line with digits beyond its first amount that are no amount can hold another date.
    after = F.slice("words", F.get("paid", 0)["i"] + 2, F.size("words"))
    more = F.exists(after, lambda w: w["text"].rlike(r"\d") & parse_money(w["text"]).isNull())
    summary = F.when(F.col("dated") & (F.size("paid") > 0) & F.coalesce(more, F.lit(False)), scan.is_summary(F.col("paid"), scan.dates(F.col("words"))))
    out = out.withColumn("summary", F.coalesce(summary, F.lit(False)))
    return out.withColumn("kind", F.when(F.col("dated") & (F.size("cells") > 0), "row").when(~F.col("dated") & (F.size("cells") == 0), "heading").otherwise("other"))


def page_anchors(lines: DataFrame) -> DataFrame:
    """What a page says about the statement it belongs to, off its undated lines.
    An account number behind a mask goes before one of an account line. A period
    is told by the first line with a period label and dates: its first and last date,
    or its one date as the end; without such a line by a cycle pair; and dates beside
    the beginning and ending balance fill what is missing."""
    says = F.when(~F.col("dated"), F.col("text"))
    read = lines.withColumn("says", says).withColumn("dates", F.when(says.rlike(r"\d"), find_dates(says)))
    says, dates, some = F.col("says"), F.col("dates"), F.size("dates") > 0
    labelled = says.rlike("(?i)" + "|".join(PERIOD_LABELS))
    stated = F.when(labelled & some, F.struct(F.get(dates, 0).alias("start"), F.element_at(dates, -1).alias("end"), F.size(dates).alias("n")))
    pair = [F.when(squash(says).contains(x.replace(" ", "")) & some, F.get(dates, 0)) for x in CYCLE_PAIR]
    beside = lambda field: F.when(names_side(says, field) & some, F.get(dates, 0))
    opens = ~F.col("dated") & has_label(F.col("text"), "beginning") & (F.size("money") > 0)
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("line_no")))
    closes = F.when(~names_side(says, "beginning"), beside("ending"))
    found = read.groupBy("doc_id", "page").agg(
        F.bool_or(opens).alias("beginning"), first(masked_last4(says)).alias("masked"), first(labelled_last4(says)).alias("labelled"), first(stated).alias("stated"), first(pair[0]).alias("last_cycle"), first(pair[1]).alias("this_cycle"), first(beside("beginning")).alias("from"), first(closes).alias("to")
    )
    stated = F.col("stated")
    two = F.when(stated["n"] > 1, F.struct(stated["start"].alias("start"), stated["end"].alias("end")))
    start, end = F.coalesce(F.when(stated.isNull(), F.col("last_cycle")), "from"), F.coalesce(stated["start"], F.col("this_cycle"), F.col("to"))
    cycle = F.coalesce(two, F.when(start.isNotNull() | end.isNotNull(), F.struct(start.alias("start"), end.alias("end"))))
    return found.select("doc_id", "page", "beginning", F.coalesce("masked", "labelled").alias("last4"), cycle.alias("cycle"))


def periods(anchors: DataFrame) -> DataFrame:
    """doc_id, page, period. Beginning balances rule alone, unless every page has
    one; without any, a new account number or a new cycle opens a period."""
    whole, order = Window.partitionBy(*DOC), Window.partitionBy(*DOC).orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    running = F.bool_and("beginning").over(whole) & (F.count(F.lit(1)).over(whole) > 1)
    ruled = F.bool_or("beginning").over(whole) & ~running
    new_account = c("last4") != F.last("last4", ignorenulls=True).over(before)
    known = F.last("cycle", ignorenulls=True).over(before)
    new_cycle = (c("cycle.start") != known["start"]) | (c("cycle.end") != known["end"])
    opens = F.when(c("beginning") & ~running, True).when(ruled, False).otherwise(F.coalesce(new_account, F.lit(False)) | F.coalesce(new_cycle, F.lit(False)))
    first = F.row_number().over(order) == 1
    marked = anchors.withColumn("opens", opens & ~first)
    return marked.withColumn("period", F.sum(F.col("opens").cast("int")).over(order).cast("int"))


def split_header(lines: DataFrame) -> DataFrame:
    """``lines`` with ``below``: at or after its period's first row."""
    first = F.min(F.when(F.col("dated") & (F.size("money") > 0), F.col("line_no"))).over(Window.partitionBy(*PERIOD))
    return lines.withColumn("below", F.coalesce(F.col("line_no") >= first, F.lit(False)))


def printed_figures(lines: DataFrame) -> DataFrame:
    """Printed figures of every period (of split_header's lines): from a row of
    labels over a row of amounts; else of each field the last amount of the first
    undated line that names it, above the first row before below it, and a count
    where that line has one amount and one bare number of up to three digits, or more
    in groups by commas (a year has none). Side totals are magnitudes."""
    fields = {"beginning": False, "ending": False, "deposits": True, "withdrawals": True}
    off = lines.where(~F.col("dated") & (F.size("money") > 0))
    bare = F.regexp_extract_all(F.regexp_replace("text", r"[-(]?\$?[0-9][0-9,]*\.[0-9]{2}\)?-?", " "), F.lit(r"\b(\d{1,3}(?:,\d{3})*)\b"), F.lit(1))
    count = F.when((F.size("money") == 1) & (F.size(bare) == 1), F.regexp_replace(F.get(bare, 0), ",", "").cast("bigint"))
    value = F.element_at("money", -1)["cents"]
    at = F.struct(F.col("below").alias("below"), F.col("line_no").alias("line_no"))
    aggs = []
    for name, total in fields.items():
        named = names_side(F.col("text"), name)
        pick = F.struct((F.abs(value) if total else value).alias("v"), count.alias("n"))
        aggs.append(F.min_by(F.when(named, pick), F.when(named, at)).alias(name))
    found = off.groupBy(*PERIOD).agg(*aggs)
    above = lines.where(~F.col("below"))
    out = lines.select(*PERIOD).distinct().join(found, PERIOD, "left").join(header.horizontal(above, PERIOD), PERIOD, "left").join(header.letterhead(above, PERIOD), PERIOD, "left")
    for name, total in fields.items():
        block = F.try_element_at("block", F.lit(name))
        one = F.coalesce(F.abs(block) if total else block, F.col(f"{name}.v"))
        out = out.withColumn(f"{name}_v", one).withColumn(f"{name}_n", F.when(block.isNull(), F.col(f"{name}.n")))
    return out.select(*PERIOD, "bank", F.col("beginning_v").alias("beginning"), F.col("ending_v").alias("ending"), F.col("deposits_v").alias("deposits_total"), F.col("withdrawals_v").alias("withdrawals_total"), F.col("deposits_n").alias("deposits_count"), F.col("withdrawals_n").alias("withdrawals_count"))


def layouts(lines: DataFrame) -> DataFrame:
    """Up to three candidate layouts of a period, of its pages with most rows:
    date column, up to two amount columns (the rightmost), balance column where
    its chain holds on most neighbours, side strategy, section headings. A page
    that says nothing about sides gives none.

    A column needs two rows of a page. Where no page tells sides but by the balance, all
    pages of the period are also looked at together (``POOLED``), and give a layout if
    they show two amount columns. Signs and the names of sections are those of all pages."""
    # Lines of a listing are none of the table's, up to a heading with letters.
    bare = ~F.col("dated") & (F.size("cells") == 0)
    mark = F.when(bare, F.when(F.col("listing_header"), 1).when(F.col("text").rlike(r"\p{L}"), 0))
    page = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("skipped", F.last(mark, ignorenulls=True).over(page)).where("coalesce(skipped, 0) = 0")
    whole = Window.partitionBy(*PERIOD)
    counts = lines.where("kind = 'row'").groupBy(*PERIOD, "page").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumns({"k": F.row_number().over(whole.orderBy(F.desc("n"), "page")), "most": F.max("n").over(whole)})
    of_page, of_all = F.when((F.col("n") >= MIN_ROWS) & (F.col("k") <= CANDIDATES), F.col("k")), F.when(F.col("most") >= MIN_ROWS, F.lit(POOLED))
    dense = ranked.select(*PERIOD, "page", F.explode(F.array_compact(F.array(of_page, of_all))).alias("candidate"))
    seen = lines.join(dense, [*PERIOD, "page"])
    table = seen.where("kind = 'row'")
    # Of all pages together, amounts over touching boxes and undated lines count too, those with words that name no printed figure.
    plain = F.col("text").rlike(r"\p{L}") & ~(names_side(F.col("text"), "beginning") | names_side(F.col("text"), "ending") | names_side(F.col("text"), "deposits") | names_side(F.col("text"), "withdrawals"))
    joined = F.transform("paid", lambda m: F.struct(m["cents"].alias("cents"), m["x0"].alias("x0"), m["x1"].alias("x1"), m["c"].alias("c")))
    shown = seen.where((F.col("kind") == "row") | ((F.col("candidate") == POOLED) & ~F.col("dated") & (F.size("paid") > 0) & plain))
    cells = shown.select(*CAND, "line_no", F.explode(F.when(F.col("candidate") == POOLED, joined).otherwise(F.col("cells"))).alias("m")).select(*CAND, "line_no", "m.*")
    clustered = written(geometry.gap_clusters(cells, CAND, "c"), "cells")
    columns = written(geometry.columns(clustered, CAND, "line_no"), "columns")
    placed = clustered.join(columns.select(*CAND, "cluster"), [*CAND, "cluster"])
    right = columns.groupBy(*CAND).agg(F.max("cluster").alias("last"), F.count(F.lit(1)).alias("n_columns"))
    # Does the rightmost column run like a balance?
    by_row = placed.join(right, CAND).groupBy(*CAND, "line_no").agg(F.min_by(F.when(F.col("cluster") == F.col("last"), F.col("cents")), F.when(F.col("cluster") == F.col("last"), F.col("c"))).alias("balance"), F.min_by(F.when(F.col("cluster") < F.col("last"), F.col("cents")), F.when(F.col("cluster") < F.col("last"), F.col("c"))).alias("amount"))
    step = F.col("balance") - F.lag("balance").over(Window.partitionBy(*CAND).orderBy("line_no"))
    pairs = by_row.withColumn("step", step).where("step is not null and amount is not null")
    holds = pairs.groupBy(*CAND).agg((F.count_if(F.abs("step") == F.abs("amount")) * 2 > F.count(F.lit(1))).alias("most"), F.count(F.lit(1)).alias("n_pairs"))
    has_balance = F.coalesce((F.col("n_columns") >= 2) & F.col("most") & (F.col("n_pairs") >= MIN_BALANCE_PAIRS), F.lit(False))
    split = right.join(holds, CAND, "left").select(*CAND, "last", has_balance.alias("has_balance"))
    bands = columns.join(split, CAND)
    band = F.struct("x0", "x1")
    shape = bands.groupBy(*CAND).agg(
        F.array_sort(F.collect_list(F.when(~F.col("has_balance") | (F.col("cluster") < F.col("last")), band))).alias("all_amounts"), F.first(F.when(F.col("has_balance") & (F.col("cluster") == F.col("last")), band), ignorenulls=True).alias("balance_column"), F.min("x0").alias("left"), F.max("x1").alias("right")
    )
    dates = table.groupBy(*CAND).agg((F.min(F.get("words", 0)["x0"]) - geometry.COLUMN_PAD).alias("d0"), (F.max(F.get("words", F.col("lead.k") - 1)["x1"]) + geometry.COLUMN_PAD).alias("d1"), F.bool_or(F.exists("cells", lambda m: m["cents"] < 0)).alias("negative"))
    # A page may show one side alone, or call it by its listing's heading; the others of its period say what the sections are called.
    side = F.when(names_side(F.col("text"), "deposits"), "deposit").when(names_side(F.col("text"), "withdrawals"), "withdrawal")
    heads = lines.where("kind = 'heading'").select(*PERIOD, "words", squash(F.col("text")).alias("name"), side.alias("side")).where("side is not null")
    heads = heads.join(columns.groupBy(*CAND).agg(F.collect_list(band).alias("bands")), PERIOD)
    heads = heads.where(~F.exists("words", lambda w: F.exists("bands", lambda b: (w["x0"] <= b["x1"]) & (w["x1"] >= b["x0"]))))
    sections = heads.groupBy(*CAND).agg(F.array_sort(F.collect_set(F.struct("name", "side"))).alias("sections"))
    counted = table.groupBy(*CAND, F.col("lead.notation").alias("notation")).agg(F.count(F.lit(1)).alias("n"))
    declared = F.array_position(F.array(*map(F.lit, NOTATIONS)), F.col("notation"))
    dominant = counted.groupBy(*CAND).agg(F.array(F.max_by("notation", F.struct("n", -declared))).alias("date_formats"))
    out = shape.join(dates, CAND).join(dominant, CAND).join(sections, CAND, "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<struct<name:string,side:string>>")))
    out = out.withColumn("amount_columns", F.slice("all_amounts", F.greatest(F.size("all_amounts") - 1, F.lit(1)), F.lit(2)))
    # A page may show no amount with a sign; the others of its period do, in its column.
    signs = lines.where("kind = 'row'").select(*PERIOD, F.explode(F.filter("paid", lambda m: m["cents"] < 0)).alias("m")).groupBy(*PERIOD).agg(F.collect_set(F.round("m.c")).alias("signs"))
    out = out.join(signs, PERIOD, "left").withColumn("negative", F.col("negative") | F.coalesce(F.exists("signs", lambda x: within(x, F.get("amount_columns", 0))), F.lit(False)))
    strategy = F.when(F.size("amount_columns") == 2, "two_columns").when(F.col("negative"), "signed").when(F.size("sections") >= 2, "sections").when(F.col("balance_column").isNotNull(), "balance_delta")
    out = out.withColumn("strategy", strategy).where("strategy is not null and size(amount_columns) > 0")
    alone = F.bool_and(F.when(F.col("candidate") < POOLED, F.col("strategy") == "balance_delta")).over(whole)
    out = out.withColumn("alone", F.coalesce(alone, F.lit(True))).where((F.col("candidate") < POOLED) | (F.col("alone") & (F.col("strategy") == "two_columns")))
    return out.select(*CAND, F.struct(F.col("d0").alias("x0"), F.col("d1").alias("x1")).alias("date_column"), "amount_columns", "balance_column", "strategy", "sections", "date_formats")


def distinct_layouts(profiles: DataFrame) -> DataFrame:
    """Equal layouts of a period once, under the first rank."""
    body = [c for c in profiles.columns if c not in CAND]
    first = profiles.withColumn("as_text", F.to_json(F.struct(*body))).groupBy(*PERIOD, "as_text").agg(F.min("candidate").alias("candidate"))
    return profiles.join(first.select(*CAND), CAND, "left_semi")


def wider_first(profiles: DataFrame) -> DataFrame:
    """Layouts of a period in the order they are tried: as their pages rank, but one
    that tells sides by the balance alone goes behind one of two amount columns that has
    its columns. Its page showed the other column less than twice, so what stands there
    would be taken from the balance, though it is printed."""
    c = F.col
    whole = Window.partitionBy(*PERIOD)
    meet = lambda a, b: (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"])
    wide = F.collect_list(F.when(c("strategy") == "two_columns", F.struct("amount_columns", "balance_column"))).over(whole)
    has = lambda w: F.coalesce(meet(c("balance_column"), w["balance_column"]), F.lit(False)) & F.forall("amount_columns", lambda a: F.exists(w["amount_columns"], lambda b: meet(a, b)))
    told = profiles.withColumns({"wide": wide, "ranks": F.array_sort(F.collect_list("candidate").over(whole))})
    told = told.withColumn("narrow", (c("strategy") == "balance_delta") & F.exists("wide", has))
    place = F.row_number().over(whole.orderBy("narrow", "candidate"))
    return told.withColumn("candidate", F.get("ranks", place - 1)).select(*profiles.columns)


def within(c: Column, band: Column) -> Column:
    return (c >= band["x0"]) & (c <= band["x1"])


def table_rows(lines: DataFrame, profiles: DataFrame, figures: DataFrame, cycles: DataFrame) -> DataFrame:
    """Every line under each candidate layout with what it is read as: day, amount,
    balance, side, cents, whether it emits a row (``emits``: plain, with an inherited
    date, or recovered from the balance step), and whether it is words of the
    description band alone (``alone``). Lines of a listing and its
    header take no part."""
    c = F.col
    table = lines.where(~c("in_listing") & ~c("listing_header"))
    under = table.join(profiles, PERIOD).join(figures.select(*PERIOD, c("beginning").alias("opening")), PERIOD).join(cycles, PERIOD, "left")
    placed = F.filter("words", lambda w: F.coalesce(within((w["x0"] + w["x1"]) / 2, c("date_column")), F.lit(False)))
    read_day = F.when(F.exists(placed, lambda w: w["text"].rlike(r"\d")), scan.date_at(placed, F.lit(0), c("date_formats"))["date"])
    amount = F.get(F.filter(F.transform("paid", lambda m: F.struct(m["cents"].alias("cents"), F.when(within(m["c"], F.get("amount_columns", 0)), 0).when(within(m["c"], F.get("amount_columns", 1)), 1).alias("column"))), lambda m: m["column"].isNotNull()), 0)
    balance = F.get(F.filter("paid", lambda m: F.coalesce(within(m["c"], c("balance_column")), F.lit(False))), 0)["cents"]
    spoken = F.filter("words", lambda w: ((w["x0"] + w["x1"]) / 2 >= c("date_column")["x1"]) & ((w["x0"] + w["x1"]) / 2 <= F.get("amount_columns", 0)["x0"]))
    section = F.get(F.filter("sections", lambda s: s["name"] == squash(c("text"))), 0)["side"]
    read = under.withColumn("stated", read_day).withColumn("day", with_year(c("stated"), c("start")))
    read = read.withColumns({"amount": amount, "balance": balance, "said": F.array_join(F.transform(spoken, lambda w: w["text"]), " "), "n_spoken": F.size(spoken)})
    no_money = c("amount").isNull() & c("balance").isNull()
    read = read.withColumn("heading", F.when(c("day").isNull() & no_money, section)).withColumn("is_summary", c("summary") & c("day").isNotNull() & c("amount").isNotNull())
    alone = c("day").isNull() & no_money & c("heading").isNull() & (F.size("words") == c("n_spoken"))
    # What is written of a line: no words, amounts or layouts again.
    return told_rows(read.select(*CAND, "page", "line_no", "day", c("amount.cents").alias("amount"), c("amount.column").alias("column"), "balance", "heading", "is_summary", "said", alone.alias("alone"), "strategy", "opening", "start", "end"))


def told_rows(read: DataFrame) -> DataFrame:
    """Lines by what stands in their bands (day, amount, its column, balance, heading),
    as rows: side, cents, date, ``emits`` and ``kept``, ``recovered`` and
    ``date_inherited``."""
    c = F.col
    read = chained_rows(written(_resets(read), "read"))
    order = Window.partitionBy(*CAND).orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    read = read.withColumn("previous", F.coalesce(F.last(F.when(c("resets") | c("chained"), c("balance")), ignorenulls=True).over(before), c("opening")))
    by_strategy = {k: rows.side_of(k, c("amount"), column=c("column"), section=F.when(c("section") == "deposit", "deposits").when(c("section") == "withdrawal", "withdrawals"), before=c("previous"), balance=c("balance")) for k in ("two_columns", "signed", "sections", "balance_delta")}
    side = None
    for k, v in by_strategy.items():
        side = F.when(c("strategy") == k, v) if side is None else side.when(c("strategy") == k, v)
    read = read.withColumn("side", side)
    undated = c("chained")
    recovered = c("day").isNotNull() & c("amount").isNull() & c("balance").isNotNull() & c("previous").isNotNull()
    step = c("balance") - c("previous")
    read = read.withColumns({"recovered": recovered, "date_inherited": undated, "emits": c("plain") | undated | recovered})
    read = read.withColumn("date", F.coalesce("day", F.when(undated, F.coalesce(F.last(F.when(c("gives_date"), c("day")), ignorenulls=True).over(before), c("start")))))
    read = read.withColumn("side", F.when(recovered, F.when(step > 0, "deposit").otherwise("withdrawal")).otherwise(c("side"))).withColumn("cents", F.when(recovered, F.abs(step)).otherwise(F.abs("amount")))
    read = read.withColumn("kept", c("emits") & rows.breach(c("cents"), c("date"), c("side")).isNull())
    return read.select(*CAND, "page", "line_no", "date", "side", "cents", "balance", "said", "recovered", "date_inherited", "emits", "kept", "is_summary", "alone", "start", "end")


def _resets(read: DataFrame) -> DataFrame:
    """What each line does to the balance that rows are measured against, as far as it
    doesn't hang on that balance's value: ``resets`` (it becomes the line's own) and
    ``conditional`` (an undated line, which is a row only if it continues the chain);
    ``plain`` and ``gives_date`` (a dated row, and one that later rows take dates from).

    A row with a balance resets, one without a side doesn't; an amount of zero does.
    Where sides follow from the balance, and for a balance without an amount, there
    must be one to measure from (``known``)."""
    c = F.col
    order = Window.partitionBy(*CAND).orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ever = lambda x: F.coalesce(F.max(x).over(before), F.lit(False))
    read = read.withColumn("section", F.last("heading", ignorenulls=True).over(before)).withColumn("plain", c("day").isNotNull() & c("amount").isNotNull() & ~c("is_summary"))
    told, by_step = c("strategy").isin("two_columns", "signed") | ((c("strategy") == "sections") & c("section").isNotNull()), c("strategy") == "balance_delta"
    zero, shown = c("amount") == 0, c("balance").isNotNull()
    read = read.withColumn("sets", F.coalesce(c("plain") & shown & (zero | told), F.lit(False)))
    read = read.withColumn("known", c("opening").isNotNull() | ever(c("sets")))
    alone = c("day").isNotNull() & c("amount").isNull() & shown
    read = read.withColumn("resets", c("sets") | F.coalesce(c("known") & ((c("plain") & shown & ~zero & by_step) | alone), F.lit(False)))
    read = read.withColumn("gives_date", F.coalesce(c("plain") & ~zero & (told | (by_step & shown & c("known"))), F.lit(False)))
    dated = c("start").isNotNull() | ever(c("gives_date"))
    waits = c("day").isNull() & ~zero & shown & c("known") & dated & (told | by_step)
    return read.withColumn("conditional", F.coalesce(waits, F.lit(False))).drop("sets", "known")


def chained_rows(read: DataFrame) -> DataFrame:
    """``read`` with ``chained``: undated lines that are rows. Each is one if its balance
    is the balance so far and its amount; then the balance so far is its own. So they
    are told in order, from one line that resets the balance to the next: a fold over
    the undated lines between, which few are, with a mark for each as its result."""
    c = F.col
    waiting = read.where("conditional")
    if waiting.isEmpty():
        return read.withColumn("chained", F.lit(False))
    order = Window.partitionBy(*CAND).orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("island", F.coalesce(F.sum(c("resets").cast("int")).over(before), F.lit(0))).withColumn("from", F.coalesce(F.last(F.when(c("resets"), c("balance")), ignorenulls=True).over(before), c("opening"))).where("conditional")
    size = F.abs("amount")
    side = F.when(c("strategy") == "two_columns", c("column") == 0).when(c("strategy") == "signed", c("amount") > 0).when(c("strategy") == "sections", c("section") == "deposit")
    # The balance before it that makes a line a row; two where the step tells the side.
    after_in, after_out = F.when(F.coalesce(side, F.lit(True)), c("balance") - size), F.when(F.coalesce(~side, F.lit(True)), c("balance") + size)
    islands = placed.groupBy(*CAND, "island").agg(F.first("from").alias("from"), F.array_sort(F.collect_list(F.struct("line_no", after_in.alias("a"), after_out.alias("b"), "balance"))).alias("l"))
    holds = lambda s, x: F.coalesce(s["at"] == x["a"], F.lit(False)) | F.coalesce(s["at"] == x["b"], F.lit(False))
    start = F.struct(c("from").alias("at"), F.lit("").alias("marks"))
    told = F.aggregate("l", start, lambda s, x: F.struct(F.when(holds(s, x), x["balance"]).otherwise(s["at"]).alias("at"), F.concat(s["marks"], F.when(holds(s, x), "+").otherwise("-")).alias("marks")))["marks"]
    each = islands.select(*CAND, "l", told.alias("marks")).select(*CAND, "marks", F.posexplode("l").alias("i", "x"))
    found = each.where(F.substring("marks", c("i") + 1, F.lit(1)) == "+").select(*CAND, c("x.line_no").alias("line_no"), F.lit(True).alias("chained"))
    return read.join(found, [*CAND, "line_no"], "left").withColumn("chained", F.coalesce("chained", F.lit(False)))


def transactions(read: DataFrame) -> DataFrame:
    """Rows of every period under each candidate layout (of table_rows): date,
    description, side, cents, balance, recovered (amount taken from the balance
    step), date_inherited. Zero amounts and rows without a side are no rows."""
    c = F.col
    order = Window.partitionBy(*CAND).orderBy("line_no")
    # A line of words in the description band alone goes on with the row above it.
    read = read.withColumn("row_no", F.sum(c("kept").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = read.where((c("kept") | (~c("emits") & c("alone"))) & (c("row_no") > 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), " ")
    head = F.min_by(F.struct("page", "line_no", "date", "side", "cents", "balance", "recovered", "date_inherited", "start", "end"), "line_no").alias("r")
    out = parts.groupBy(*CAND, "row_no").agg(head, text.alias("description"))
    out = out.select(*CAND, (c("row_no") - 1).cast("int").alias("row_index"), "r.*", "description")
    return _placed_in_period(out)


def _placed_in_period(found: DataFrame) -> DataFrame:
    return found.withColumn("out_of_period", rows.outside(F.col("date"), F.col("start"), F.col("end"))).withColumn("yearless", F.year("date") == SENTINEL_YEAR).drop("start", "end")


def listing_rows(lines: DataFrame, cycles: DataFrame) -> DataFrame:
    """Rows of the listings of every period, whatever the layout; side null where
    neither a heading nor the header says it."""
    each = lines.where("records is not null").select(*PERIOD, "page", "line_no", F.col("listing_side").alias("side"), F.posexplode("records").alias("slot", "r"))
    each = each.join(cycles, PERIOD, "left").select(*PERIOD, "page", "line_no", "slot", "side", "start", "end", with_year(F.col("r.date"), F.col("start")).alias("date"), "r.cents", "r.description")
    return _placed_in_period(each)


#: What the rows of a layout leave in doubt, by the flags of table_rows.
WARNINGS = {
    "before_any_section": "emits and side is null and cents <> 0",
    "zero_amount": "emits and cents = 0 and not recovered",
    "amount_from_balance": "kept and recovered",
    "summary_table": "is_summary",
    "against_contract": "emits and cents < 0",
    "placeholder_year": "kept and start is null and year(date) = 1904",
    "date_from_row_before": "kept and date_inherited",
    "no_date": "emits and cents <> 0 and side is not null and date is null",
}


def row_warnings(read: DataFrame) -> DataFrame:
    """CAND, warning, n: kinds of ``WARNINGS`` that occur."""
    counts = read.groupBy(*CAND).agg(*[F.count_if(F.expr(cond)).alias(k) for k, cond in WARNINGS.items()])
    return counts.unpivot(CAND, list(WARNINGS), "warning", "n").where("n > 0")


def cycles_of(pages: DataFrame) -> DataFrame:
    """Start, end and last digits of the account of every period."""
    cycles = pages.groupBy(*PERIOD).agg(F.min_by("cycle", F.when(F.col("cycle").isNotNull(), F.struct(F.col("cycle.start").isNull() | F.col("cycle.end").isNull(), "page"))).alias("cycle"), F.min_by("last4", F.when(F.col("last4").isNotNull(), F.col("page"))).alias("last4"))
    return cycles.select(*PERIOD, F.col("cycle.start").alias("start"), F.col("cycle.end").alias("end"), "last4")


def held(words: DataFrame) -> DataFrame:
    """Words with a source, written: they are looked at several times, and may be dear
    to make. Others as they are."""
    return written(words, "words") if "source" in words.columns else words


def pages_of(lines: DataFrame) -> DataFrame:
    """Pages with their periods, of ``lines_of`` alone."""
    return written(periods(page_anchors(line_facts(lines))), "pages")


def heads(lines: DataFrame) -> DataFrame:
    """Printed figures, bank, account and cycle of every period, of ``lines_of``; no more
    is read of a line than whether it is dated and what amounts are in its text."""
    plain = written(line_facts(lines).select("doc_id", "page", "line_no", "text", "words", "dated", "money"), "plain")
    pages = written(periods(page_anchors(plain)), "pages")
    placed = written(split_header(plain.join(pages.select("doc_id", "page", "period"), ["doc_id", "page"])), "head_lines")
    return printed_figures(placed).join(cycles_of(pages), PERIOD, "left")


def extract(words: DataFrame, layouts_given: DataFrame | None = None, turns: DataFrame | None = None, budget: float = repair.BUDGET, prices: tuple[float, float] = (0.0, 0.0)) -> dict[str, DataFrame]:
    """``transactions`` (of the best candidate), ``checks`` (tie-out, diagnosis and
    audit, one row a period), ``files`` (one row a document, with its worst verdict),
    ``exceptions`` (of each period the residual first, then what is in doubt, with action
    and page), ``layouts``, ``attempts`` (one row a reading that was tried), ``periods``,
    ``warnings`` and ``doubts``; with ``turns`` also ``usage``.
    Words: doc_id, page, text, x0, x1, top, height, and source where pages were
    recognised. A period without a layout ties out with no rows.

    Candidates are tried in turn, each with its listings' rows and without; a period
    that reconciles is closed, and only open ones are read under the next layout (see
    ``climb``). The first that reconciles stays, else the one that fails least.
    ``layouts_given`` (columns of ``layouts``, candidate apart; cost_usd may say what a
    layout took) are tried where none of those reconciles, and stay only if they do.
    ``turns`` of edits (see ``repair``) are taken where no layout did, within ``budget``
    dollars a document at ``prices`` a million tokens in and out.
    """
    words = held(words)
    return extract_lines(lines_of(upright(words)), words, layouts_given, turns, budget, prices)


def extract_lines(read_lines: DataFrame, words: DataFrame, layouts_given: DataFrame | None = None, turns: DataFrame | None = None, budget: float = repair.BUDGET, prices: tuple[float, float] = (0.0, 0.0)) -> dict[str, DataFrame]:
    """``extract`` of lines (of ``lines_of``) and the words they are made of."""
    facts = written(listing.with_listings(line_facts(read_lines)), "facts")
    pages = written(periods(page_anchors(facts)), "pages")
    lines = written(split_header(facts.join(pages.select("doc_id", "page", "period"), ["doc_id", "page"])), "placed")
    cycles = cycles_of(pages)
    figures = written(printed_figures(lines), "figures")
    profiles = wider_first(distinct_layouts(layouts(lines)))
    if layouts_given is not None:
        given = layouts_given.withColumn("candidate", F.lit(GIVEN)).select(*profiles.columns)
        profiles = profiles.unionByName(given)
    profiles = written(profiles, "layouts")
    listed = written(listing_rows(lines, cycles), "listed")
    attempts, every, read = climb(lines, profiles, figures, cycles, listed)
    best = written(_best(attempts), "best")
    kept = written(_kept(every, best), "kept")
    repaired = usage = None
    if turns is not None:
        best, kept, repaired, usage = _repaired(turns, best, kept, attempts, cycles, layouts_given, budget, prices)
    warned = _warnings(read, listed, best, words, repaired)
    doubts = written(audit.doubt_items(kept, warned, best.select(*PERIOD)), "doubts")
    shown = lines.select(*PERIOD, "page", F.explode("money").alias("m")).select(*PERIOD, "page", "m.cents")
    told = diagnose.residual_matches(diagnose.count_signature(best), kept, shown, PERIOD).join(_breaks(kept, figures), PERIOD, "left")
    diagnosed = diagnose.details(diagnose.diagnose(told))
    counted = doubts.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("doubted"))
    judged = audit.sides(audit.completeness(diagnosed)).join(counted, PERIOD, "left").fillna(0, ["doubted"])
    audited = audit.next_steps(audit.verdict(audit.attribution(judged, F.col("doubted"))))
    path = F.when(F.col("candidate") == GIVEN, "given_layout").otherwise("deterministic")
    if repaired is not None:
        audited = audited.join(repaired.select(*PERIOD, F.lit(True).alias("repaired")), PERIOD, "left")
        path = F.when(F.col("repaired"), "repaired").otherwise(path)
    checks = audited.withColumn("path", path).drop("repaired").join(cycles, PERIOD, "left").join(figures.select(*PERIOD, "bank"), PERIOD, "left")
    checks = written(checks, "checks")
    exceptions = audit.exceptions(checks, doubts)
    counted = exceptions.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_exceptions"))
    files = reconcile.rollup(checks, DOC, "period").join(audit.file_verdict(checks, DOC).select(*DOC, "verdict"), DOC).join(counted, DOC, "left").fillna(0, ["n_exceptions"])
    out = {"transactions": kept, "checks": checks, "files": files, "exceptions": exceptions, "layouts": profiles, "attempts": attempts, "periods": pages, "warnings": warned, "doubts": doubts}
    return out | ({"usage": usage} if usage is not None else {})


def climb(lines: DataFrame, profiles: DataFrame, figures: DataFrame, cycles: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings of the periods, layout by layout: tie-outs (TRIED), rows and lines read.

    The frontier is the periods that no layout has closed yet. A turn reads and ties
    out the frontier alone, under its next layout, and writes what came of it; so a
    layout of a later rank costs what is still open, not what there is. There are at
    most ``POOLED`` turns and one more for layouts that were given.
    """
    printed = figures.drop("bank")
    sided = listed.where("side is not null and cents <> 0")
    order = Window.partitionBy(*PERIOD).orderBy("candidate")
    dealt = profiles.withColumn("turn", F.when(F.col("candidate") == GIVEN, POOLED + 1).otherwise(F.row_number().over(order)))
    # A period for which no layout was found is tried with none, whatever was given for it.
    none = printed.join(profiles.where(F.col("candidate") != GIVEN).select(*PERIOD), PERIOD, "left_anti").withColumn("candidate", F.lit(0))
    attempts = every = read = None
    for turn in range(1, POOLED + 2):
        now = dealt.where(F.col("turn") == turn).drop("turn")
        if attempts is not None:
            now = written(now.join(attempts.where("reconciled").select(*PERIOD), PERIOD, "left_anti"), "frontier")
            if now.isEmpty():
                continue
        seen = table_rows(lines, now, figures, cycles)
        tried = now.select(*CAND)
        found = written(_variants(transactions(seen), sided, tried), "every_row")
        plain = printed.join(tried, PERIOD).withColumn("variant", F.lit(0))
        both = plain.unionByName(plain.drop("variant").join(sided.select(*PERIOD).distinct().withColumn("variant", F.lit(1)), PERIOD).select(*plain.columns))
        if turn == 1:
            both = both.unionByName(none.withColumn("variant", F.lit(0)))
        guessed = found.groupBy(*TRIED).agg(F.count_if("recovered").alias("n_recovered"))
        checks = reconcile.reconcile(both, found, TRIED).join(guessed, TRIED, "left").fillna(0, ["n_recovered"])
        checks = written(checks.join(_repeating(found, sided, tried), TRIED, "left").fillna(False, ["repeats"]), "attempts")
        attempts, every, read = (new if old is None else old.unionByName(new) for old, new in ((attempts, checks), (every, found), (read, seen)))
    return attempts, every, read


def _variants(found: DataFrame, sided: DataFrame, tried: DataFrame) -> DataFrame:
    """Rows of the table alone (variant 0) and, where a period has listings, with
    theirs (variant 1)."""
    has = sided.select(*PERIOD).distinct().withColumn("listings", F.lit(True))
    table = found.join(has, PERIOD, "left").withColumn("variant", F.explode(F.when(F.col("listings"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("listings")
    more = sided.drop("slot").join(tried, PERIOD).withColumns({"variant": F.lit(1), "recovered": F.lit(False), "date_inherited": F.lit(False)})
    return table.unionByName(more, allowMissingColumns=True)


def _repeating(found: DataFrame, sided: DataFrame, tried: DataFrame) -> DataFrame:
    """TRIED, ``repeats``: readings with listings of which the table holds every row
    already (as often, of one date, side and amount)."""
    what, n = ["date", "side", "cents"], F.count(F.lit(1))
    asked = sided.groupBy(*PERIOD, *what).agg(n.alias("asked")).join(tried, PERIOD)
    held = found.where("variant = 0").join(sided.select(*PERIOD), PERIOD, "left_semi").groupBy(*CAND, *what).agg(n.alias("held"))
    both = asked.join(held, [*CAND, *what], "left").groupBy(*CAND).agg(F.bool_and(F.coalesce(F.col("asked") <= F.col("held"), F.lit(False))).alias("repeats"))
    return both.select(*CAND, F.lit(1).alias("variant"), "repeats")


def _best(attempts: DataFrame) -> DataFrame:
    """The best reading of each period: of every layout its better variant, of these
    the first that reconciles, else the one that fails least. A listing that repeats
    the table's rows is added only where the period reconciles with it."""
    attempts = attempts.where("reconciled or not repeats").drop("repeats")
    variant = rows.best_candidate(attempts.withColumnRenamed("candidate", "layout").withColumnRenamed("variant", "candidate"), [*PERIOD, "layout"])
    variant = variant.withColumnRenamed("candidate", "variant").withColumnRenamed("layout", "candidate")
    free = variant.where((F.col("candidate") != GIVEN) | F.col("reconciled"))
    return rows.best_candidate(free, PERIOD, first_reconciled=True)


def _kept(every: DataFrame, best: DataFrame) -> DataFrame:
    kept = every.join(best.select(*TRIED), TRIED, "left_semi")
    order = Window.partitionBy(*PERIOD).orderBy("page", "line_no", "row_index", "description", "cents")
    return kept.withColumn("row_index", (F.row_number().over(order) - 1).cast("int"))


def _repaired(turns: DataFrame, best: DataFrame, kept: DataFrame, attempts: DataFrame, cycles: DataFrame, layouts_given: DataFrame | None, budget: float, prices: tuple[float, float]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Best readings and rows with the edits of the periods that close with them; these
    periods with their number of edits; and what each period's turns took."""
    c = F.col
    failed = best.where("not reconciled")
    counts = kept.join(failed, PERIOD, "left_semi").groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("n"))
    taking = written(repair.numbered(turns.join(failed, PERIOD, "left_semi")), "turns")
    located = written(repair.placed(repair.edits_of(taking), counts), "edits")
    spent = None
    if layouts_given is not None and "cost_usd" in layouts_given.columns:
        spent = layouts_given.groupBy(*PERIOD).agg(F.sum("cost_usd").alias("cost")).join(attempts.where(c("candidate") == GIVEN), PERIOD, "left_semi")
    played = written(repair.outcome(taking, located, kept, failed, prices, budget, spent), "outcome")
    closed = written(played.where("closes").select(*PERIOD, c("turn").alias("upto"), "n_edits"), "closed")
    again = repair.edited(kept, located, closed).join(cycles.select(*PERIOD, "start", "end"), PERIOD, "left")
    again = again.withColumn("out_of_period", F.coalesce("out_of_period", rows.outside(c("date"), c("start"), c("end")))).fillna(False, ["recovered", "date_inherited", "yearless"]).select(*kept.columns)
    of = best.join(closed, PERIOD, "left_semi")
    again = written(again.drop("candidate", "variant").join(of.select(*TRIED), PERIOD).select(*kept.columns), "repaired_rows")
    checked = reconcile.reconcile(of.select(*TRIED, *reconcile.PRINTED), again, TRIED).join(again.groupBy(*TRIED).agg(F.count_if("recovered").alias("n_recovered")), TRIED, "left").fillna(0, ["n_recovered"])
    best = written(best.join(closed, PERIOD, "left_anti").unionByName(checked.select(*best.columns)), "best")
    kept = written(kept.join(closed, PERIOD, "left_anti").unionByName(again), "kept")
    took = taking.join(played.where("taken"), [*PERIOD, "turn"])
    usage = took.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost_usd"))
    return best, kept, closed.select(*PERIOD, "n_edits"), usage


def _breaks(kept: DataFrame, figures: DataFrame) -> DataFrame:
    """Where the running balance of a period breaks first, if all its rows print one."""
    signed = kept.withColumn("signed", rows.signed()).join(figures.select(*PERIOD, F.col("beginning").alias("opening")), PERIOD)
    whole = Window.partitionBy(*PERIOD)
    chain = signed.withColumn("all_balances", (F.count("balance").over(whole) == F.count(F.lit(1)).over(whole)) & F.col("opening").isNotNull()).where("all_balances")
    return diagnose.chain_breaks(chain, PERIOD, ["row_index"], F.col("opening")).select(*PERIOD, F.col("row_index").alias("break_index"), F.col("amount").alias("break_amount"))


def _warnings(read: DataFrame, listed: DataFrame, best: DataFrame, words: DataFrame, repaired: DataFrame | None) -> DataFrame:
    """PERIOD, warning, n, of the reading that stays; written."""
    own = row_warnings(read).join(best.select(*CAND), CAND, "left_semi").select(*PERIOD, "warning", "n")
    none = best.where("candidate = 0").select(*PERIOD, F.lit("no_layout").alias("warning"), F.lit(1).cast("bigint").alias("n"))
    counted = listed.groupBy(*PERIOD).agg(F.count_if(F.col("side").isNull()).alias("unsided"), F.count_if(F.col("side").isNotNull() & (F.col("cents") != 0)).alias("sided"), F.count_if(F.col("side").isNotNull() & (F.col("cents") == 0)).alias("zero")).join(best.select(*PERIOD, "candidate", "variant"), PERIOD).where("candidate > 0")
    kinds = {"listing_without_side": "unsided", "listing_added": "if(variant = 1, sided, 0)", "listing_left_out": "if(variant = 0, sided, 0)", "zero_amount": "zero"}
    of_listing = counted.select(*PERIOD, F.explode(F.array(*[F.struct(F.lit(k).alias("warning"), F.expr(v).cast("bigint").alias("n")) for k, v in kinds.items()])).alias("w")).select(*PERIOD, "w.*").where("n > 0")
    out = own.unionByName(none).unionByName(of_listing)
    if repaired is not None:
        out = out.unionByName(repaired.select(*PERIOD, F.lit("rows_repaired").alias("warning"), F.col("n_edits").alias("n")))
    if "source" in words.columns:
        pages = words.where(F.col("source").isin(*RECOGNISED)).select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(pages.join(best.groupBy("doc_id").agg(F.min("period").alias("period")), "doc_id").select(*PERIOD, F.lit("no_text_layer").alias("warning"), "n"))
    return written(out.groupBy(*PERIOD, "warning").agg(F.sum("n").alias("n")), "warnings")


def nested(results: dict[str, DataFrame]) -> DataFrame:
    """One row a document: its periods with figures, checks and transactions."""
    listed = results["transactions"].groupBy(*PERIOD).agg(F.array_sort(F.collect_list(F.struct("row_index", "date", "description", "side", "cents", "page", "recovered", "date_inherited"))).alias("transactions"))
    each = results["checks"].join(listed, PERIOD, "left")
    period = F.struct("period", "bank", "last4", "start", "end", "path", "verdict", "detail", "beginning", "ending", "reconciled", "residual", "diagnosis", *[f"check_{x}" for x in reconcile.CHECKS], "transactions")
    return each.groupBy(*DOC).agg(F.array_sort(F.collect_list(period)).alias("periods"), F.bool_and("reconciled").alias("reconciled"), F.sum("residual").alias("residual"))
