"""Listings: records set several to a line, under a header that repeats.

A listing's header names a date and an amount twice or more. Its slots are bands
from the middle between one group's last word and the next one's first; a slot of
a line below holds a record if it has a date and an amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scan
from ledgerloom.functions.money import find_money
from ledgerloom.functions.text import heading_side

MIN_SLOTS = 2
# What a listing's header calls its columns.
DATE, AMOUNT, CHECK = ("date",), ("amount",), ("check", "cheque", "chk")


def names(word: Column, vocabulary: tuple[str, ...]) -> Column:
    return word["text"].rlike("(?iu)^[.:#]*(?:" + "|".join(vocabulary) + ")")


def header_of(words: Column) -> Column:
    """struct<slots array<struct<x0, x1>>, check>, or null: the slots that a line
    declares, half-open, the outer ones unbounded, and whether it names a check."""
    ends = F.filter(F.transform(words, lambda w, i: F.when(names(w, AMOUNT), i)), lambda i: i.isNotNull())

    def read(e: Column) -> Column:
        first = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1) + 1)
        dated = F.forall(F.sequence(F.lit(0), F.size(e) - 1), lambda j: F.exists(F.slice(words, first(j) + 1, F.get(e, j) - first(j) + 1), lambda w: names(w, DATE)))
        edge = lambda j: (F.get(words, F.get(e, j))["x1"] + F.get(words, F.get(e, j) + 1)["x0"]) / 2
        band = lambda j: F.struct(F.when(j == 0, F.lit(float("-inf"))).otherwise(edge(j - 1)).alias("x0"), F.when(j == F.size(e) - 1, F.lit(float("inf"))).otherwise(edge(j)).alias("x1"))
        slots = F.transform(F.sequence(F.lit(0), F.size(e) - 1), band)
        return F.when((F.size(e) >= MIN_SLOTS) & plain & dated, F.struct(slots.alias("slots"), F.exists(words, lambda w: names(w, CHECK)).alias("check")))

    # No amount is without a point.
    plain = ~F.exists(words, lambda w: w["text"].contains(".") & (F.size(find_money(w["text"])) > 0))
    return F.when(F.size(words) > 0, scan.let(ends, read))


def records_of(slots: Column, words: Column) -> Column:
    """array<struct<date, cents, description>>: by slot, leftmost date, last amount
    (its magnitude), the other words."""

    def read(w: Column) -> Column:
        paid = F.element_at(F.concat(F.array(F.lit(None).cast("struct<cents:bigint,x0:double,x1:double,c:double,k:int,i:int>")), scan.amounts(w)), -1)
        return scan.let(F.struct(F.get(scan.dates(w), 0).alias("day"), paid.alias("paid")), lambda f: record(w, f["day"], f["paid"]))

    def record(w: Column, day: Column, paid: Column) -> Column:
        taken = lambda i: ((i >= day["i"]) & (i < day["i"] + day["k"])) | ((i >= paid["i"]) & (i < paid["i"] + paid["k"]))
        rest = F.array_join(F.transform(F.filter(w, lambda x, i: ~taken(i)), lambda x: x["text"]), " ")
        return F.when(day.isNotNull() & paid.isNotNull(), F.struct(day["date"].alias("date"), F.abs(paid["cents"]).alias("cents"), rest.alias("description")))

    held = lambda s: F.filter(words, lambda w: ((w["x0"] + w["x1"]) / 2 >= s["x0"]) & ((w["x0"] + w["x1"]) / 2 < s["x1"]))
    found = F.transform(slots, lambda s: scan.let(held(s), read))
    return F.filter(found, lambda r: r.isNotNull())


def with_listings(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, page, line_no, words, text, dated, cells, money) with
    records (of a listing line, else null), listing_side (of the last heading
    above the listing's header that names a side, else withdrawal where the header
    names a check; null if neither) and listing_header.

    A listing goes on from its header over lines with records and lines of no
    meaning; a heading that names a side, an amount or a date ends it, and so does
    its page.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    whole = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    bare = ~c("dated") & (F.size("cells") == 0)
    seen = lines.withColumn("heading_side", F.when(bare, heading_side(c("text")))).withColumn("declares", F.when(bare, header_of(c("words"))))
    seen = seen.withColumn("said", F.last("heading_side", ignorenulls=True).over(whole))
    opened = F.when(c("declares").isNotNull(), F.struct(c("declares.slots").alias("slots"), F.coalesce(c("said"), F.when(c("declares.check"), "withdrawal")).alias("side"), c("line_no").alias("no")))
    seen = seen.withColumn("open", F.last(opened, ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("records", F.when(c("open").isNotNull() & c("text").rlike(r"\d"), records_of(c("open.slots"), c("words"))))
    none = F.coalesce(F.size("records"), F.lit(0)) <= 0
    ends = c("open").isNotNull() & none & (c("heading_side").isNotNull() | (F.size("money") > 0) | c("dated"))
    under = Window.partitionBy("doc_id", "page", "open.no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("ended", F.max(ends.cast("int")).over(under))
    inside = c("open").isNotNull() & (c("ended") == 0)
    out = seen.withColumn("in_listing", F.coalesce(inside, F.lit(False))).withColumn("records", F.when(c("in_listing") & ~none, c("records"))).withColumn("listing_side", F.when(c("in_listing"), c("open.side")))
    return out.withColumn("listing_header", c("declares").isNotNull()).drop("heading_side", "declares", "said", "open", "ended")
