"""What a statement prints about itself, off the lines above its first row: labels
over amounts, the bank's letterhead, the account and the cycle.

``lines``: keys, page, line_no, words, text, dated, money (amounts in the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import find_dates
from ledgerloom.functions.money import find_money
from ledgerloom.functions.scan import let
from ledgerloom.functions.text import LABELS, names_side, squash

LETTERHEAD_LINES = 15
SIZE_RATIO = 0.85
MIN_LABELS = 2
SPAN_WORDS = 8


def grams(words: Column) -> Column:
    """array<struct<t, c>>: stretches of up to eight words, squashed, and their
    middles; by first word, shortest first."""
    of = lambda i, k: F.struct(squash(F.array_join(F.transform(F.slice(words, i + 1, k), lambda w: w["text"]), "")).alias("t"), ((F.get(words, i)["x0"] + F.get(words, i + k - 1)["x1"]) / 2).alias("c"))
    starts = F.sequence(F.lit(0), F.size(words) - 1)
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(SPAN_WORDS), F.size(words) - i)), lambda k: of(i, k))))


def assigned(labels: Column, values: Column) -> Column:
    """array<struct<field, cents>>: each label (field, c) gets the nearest value
    (cents, c); nearest pairs first, no value twice."""
    pairs = F.flatten(F.transform(labels, lambda a: F.transform(values, lambda b, i: F.struct(F.abs(b["c"] - a["c"]).alias("far"), a["field"].alias("field"), i.alias("i"), b["cents"].alias("cents")))))
    start = F.expr("cast(array() as array<struct<field:string,i:int,cents:bigint>>)")
    free = lambda done, p: ~F.exists(done, lambda d: (d["field"] == p["field"]) | (d["i"] == p["i"]))
    fold = F.aggregate(F.array_sort(pairs), start, lambda done, p: F.when(free(done, p), F.concat(done, F.array(F.struct(p["field"].alias("field"), p["i"].alias("i"), p["cents"].alias("cents"))))).otherwise(done))
    return F.transform(fold, lambda d: F.struct(d["field"].alias("field"), d["cents"].alias("cents")))


def _is(label: str):
    squashed = label.replace(" ", "")
    return lambda x: x["t"] == squashed


def horizontal(header: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block (map of field to cents): the first row of two labels or more,
    without amounts, over a row of two amounts or more, one or two lines below."""
    at = Window.partitionBy(*keys).orderBy("line_no")
    cells = F.flatten(F.transform("words", lambda w: F.transform(F.slice(find_money(w["text"]), -1, 1), lambda m: F.struct(m["cents"].alias("cents"), ((w["x0"] + w["x1"]) / 2).alias("c")))))
    some = F.when(~F.col("dated") & (F.size("money") > 0), F.when(F.size(cells) >= MIN_LABELS, cells))
    seen = header.withColumn("values", some)
    seen = seen.withColumn("below", F.coalesce(F.lead("values", 1).over(at), F.lead("values", 2).over(at)))
    named = sum((names_side(F.col("text"), f).cast("int") for f in LABELS), F.lit(0))
    seen = seen.where(~F.col("dated") & (F.size("money") == 0) & F.col("below").isNotNull() & (named >= MIN_LABELS))
    spans = let(grams(F.col("words")), lambda g: F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(*[F.get(F.filter(g, _is(t)), 0)["c"] for t in labels]).alias("c")) for f, labels in LABELS.items()]))
    spans = F.filter(F.transform(spans, lambda s: F.when(s["c"].isNotNull(), s)), lambda s: s.isNotNull())
    # A field that the line names only inside other words has no place of its own.
    found = seen.withColumn("labels", spans).where(F.size("labels") >= MIN_LABELS)
    first = found.groupBy(*keys).agg(F.min_by(F.struct("labels", "below"), "line_no").alias("b"))
    return first.select(*keys, F.map_from_entries(assigned(F.col("b.labels"), F.col("b.below"))).alias("block"))


def letterhead(header: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bank: the words set in the largest type among the first fifteen lines
    (of letters, without colon, amount or date), with the lines next to theirs
    that are all in that size."""
    top = header.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))).where(F.col("nth") <= LETTERHEAD_LINES)
    able = F.col("text").rlike(r"\p{L}") & ~F.col("text").contains(":") & (F.size("money") == 0) & (F.size(find_dates(F.col("text"))) == 0)
    held = top.where(able).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", "words"))).alias("held"))

    def read(lines: Column) -> Column:
        tallest = F.array_max(F.flatten(F.transform(lines, lambda x: F.transform(x["words"], lambda w: w["height"]))))
        floor = tallest * SIZE_RATIO
        at = F.array_position(F.transform(lines, lambda x: F.exists(x["words"], lambda w: w["height"] == tallest)), True).cast("int") - 1
        whole = F.transform(lines, lambda x: F.forall(x["words"], lambda w: w["height"] >= floor))
        near = lambda j: F.when(j < at, F.forall(F.slice(whole, j + 1, at - j), lambda y: y)).when(j > at, F.forall(F.slice(whole, at + 2, j - at), lambda y: y)).otherwise(F.lit(True))
        said = F.transform(F.filter(lines, lambda x, j: near(j)), lambda x: F.array_join(F.transform(F.filter(x["words"], lambda w: w["height"] >= floor), lambda w: w["text"]), " "))
        return F.when(tallest > 0, F.array_join(F.filter(said, lambda t: t != ""), " "))

    return held.select(*keys, let(F.col("held"), read).alias("bank"))
