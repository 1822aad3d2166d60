"""Page geometry: lines from positioned words, columns, registration, skew.

``words``: doc_id, page, text, x0, x1, top, height (points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import written

LINE_TOLERANCE = 3.0
COLUMN_GAP = 20.0
COLUMN_PAD = 2.0
EDGE_SPREAD = 2.0
MAX_SHIFT = 30.0
MIN_ROWS = 3
BIN = 1.0
MAX_SLOPE, COARSE_STEP, FINE_STEP = 0.06, 0.004, 0.0005
MIN_WORDS_FOR_SKEW = 30
#: Words of which one task counts the bins of all slopes; a page of more is dealt by slope.
WORDS_A_TASK = 32_768


def lines(words: DataFrame, keys: list[str], tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """keys, line_idx, words (by x0), text. Words go top to bottom; one joins the
    open line while its top is at most ``tolerance`` below the mean top of the
    line so far. A word further below the one before it opens a line in any case,
    so only the words between two such gaps are folded, and a page of any length
    takes time in proportion."""
    at = Window.partitionBy(*keys).orderBy("top")
    gap = F.coalesce(F.col("top") - F.lag("top").over(at) > tolerance, F.lit(True)).cast("int")
    cut = words.withColumn("gap", gap).withColumn("island", F.sum("gap").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    islands = cut.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "text", "height"))).alias("w"))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))

    def add(acc: Column, w: Column) -> Column:
        joins = (acc["n"] > 0) & (w["top"] - acc["sum"] / F.greatest(acc["n"], F.lit(1)) <= tolerance)
        starts = F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"])))
        return F.struct(starts.alias("starts"), (acc["i"] + 1).alias("i"), F.when(joins, acc["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(joins, acc["sum"] + w["top"]).otherwise(w["top"]).alias("sum"))

    # Words that all lie within the tolerance (with a margin for rounded means) are one line.
    one = F.element_at("w", -1)["top"] - F.get("w", 0)["top"] <= tolerance - 1e-6
    starts = F.when(one, F.array(F.lit(0))).otherwise(F.aggregate("w", start, add, lambda a: a["starts"]))
    folded = islands.select(*keys, "island", "w", starts.alias("starts"))
    each = folded.select(*keys, "island", "w", "starts", F.posexplode("starts").alias("part", "from"))
    mine = F.slice("w", F.col("from") + 1, F.coalesce(F.get("starts", F.col("part") + 1), F.size("w")) - F.col("from"))
    by_x = F.array_sort(F.transform(mine, lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"), x["top"].alias("top"), x["height"].alias("height"), x["text"].alias("text"))))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("island", "part")) - 1
    return each.select(*keys, order.alias("line_idx"), by_x.alias("words")).withColumn("text", F.array_join(F.transform("words", lambda x: x["text"]), " "))


def gap_clusters(points: DataFrame, keys: list[str], at: str, gap: float = COLUMN_GAP) -> DataFrame:
    """``cluster``: number of the group of points with no gap over ``gap``."""
    w = Window.partitionBy(*keys).orderBy(at)
    opens = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return points.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("opens")


def columns(cells: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Extent of every cluster of cells (x0, x1) that lines up: two rows or more,
    and one of its edges within a population deviation of 2 points."""
    stats = cells.groupBy(*keys, "cluster").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.countDistinct(row).alias("n_rows"), F.least(F.stddev_pop("x0"), F.stddev_pop("x1")).alias("spread"))
    return stats.where(f"n_rows >= 2 and spread <= {EDGE_SPREAD}").select(*keys, "cluster", (F.col("lo") - COLUMN_PAD).alias("x0"), (F.col("hi") + COLUMN_PAD).alias("x1"), "n_rows")


def row_margins(rows: DataFrame, keys: list[str], left: str) -> DataFrame:
    """keys, margin (median left edge), n: of pages with three rows or more."""
    return rows.groupBy(*keys).agg(F.median(left).alias("margin"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS)


def page_shifts(rows: DataFrame, doc: str, page: str, left: str) -> DataFrame:
    """How far each page is off the document's margin: median of the pages'
    margins less the page's, where two pages at least have one; null beyond 30
    points."""
    medians = row_margins(rows, [doc, page], left)
    target = medians.groupBy(doc).agg(F.median("margin").alias("target"), F.count(F.lit(1)).alias("pages")).where("pages >= 2")
    shift = F.col("target") - F.col("margin")
    return medians.join(target, doc).select(doc, page, "margin", F.when(F.abs(shift) <= MAX_SHIFT, shift).alias("shift"))


def sharpness(words: DataFrame, keys: list[str], slopes: Column, tasks: int | None = None) -> DataFrame:
    """Sum of squared word counts over height bins, for each slope: the larger, the
    better words line up. Bins are cut toward zero. With ``tasks`` words (which have
    ``n_words``, those of their page) are dealt over so many before slopes are tried."""
    by = [*keys, "slope"]
    if tasks is None:
        tried = words.select(*keys, "top", "x0", F.explode(slopes).alias("slope"))
    else:
        nth = F.when(F.col("n_words") > WORDS_A_TASK, F.sequence(F.lit(0), F.size(slopes) - 1)).otherwise(F.array(F.lit(-1)))
        dealt = words.withColumn("nth", F.explode(nth)).repartition(tasks, *keys, "nth")
        tried = dealt.select(*keys, "nth", "top", "x0", F.explode(F.when(F.col("nth") < 0, slopes).otherwise(F.array(F.get(slopes, F.col("nth"))))).alias("slope"))
        by = [*keys, "nth", "slope"]
    bins = tried.groupBy(*by, ((F.col("top") - F.col("x0") * F.col("slope")) / BIN).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy(*by).agg(F.sum(F.col("n") * F.col("n")).alias("sharpness")).select(*keys, "slope", "sharpness")


def best_slope(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The sharpest slope, the lowest on ties; 0 unless it beats the square page by
    a twentieth."""
    top = scores.groupBy(*keys).agg(F.max_by("slope", F.struct("sharpness", -F.col("slope"))).alias("slope"), F.max("sharpness").alias("best"), F.max(F.when(F.col("slope") == 0, F.col("sharpness"))).alias("square"))
    return top.select(*keys, F.when(F.col("best") > F.col("square") * 1.05, F.col("slope")).otherwise(F.lit(0.0)).alias("slope"))


def deskew(words: DataFrame, slope: Column) -> DataFrame:
    """Turns a page back by its slope, in both directions."""
    x0, x1, top = F.col("x0"), F.col("x1"), F.col("top")
    return words.withColumns({"x0": x0 + top * slope, "x1": x1 + top * slope, "top": top - x0 * slope})


def skew(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slope of each page: the sharpest of a coarse sweep, then of a fine one
    around it; 0 for pages of under 30 words, or where it isn't sharper than the
    square page by a twentieth."""
    pages = written(words.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_words")).where(F.col("n_words") >= MIN_WORDS_FOR_SKEW), "page_words")
    tasks = (pages.agg(F.sum("n_words")).first()[0] or 0) // WORDS_A_TASK + 1
    full = words.select(*keys, "x0", "top").join(pages, keys)
    steps = lambda step, reach: F.transform(F.sequence(F.lit(-int(reach / step)), F.lit(int(reach / step))), lambda i: i * F.lit(step))
    first = lambda scores: scores.groupBy(*keys).agg(F.max_by("slope", F.struct("sharpness", -F.col("slope"))).alias("slope"))
    coarse = written(first(sharpness(full, keys, steps(COARSE_STEP, MAX_SLOPE), tasks)), "coarse")
    around = full.join(coarse.withColumnRenamed("slope", "around"), keys)
    fine = sharpness(around, keys, F.array_distinct(F.concat(F.transform(steps(FINE_STEP, COARSE_STEP), lambda s: s + F.col("around")), F.array(F.lit(0.0)))), tasks)
    return best_slope(fine, keys)


def squared(words: DataFrame, recognised: Column) -> DataFrame:
    """``words`` with the tilt of recognised pages taken out."""
    keys = ["doc_id", "page"]
    slopes = skew(words.where(recognised), keys).where("slope <> 0").withColumnRenamed("slope", "tilt")
    turned = deskew(words.join(slopes, keys, "left").withColumn("tilt", F.coalesce("tilt", F.lit(0.0))), F.col("tilt"))
    return turned.select(*words.columns)


def registered(words: DataFrame, rows: DataFrame, recognised: Column) -> DataFrame:
    """``words`` with recognised pages moved so that their rows share one margin.
    ``rows``: doc_id, page, left (of lines that open with a date and carry money)."""
    shifts = page_shifts(rows, "doc_id", "page", "left").where("shift <> 0").select("doc_id", "page", F.col("shift").alias("moved"))
    by = F.when(recognised, F.coalesce("moved", F.lit(0.0))).otherwise(F.lit(0.0))
    return words.join(shifts, ["doc_id", "page"], "left").withColumns({"x0": F.col("x0") + by, "x1": F.col("x1") + by}).select(*words.columns)
