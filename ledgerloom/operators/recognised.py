"""Words of recognised text: stretches of a line cut into words, with what the
recognition is known to misread put right where it then makes sense.

``segments``: keys, text, x0, x1, top, bottom, rise (how far the line falls from
its left end to its right), score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.money import parse_money
from ledgerloom.functions.scan import ONES
from ledgerloom.functions.text import tokens

LEAST_SCORE = 0.5
#: A thousands separator read as a slash, bar or point; two digits end it.
MISREAD = r"^\d{1,3}(?:[/|.]\d{3})+\.\d{2}$"


def repaired(token: Column) -> Column:
    """Separators put right; else a 1 for its look-alikes if that makes the token a
    date or an amount."""
    commas = F.concat(F.translate(F.substring(token, F.lit(1), F.length(token) - 3), "/|.", ",,,"), F.right(token, F.lit(3)))
    ones = F.translate(token, ONES, "1" * len(ONES))
    sensible = token.rlike(r"\d") & (ones != token) & (parse_date(ones).isNotNull() | parse_money(ones).isNotNull())
    return F.when(token.rlike(MISREAD), commas).when(F.coalesce(sensible, F.lit(False)), ones).otherwise(token)


def line_top(x: Column) -> Column:
    """The height of a segment's line at x."""
    left = F.when(F.col("rise") >= 0, F.col("top")).otherwise(F.col("top") - F.col("rise"))
    span = F.col("x1") - F.col("x0")
    return F.when(span > 0, left + (x - F.col("x0")) / span * F.col("rise")).otherwise(left)


def rise_of(box: Column) -> Column:
    """From the four corners (x, y) of a box: how far its top edge falls."""
    high = F.slice(F.array_sort(F.transform(box, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))), 1, 2)
    by_x = F.array_sort(F.transform(high, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return F.when(by_x[0]["x"] == by_x[1]["x"], F.lit(0.0)).otherwise(by_x[1]["y"] - by_x[0]["y"])


def words_of_segments(segments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """keys, i, text, x0, x1, top, height: a segment's width is shared out by
    characters; segments of little score go."""
    some = segments.where(F.col("score") >= LEAST_SCORE).withColumn("w", tokens(F.col("text"))).where(F.size("w") > 0)
    some = some.withColumn("chars", F.aggregate("w", F.lit(0), lambda n, t: n + F.length(t)))
    each = some.select("*", F.posexplode("w").alias("i", "token"))
    before = F.aggregate(F.slice("w", 1, F.col("i")), F.lit(0), lambda n, t: n + F.length(t))
    share = (F.col("x1") - F.col("x0")) / F.col("chars")
    each = each.withColumn("at", F.col("x0") + before * share).withColumn("until", F.col("at") + F.length("token") * share)
    height = F.greatest(F.col("bottom") - F.col("top") - F.abs("rise"), F.lit(0.0)) / scale
    return each.select(*keys, "i", repaired(F.col("token")).alias("text"), (F.col("at") / scale).alias("x0"), (F.col("until") / scale).alias("x1"), (line_top(F.col("at")) / scale).alias("top"), height.alias("height"))
