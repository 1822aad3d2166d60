"""Reading an array of words from left to right: amounts and dates that are split
over touching boxes, and what a line holds in order.

A word is a struct with text, x0, x1 at least.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import GOES_ON, LIKELY, MAX_WORDS, OPENS, read_date
from ledgerloom.functions.money import PART, parse_money

#: Boxes with at most this between them are parts of one value, of three at most.
TOUCHING, FRAGMENTS = 4.0, 3
#: Characters that are read for the digit 1.
ONES = "iIl|"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def texts(words: Column) -> Column:
    return F.transform(words, lambda w: w["text"])


def touching(words: Column) -> Column:
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.size(words)).alias("b"))
    return (F.size(words) < 2) | F.forall(pairs, lambda p: p["b"]["x0"] - p["a"]["x1"] <= TOUCHING)


def _joined_money(group: Column) -> Column:
    t = texts(group)
    last = F.element_at(t, -1)
    pointed = F.when(last.rlike(r"^\d{2}$"), F.concat(F.array_join(F.slice(t, 1, F.size(t) - 1), ""), F.lit("."), last))
    return F.when(touching(group), F.coalesce(parse_money(F.array_join(t, " ")), parse_money(F.array_join(t, "")), parse_money(pointed)))


def money_at(words: Column, i: Column) -> Column:
    """struct<cents, k>: the amount that the k words from place i on spell, or null:
    one word, or else touching boxes as they stand or with the point put back
    before a last box of two digits."""
    amount = lambda cents, k: F.struct(cents.alias("cents"), F.lit(k).alias("k"))

    def parts(k: int) -> Column:
        cents = F.when(i + k <= F.size(words), let(F.slice(words, i + 1, k), _joined_money))
        less = parts(k - 1) if k > 2 else F.lit(None)
        return let(cents, lambda c: F.when(c.isNotNull(), amount(c, k)).otherwise(less))

    # Boxes are joined only where the next one touches and may be part of an amount.
    part = lambda j: F.coalesce(F.get(words, j)["text"].rlike(PART), F.lit(True))
    near = (F.get(words, i + 1)["x0"] - F.get(words, i)["x1"] <= TOUCHING) & part(i + 1)
    found = let(parse_money(F.get(words, i)["text"]), lambda c: F.when(c.isNotNull(), amount(c, 1)).when(near, parts(FRAGMENTS)))
    return F.when(part(i), F.when(F.exists(F.slice(words, i + 1, FRAGMENTS), lambda w: w["text"].rlike(r"\d")), found))


def date_at(words: Column, i: Column, only: Column | None = None) -> Column:
    """struct<date, k, notation>: the date that the words from place i on spell, of
    the most words, up to four; joined by blanks, or bare where boxes touch; with a
    1 for its look-alikes where that makes a date. Null if none does, in one of the
    notations ``only`` where these are given."""

    def forms(k: int, reach: Column) -> list[Column]:
        group = F.slice(words, i + 1, k)
        spaced, bare = F.array_join(texts(group), " "), F.when(touching(group), F.array_join(texts(group), "")) if k > 1 else None
        out = []
        for t in (spaced, bare):
            if t is not None:
                out += [t, F.when(t.rlike(f"[{ONES}]"), F.translate(t, ONES, "1" * len(ONES)))]
        return [F.struct(F.when((i + k <= F.size(words)) & (reach >= k), t).alias("t"), F.lit(k).alias("k")) for t in out]

    # Words past one that no date goes on with aren't tried.
    goes = [F.coalesce(F.get(words, i + k)["text"].rlike(GOES_ON), F.lit(True)) for k in range(1, MAX_WORDS)]
    reach = F.lit(MAX_WORDS)
    for k in range(MAX_WORDS - 1, 0, -1):
        reach = F.when(~goes[k - 1], F.lit(k)).otherwise(reach)

    def tried(reach: Column) -> Column:
        tries = F.array(*[f for k in range(MAX_WORDS, 0, -1) for f in forms(k, reach)])
        likely = F.filter(tries, lambda c: c["t"].rlike(LIKELY))
        return F.transform(likely, lambda c: let(read_date(c["t"]), lambda r: F.struct(r["date"].alias("date"), c["k"].alias("k"), r["notation"].alias("notation"))))

    read = let(reach, tried)
    fits = lambda c: c["date"].isNotNull() if only is None else c["date"].isNotNull() & F.array_contains(only, c["notation"])
    opens = F.coalesce(F.get(words, i)["text"].rlike(OPENS), F.lit(True))
    return F.when(opens, F.get(F.filter(read, fits), 0))


def leftmost(words: Column, at, kind: str) -> Column:
    """array<kind> of what ``at(words, i)`` finds (a struct with k, the words it
    takes, or null), left to right, reading on after those words. The place is
    added as i."""
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("found"), F.lit(0).alias("next"))

    def step(s: Column, i: Column) -> Column:
        def taken(hit: Column) -> Column:
            return F.when(hit.isNull(), s).otherwise(F.struct(F.concat(s["found"], F.array(hit)).alias("found"), (i + hit["k"]).alias("next")))

        return let(F.when(i >= s["next"], at(words, i)), taken)

    return F.when(F.size(words) > 0, F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), start, step, lambda s: s["found"])).otherwise(start["found"])


def amounts(words: Column) -> Column:
    """array<struct<cents, x0, x1, c, k, i>> of a line's amounts."""

    def at(w: Column, i: Column) -> Column:
        def placed(m: Column) -> Column:
            x0, x1 = F.get(w, i)["x0"], F.get(w, i + m["k"] - 1)["x1"]
            return F.when(m.isNotNull(), F.struct(m["cents"].alias("cents"), x0.alias("x0"), x1.alias("x1"), ((x0 + x1) / 2).alias("c"), m["k"].alias("k"), i.alias("i")))

        return let(money_at(w, i), placed)

    return leftmost(words, at, "struct<cents:bigint,x0:double,x1:double,c:double,k:int,i:int>")


def dates(words: Column) -> Column:
    """array<struct<date, k, i>> of a line's dates."""

    def at(w: Column, i: Column) -> Column:
        return let(date_at(w, i), lambda d: F.when(d.isNotNull(), F.struct(d["date"].alias("date"), d["k"].alias("k"), i.alias("i"))))

    return leftmost(words, at, "struct<date:date,k:int,i:int>")


def is_summary(amounts_: Column, dates_: Column) -> Column:
    """A date, an amount after it and another date after that, on one line: a table
    of several columns, no transaction."""
    first = F.array_min(F.transform(dates_, lambda d: d["i"]))
    paid = F.array_min(F.transform(F.filter(amounts_, lambda m: m["i"] > first), lambda m: m["i"]))
    return F.coalesce(F.exists(dates_, lambda d: d["i"] > paid), F.lit(False))
