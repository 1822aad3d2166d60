"""Dates in the notations of statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months by name, short and full, and the notations: the pattern of a
# text whose month name is written m<number>, and its year, month and day therein.
# What has no year comes in the sentinel year, which is a leap year.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SENTINEL_YEAR = 1904
NOTATIONS = {
    "M/d/yyyy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    "M/d/yy": (r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "$3-$1-$2"),
    "M-d-yyyy": (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$1-$2"),
    "yyyy-M-d": (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    "MMM d, yyyy": (r"^m(\d+) (\d{1,2}), (\d{4})$", "$3-$1-$2"),
    "MMM d yyyy": (r"^m(\d+) (\d{1,2}) (\d{4})$", "$3-$1-$2"),
    "d MMM yyyy": (r"^(\d{1,2}) m(\d+) (\d{4})$", "$3-$2-$1"),
    "d MMM yy": (r"^(\d{1,2}) m(\d+) (\d{2})$", "$3-$2-$1"),
    "M/d": (r"^(\d{1,2})/(\d{1,2})$", f"{SENTINEL_YEAR}-$1-$2"),
    "M-d": (r"^(\d{1,2})-(\d{1,2})$", f"{SENTINEL_YEAR}-$1-$2"),
    "MMM d": (r"^m(\d+) (\d{1,2})$", f"{SENTINEL_YEAR}-$1-$2"),
    "d MMM": (r"^(\d{1,2}) m(\d+)$", f"{SENTINEL_YEAR}-$2-$1"),
}
LONGEST = 16
YEARLESS = ("M/d", "M-d", "MMM d", "d MMM")
#: The hyphen of a range set without blanks, between a digit and a letter.
RANGE_HYPHEN = r"(?<=\d)-(?=[A-Za-z])|(?<=[A-Za-z])-(?=\d)"
MAX_WORDS = 4
_NAMED = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
#: What any of the notations looks like; all else is no date and isn't read as one.
LIKELY = rf"(?i)^\s*(?:\d{{1,4}}[-/]\d{{1,2}}(?:[-/]\d{{1,4}})?|{_NAMED}\s+\d{{1,2}}(?:(?:,\s*|\s+)\d{{4}})?|\d{{1,2}}\s+{_NAMED}(?:\s+\d{{2,4}})?)[:;.\s]*$"
#: What a word looks like that a date goes on with (1's look-alikes among them), or that holds blanks.
GOES_ON = rf"(?is)^(?:[\d\-/,:;.|il]*|{_NAMED}[:;.]*|.*\s.*)$"
#: How a word begins that a date begins with (1's look-alikes among them).
OPENS = r"^\s*(?:$|[\diIl|]|[jfmasondJFMASOND])"


def plain_form(text: Column) -> Column:
    """Lower case, one blank between words and after a comma, no mark at the end,
    and a month's name as m and its number."""
    text = F.regexp_replace(F.lower(text), r"^\s+|[:;.\s]+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r",(?=\S)", ", "), r"\s+", " ")
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for name in dict.fromkeys((m, m[:3])) for x in (name, f"m{i}")])
    name = F.regexp_extract(text, r"([a-z]+)", 1)
    number = F.try_element_at(names, name)
    return F.when(name == "", text).when(number.isNotNull(), F.regexp_replace(text, r"[a-z]+", number))


def read_date(text: Column) -> Column:
    """struct<date, notation>, the date null where the text is none. Two-digit years
    from 69 on are of the last century; yearless dates come in the sentinel year."""

    def read(form: Column) -> Column:
        name = None
        for key, (pattern, _) in NOTATIONS.items():
            name = F.when(form.rlike(pattern), key) if name is None else name.when(form.rlike(pattern), key)
        return F.transform(F.array(name), lambda n: F.struct(dated(form, n).alias("date"), n.alias("notation")))[0]

    def dated(form: Column, name: Column) -> Column:
        iso = None
        for key, (pattern, shape) in NOTATIONS.items():
            value = F.regexp_replace(form, pattern, shape)
            iso = F.when(name == key, value) if iso is None else iso.when(name == key, value)
        century = F.when(iso.rlike(r"^(69|[789]\d)-"), F.concat(F.lit("19"), iso)).when(iso.rlike(r"^\d\d-"), F.concat(F.lit("20"), iso)).otherwise(iso)
        return F.try_to_date(century, "yyyy-M-d")

    # In plain form no notation is longer than that; blanks and marks don't count.
    return F.when(text.rlike(LIKELY), F.transform(F.array(plain_form(text)), lambda form: F.when(F.length(form) <= LONGEST, read(form)))[0])


def parse_date(text: Column) -> Column:
    return read_date(text)["date"]


def notation_of(shape: Column) -> Column:
    """The notation that a human date format (MM/DD/YYYY, DD MON YY) stands for, or
    null. Its letters are all of tokens, longest first."""
    text = F.upper(F.trim(shape))
    for token, short in (("YYYY", "{y}"), ("MMMM", "{n}"), ("MMM", "{n}"), ("MON", "{n}"), ("DD", "{d}"), ("MM", "{m}"), ("YY", "{s}")):
        text = F.replace(text, F.lit(token), F.lit(short))
    out = None
    for name in NOTATIONS:
        form = name.replace("yyyy", "{y}").replace("yy", "{s}").replace("MMM", "{n}").replace("d", "{d}")
        form = form.replace("M", "{m}")
        out = F.when(text == form, name) if out is None else out.when(text == form, name)
    return out


def words_of(text: Column) -> Column:
    """Words, a range's hyphen being a blank."""
    return F.filter(F.split(F.regexp_replace(text, RANGE_HYPHEN, " "), r"\s+"), lambda x: x != "")


def find_dates(text: Column) -> Column:
    """array<date> of the dates in a text, left to right; of the dates that start at
    a word the one of most words, up to four, after which reading goes on."""

    def at(w: Column, i: Column) -> Column:
        tries = F.array(*[F.struct(F.when(i + k <= F.size(w), F.array_join(F.slice(w, i + 1, k), " ")).alias("t"), F.lit(k).alias("k")) for k in range(MAX_WORDS, 0, -1)])
        likely = F.filter(tries, lambda s: s["t"].rlike(LIKELY))
        found = F.get(F.filter(F.transform(likely, lambda s: F.struct(parse_date(s["t"]).alias("date"), s["k"].alias("k"))), lambda s: s["date"].isNotNull()), 0)
        return F.when(F.get(w, i).rlike(OPENS), found)

    def fold(w: Column) -> Column:
        start = F.struct(F.array().cast("array<date>").alias("found"), F.lit(0).alias("next"))

        def step(s: Column, i: Column) -> Column:
            taken = lambda hit: F.when(hit.isNull(), s).otherwise(F.struct(F.concat(s["found"], F.array(hit["date"])).alias("found"), (i + hit["k"]).alias("next")))
            return F.transform(F.array(F.when(i >= s["next"], at(w, i))), taken)[0]

        return F.when(F.size(w) > 0, F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), start, step, lambda s: s["found"])).otherwise(F.array().cast("array<date>"))

    none = F.array().cast("array<date>")
    return F.when(text.rlike(r"\d"), F.transform(F.array(words_of(text)), fold)[0]).otherwise(none)


def with_year(day: Column, start: Column) -> Column:
    """A yearless date in the period that starts at ``start``: its year, or the
    next if that would be before it. 29 February moves to the 28th where the year
    has none."""
    moved = F.add_months(day, (F.year(start) - SENTINEL_YEAR) * 12)
    return F.when((F.year(day) != SENTINEL_YEAR) | start.isNull(), day).when(moved < start, F.add_months(moved, 12)).otherwise(moved)
