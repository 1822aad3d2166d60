"""Words, labels and account numbers in statement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a printed summary calls its fields.
LABELS = {
    "beginning": ("prior statement balance", "beginning balance", "previous balance", "opening balance", "balance forward", "prior balance"),
    "ending": ("ending statement balance", "ending balance", "new balance", "closing balance"),
    "deposits": ("total deposits/credits", "deposits and credits", "deposits/credits", "total deposits", "deposits", "credits", "additions"),
    "withdrawals": ("total checks/debits", "withdrawals and debits", "checks/debits", "total withdrawals", "withdrawals", "debits", "subtractions", "other debits", "checks"),
}

# What marks a stated cycle, and the two dates of a cycle pair.
PERIOD_LABELS = ("statement period", "statement date", "for the period", "period covered")
CYCLE_PAIR = ("last statement", "this statement")


def squash(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def tokens(text: Column) -> Column:
    """Splits at blanks, between digits and letters, before an upper-case letter
    after a lower-case one, at runs of asterisks and at colons, which go."""
    cut = F.regexp_replace(text, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[^*])(?=\*)|(?<=\*)(?=[^*])", " ")
    return F.filter(F.split(F.regexp_replace(cut, ":", " "), r"\s+"), lambda x: x != "")


def has_label(text: Column, field: str) -> Column:
    """A label at the start of a word; blanks inside it are optional."""
    found = None
    for label in LABELS[field]:
        hit = F.lower(text).rlike(r"(?<![a-z])" + label.replace(" ", r"\s*"))
        found = hit if found is None else found | hit
    return found


def names_side(text: Column, field: str) -> Column:
    """A label anywhere in the text, blanks and case aside."""
    found = None
    for label in LABELS[field]:
        hit = squash(text).contains(label.replace(" ", ""))
        found = hit if found is None else found | hit
    return found


def heading_side(text: Column) -> Column:
    """The side that a heading's labels name, deposits first; null if none."""
    return F.when(has_label(text, "deposits"), "deposit").when(has_label(text, "withdrawals"), "withdrawal")


def last4(text: Column) -> Column:
    """Last digits of a masked account number, not part of a word."""
    found = F.regexp_extract(text, r"(?<![A-Za-z])[Xx*]{2,}-?(\d{4})(?!\d)", 1)
    return F.when(found != "", found)


def masked_last4(text: Column) -> Column:
    """As ``last4``, and behind spaced masks or a single mask character."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?<![A-Za-z0-9])(?:[*xX×]\s*){2,}(\d{4})(?!\d)", r"(?<![A-Za-z0-9])[*xX×](\d{4})(?!\d)")])
    return F.coalesce(last4(text), found)


def labelled_last4(text: Column) -> Column:
    """Off a line that says "account": its last group of four digits that is no
    year of a date, else the end of its longest run of five digits or more."""
    groups = F.regexp_extract_all(text, F.lit(r"(?<![/\-.])\b(\d{4})\b(?![/\-.]\d)"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(r"(\d{5,})"), F.lit(1))
    longest = F.aggregate(runs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    found = F.when(F.size(groups) > 0, F.element_at(groups, -1)).when(longest != "", F.right(longest, F.lit(4)))
    return F.when(squash(text).contains("account"), found)
