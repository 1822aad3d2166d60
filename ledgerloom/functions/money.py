"""Money as exact amounts: exactly two decimals, never a float in between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notation of an amount. A bracket, sign or currency mark may
# stand before, a bracket, CR/DR and a sign after; the guards keep dates, longer
# numbers and parts of words out.
FORM = r"\(?-?\$?(?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2}\)?(?: ?(?:CR|DR))?-?"
TOKEN = rf"(?U)(?<![\w.,]){FORM}(?!\d)"
WHOLE = rf"^{FORM}$"
#: What any part of an amount is made of.
PART = r"^[()\-$\d,.CDR\s]*$"
BLANKS = " \t\n\x0b\f\r"


def cents(value: Column) -> Column:
    """Whole cents of a double; a detour over decimals would round otherwise."""
    return F.round(value * 100).cast("bigint")


def signed_cents(token: Column) -> Column:
    """Cents of text that has an amount's form. Brackets, a sign on either side and
    DR make it negative; one bracket without the other makes it none."""
    digits = F.regexp_replace(token, r"[^0-9]", "").cast("bigint")
    both = token.contains("(") == token.contains(")")
    return F.when(both, F.when(token.rlike(r"[(-]|DR"), -digits).otherwise(digits))


def parse_money(text: Column) -> Column:
    """Cents, or null where the text isn't one amount (outer white space allowed)."""
    token = F.btrim(text, F.lit(BLANKS))
    return F.when(text.contains(".") & token.rlike(WHOLE), signed_cents(token))


def find_money(text: Column) -> Column:
    """array<struct<text, cents>> of the amounts in a text, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("text"), signed_cents(t).alias("cents")))
    return F.filter(found, lambda t: t["cents"].isNotNull())


def format_cents(value: Column) -> Column:
    """Two decimals, from whole cents."""
    return F.format_string("%s%d.%02d", F.when(value < 0, "-").otherwise(""), F.expr("0L") + F.floor(F.abs(value) / 100), F.abs(value) % 100)
