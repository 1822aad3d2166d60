"""Why a period does not reconcile, from the tie-out's figures.

The signature of one wrong row is the pair of count differences and how many
times its amount fits the residual, with sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_cents

# Fixed values: (deposits, withdrawals) differences -> kind, side the row belongs
# on, residual over amount.
SIGNATURES = (
    (-1, 0, "dropped_row", "deposit", -1),
    (0, -1, "dropped_row", "withdrawal", 1),
    (1, 0, "duplicated_row", "deposit", 1),
    (0, 1, "duplicated_row", "withdrawal", -1),
    (-1, 1, "side_flip", "deposit", -2),
    (1, -1, "side_flip", "withdrawal", 2),
)


def _signature(pick) -> Column:
    out = None
    for dep, wd, kind, side, times in SIGNATURES:
        amount = F.col("residual") / times
        hit = (F.col("delta_dep") == dep) & (F.col("delta_wd") == wd) & (amount > 0)
        value = pick(kind, side, amount)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def count_signature(checks: DataFrame) -> DataFrame:
    """Adds delta_dep, delta_wd and sig_kind, sig_side, sig_amount (cents, double:
    half a cent can show); null without printed counts or a match."""
    out = checks.withColumn("delta_dep", F.col("dep_n") - F.col("deposits_count")).withColumn("delta_wd", F.col("wd_n") - F.col("withdrawals_count"))
    return out.withColumns({"sig_kind": _signature(lambda k, s, a: F.lit(k)), "sig_side": _signature(lambda k, s, a: F.lit(s)), "sig_amount": _signature(lambda k, s, a: a)})


def chain_breaks(rows: DataFrame, keys: list[str], order: list[str], opening: Column) -> DataFrame:
    """The first row of each key whose ``balance`` isn't the one before plus the
    row's ``signed`` cents: row_index, amount (balance less expected)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = rows.withColumn("row_index", F.row_number().over(w) - 1).withColumn("before", F.coalesce(F.lag("balance").over(w), opening))
    off = seen.withColumn("amount", F.col("balance") - F.col("before") - F.col("signed")).where("amount <> 0")
    return off.groupBy(*keys).agg(F.min_by(F.struct("row_index", "amount"), "row_index").alias("b")).select(*keys, "b.row_index", "b.amount")


def residual_matches(checks: DataFrame, rows: DataFrame, page_money: DataFrame, keys: list[str]) -> DataFrame:
    """For periods with a residual: half_row, whole_row (a parsed row has half the
    residual, or all of it) and page (the first that shows it). What is wanted, a
    row or two a period, meets rows and pages in one join on key and amount, so a
    period's rows never meet pairwise."""
    c = F.col
    magnitude = F.abs("residual")
    halved = F.when(magnitude % 2 == 0, F.expr("abs(residual) div 2"))
    wanted = checks.where("residual <> 0").select(*keys, F.explode(F.array(F.struct(magnitude.alias("amount"), F.lit(False).alias("half")), F.struct(halved.alias("amount"), F.lit(True).alias("half")))).alias("w")).select(*keys, "w.*").where("amount is not null")
    seen = rows.select(*keys, c("cents").alias("amount"), F.lit(None).cast(page_money.schema["page"].dataType).alias("page")).unionByName(page_money.select(*keys, F.abs("cents").alias("amount"), "page"))
    of_row = c("page").isNull()
    found = wanted.join(seen, [*keys, "amount"]).groupBy(*keys).agg(F.bool_or(of_row & c("half")).alias("half_row"), F.bool_or(of_row & ~c("half")).alias("whole_row"), F.min(F.when(~c("half"), c("page"))).alias("page"))
    return checks.join(found, keys, "left").fillna(False, ["half_row", "whole_row"])


def amount_held(wanted: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (keys, amount) whose amount some row or page of ``shown`` (keys,
    cents) has: is an amount there at all?"""
    return wanted.join(shown.select(*keys, F.abs("cents").alias("amount")), [*keys, "amount"], "left_semi")


def unread(shown: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What is shown (keys, cents) and in no row of its key."""
    return shown.join(rows.select(*keys, "cents"), [*keys, "cents"], "left_anti")


def diagnose(checks: DataFrame) -> DataFrame:
    """Adds diagnosis, diag_side, diag_amount (cents), confident. Expects what
    count_signature and residual_matches add; ``break_index`` and
    ``break_amount`` of a chain break are used where the columns are there."""
    c = F.col
    counted = c("delta_dep").isNotNull() & c("delta_wd").isNotNull()
    zero = c("residual") == 0
    broken = c("break_index").isNotNull() if "break_index" in checks.columns else F.lit(False)
    amount_of_break = c("break_amount").cast("double") if "break_index" in checks.columns else F.lit(None).cast("double")
    magnitude = F.abs("residual").cast("double")
    branches = [
        (c("reconciled"), None, None, None, None),
        (c("structural").isNotNull(), c("structural"), None, None, True),
        (counted & zero & ((c("delta_dep") < 0) | (c("delta_wd") < 0)), F.lit("zero_amount_rows"), None, None, True),
        (counted & zero, F.lit("surplus_rows"), None, None, False),
        (broken, F.lit("row_level_break"), None, amount_of_break, True),
        (counted & c("sig_kind").isNotNull(), c("sig_kind"), c("sig_side"), c("sig_amount"), True),
        (c("half_row"), F.lit("side_flip"), None, magnitude / 2, False),
        (c("whole_row"), F.lit("amount_matches_row"), None, magnitude, False),
        (c("page").isNotNull(), F.lit("dropped_row"), None, magnitude, False),
    ]

    def ladder(i: int, last, kind: str) -> Column:
        out = None
        for branch in branches:
            value = branch[i] if isinstance(branch[i], Column) else F.lit(branch[i]).cast(kind)
            out = F.when(branch[0], value) if out is None else out.when(branch[0], value)
        return out.otherwise(F.lit(last).cast(kind))

    return checks.withColumns({"diagnosis": ladder(1, "unknown", "string"), "diag_side": ladder(2, None, "string"), "diag_amount": ladder(3, None, "double"), "confident": ladder(4, False, "boolean")})


def details(diagnosed: DataFrame) -> DataFrame:
    """``detail``: what the diagnosis says, in a sentence; null where there is none."""
    c = F.col
    short = F.abs(F.least(c("delta_dep"), F.lit(0))) + F.abs(F.least(c("delta_wd"), F.lit(0)))
    over = F.greatest(c("delta_dep"), F.lit(0)) + F.greatest(c("delta_wd"), F.lit(0))
    amount = format_cents(c("diag_amount").cast("bigint"))
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    row = c("break_index") if "break_index" in diagnosed.columns else F.lit(None)
    kind, sure = c("diagnosis"), F.coalesce(c("confident"), F.lit(False))
    text = (
        F.when(kind == "no_printed_summary", "no summary block is printed")
        .when(kind == "no_transaction_evidence", "only counts are printed, no amount was compared")
        .when(kind == "zero_amount_rows", said(short, " row(s) fewer than printed, and the money agrees"))
        .when(kind == "surplus_rows", said(over, " row(s) more than printed, and the money agrees"))
        .when(kind == "row_level_break", said("the running balance breaks at row ", row, " by ", amount))
        .when(sure & (kind == "dropped_row"), said("a ", c("diag_side"), " of ", amount, " was not read"))
        .when(sure & (kind == "duplicated_row"), said("a ", c("diag_side"), " of ", amount, " was read twice"))
        .when(sure & (kind == "side_flip"), said("a ", c("diag_side"), " of ", amount, " is on the other side"))
        .when(kind == "side_flip", said("a row of ", amount, " may be on the other side"))
        .when(kind == "amount_matches_row", said("the residual is the amount of a row, ", amount))
        .when(kind == "dropped_row", said(amount, " on page ", c("page"), " may not have been read"))
        .when(kind == "unknown", said("nothing explains a residual of ", format_cents(c("residual"))))
    )
    return diagnosed.withColumn("detail", text)
