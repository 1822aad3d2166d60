"""The auditor's view of a diagnosed tie-out: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_cents

# Diagnoses that name the reading, not the statement, as the cause;
# verdicts by severity.
READING = ("dropped_row", "duplicated_row", "side_flip", "zero_amount_rows", "surplus_rows", "row_level_break", "amount_matches_row")
VERDICTS = ("tied", "tied_with_notes", "exceptions_identified", "not_tied")


# Warnings that leave something in doubt, and what is to be done.
DOUBTS = {
    "summary_table": "confirm_no_transactions",
    "zero_amount": "confirm_no_amount",
    "against_contract": "inspect_lines",
    "before_any_section": "determine_side",
    "no_text_layer": "descriptions_recognised",
    "listing_added": "vouch_to_listing",
    "listing_left_out": "confirm_repeats_table",
    "listing_without_side": "determine_side_of_listing",
    "no_layout": "perform_by_hand",
}


def doubt_items(rows: DataFrame, warnings: DataFrame, periods: DataFrame) -> DataFrame:
    """doc_id, period, kind, action, amount, page: rows with an amount taken from
    the balance or a date of the row before, and the document's warnings of
    ``DOUBTS``, which count for each of its periods."""
    flagged = lambda flag, kind, action: rows.where(flag).select("doc_id", "period", F.lit(kind).alias("kind"), F.lit(action).alias("action"), F.col("cents").alias("amount"), "page")
    doubted = F.create_map(*[F.lit(x) for pair in DOUBTS.items() for x in pair])
    of_file = warnings.where(F.col("warning").isin(*DOUBTS)).groupBy("doc_id", F.col("period").alias("said_in"), "warning").agg(F.sum("n").alias("n"))
    noted = periods.join(of_file, "doc_id").select("doc_id", "period", F.col("warning").alias("kind"), F.element_at(doubted, F.col("warning")).alias("action"), F.lit(None).cast("bigint").alias("amount"), F.lit(None).cast("int").alias("page"))
    return flagged("recovered", "amount_from_balance", "vouch_amount").unionByName(flagged("date_inherited", "date_from_row_before", "confirm_date")).unionByName(noted)


def completeness(checks: DataFrame) -> DataFrame:
    """bounded (both counts are printed), missing_deposits, missing_withdrawals."""
    bounded = F.col("deposits_count").isNotNull() & F.col("withdrawals_count").isNotNull()
    short = lambda a, b: F.when(bounded, F.col(a) - F.col(b))
    return checks.withColumns({"bounded": bounded, "missing_deposits": short("deposits_count", "dep_n"), "missing_withdrawals": short("withdrawals_count", "wd_n")})


def sides(checks: DataFrame) -> DataFrame:
    """in_difference, out_difference (parsed less printed; null if not printed)
    and where_to_look."""
    out = checks.withColumn("in_difference", F.col("dep_cents") - F.col("deposits_total")).withColumn("out_difference", F.col("wd_cents") - F.col("withdrawals_total"))
    i, o = F.col("in_difference"), F.col("out_difference")
    look = F.when(i.isNull() | o.isNull(), "not_printed").when((i == 0) & (o == 0), "both_agree").when((i != 0) & (o != 0), "both_differ")
    look = look.when(o == 0, F.when(i < 0, "in_short").otherwise("in_over")).otherwise(F.when(o < 0, "out_short").otherwise("out_over"))
    return out.withColumn("where_to_look", look)


def attribution(diagnosed: DataFrame, doubts: Column | None = None) -> DataFrame:
    """Whose exception a residual is; a statement is blamed only if nothing is in
    doubt. ``doubts``: number of doubtful items of the period."""
    doubts = F.lit(0) if doubts is None else doubts
    c = F.col
    value = F.when(c("residual") == 0, "none").when(c("diagnosis").isin(*READING), "extraction_uncertainty").when((doubts == 0) & c("diagnosis").isNull(), "statement_inconsistency").otherwise("unexplained")
    return diagnosed.withColumn("n_doubts", doubts.cast("long")).withColumn("attribution", value)


def verdict(attributed: DataFrame) -> DataFrame:
    c = F.col
    value = F.when(c("reconciled"), F.when(c("bounded") & (c("n_doubts") == 0), "tied").otherwise("tied_with_notes")).when(c("attribution") == "unexplained", "not_tied").otherwise("exceptions_identified")
    return attributed.withColumn("verdict", value).withColumn("severity", F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).cast("int") - 1)


def next_steps(judged: DataFrame) -> DataFrame:
    """steps array<string>, at most five, in order."""
    c = F.col
    short = F.coalesce(c("missing_deposits"), F.lit(0)) + F.coalesce(c("missing_withdrawals"), F.lit(0))
    off = (F.coalesce(c("in_difference"), F.lit(0)) != 0) | (F.coalesce(c("out_difference"), F.lit(0)) != 0)
    steps = F.array(
        F.concat(F.lit("verdict:"), c("verdict")),
        F.when(off, F.concat(F.lit("look:"), c("where_to_look"))),
        F.when(~c("bounded"), F.lit("confirm_population")).when((c("missing_deposits") != 0) | (c("missing_withdrawals") != 0), F.concat(F.lit("recover_rows:"), short.cast("string"))),
        F.when(c("attribution") == "statement_inconsistency", F.lit("finding_on_statement")),
        F.when(c("n_doubts") > 0, F.concat(F.lit("vouch:"), c("n_doubts").cast("string"))),
    )
    return judged.withColumn("steps", F.filter(steps, lambda x: x.isNotNull()))


#: What is to be done about a residual, by whose exception it is.
ACTIONS = {"extraction_uncertainty": "inspect_page", "statement_inconsistency": "raise_and_confirm", "unexplained": "perform_by_hand"}


def residual_exceptions(attributed: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each period with a residual: kind, amount, description, action and
    the page that the diagnosis names, where it names one."""
    detail = F.col("detail") if "detail" in attributed.columns else F.lit(None).cast("string")
    text = F.concat(F.lit("Residual "), format_cents(F.col("residual")), F.lit(": "), F.coalesce(detail, "diagnosis", F.lit("none")))
    action = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), F.col("attribution"))
    page = F.regexp_extract(detail, r"page (\d+)", 1)
    return attributed.where("residual <> 0").select(*keys, F.col("attribution").alias("kind"), F.col("residual").alias("amount"), text.alias("description"), action.alias("action"), F.when(page != "", page).cast("int").alias("page"))


def exceptions(judged: DataFrame, doubts: DataFrame) -> DataFrame:
    """doc_id, period, position, kind, description, action, amount, page: the list of a
    period's exceptions, its residual first, then the items in doubt by page."""
    residual = residual_exceptions(judged, ["doc_id", "period"]).withColumn("rank", F.lit(0))
    noted = doubts.select("doc_id", "period", F.lit("extraction_uncertainty").alias("kind"), "amount", F.col("kind").alias("description"), "action", "page", F.lit(1).alias("rank"))
    order = Window.partitionBy("doc_id", "period").orderBy("rank", F.col("page").asc_nulls_last(), "description", "amount")
    every = residual.unionByName(noted).withColumn("position", F.row_number().over(order))
    return every.select("doc_id", "period", "position", "kind", "description", "action", "amount", "page")


def file_verdict(judged: DataFrame, keys: list[str]) -> DataFrame:
    """The worst verdict of all periods, with sums over them."""
    return judged.groupBy(*keys).agg(F.max_by("verdict", "severity").alias("verdict"), F.count(F.lit(1)).alias("periods"), F.bool_and("reconciled").alias("reconciled"), F.sum("residual").alias("residual"))
