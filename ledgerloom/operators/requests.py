"""Questions on a ledger, many at a time: a table of requests, answered in one plan.

``requests``: keys, request (an id), kind and what the kind takes:

* ``state``: the tie-out as it stands;
* ``find_amount`` (amount, as text): pages that show it, rows that carry it;
* ``list_rows`` (first, until; by default twenty rows): rows by their place;
* ``read_page`` (number): the page's text.

A request that names nothing there has an empty answer and says so in ``note``. Each kind
is a join on the keys and the amount, place or page asked for, so that a period's rows
meet only the requests they answer; requests of periods that aren't there stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_cents, parse_money

#: Rows listed where no end is given.
LISTED = 20


def answers(requests: DataFrame, checks: DataFrame, rows: DataFrame, shown: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, request, kind, note, reconciled, residual, n_rows, on_pages, row_indexes, lines.

    ``checks``: keys, reconciled, residual, dep_n, wd_n; ``rows``: keys, row_index, date,
    description, side, cents; ``shown``: keys, page, cents; ``pages``: keys, page, text.
    """
    c = F.col
    asked = requests.select(*keys, "request", "kind", F.abs(parse_money(c("amount"))).alias("cents"), F.coalesce("first", F.lit(0)).alias("first"), "until", c("number").alias("page"))
    asked = asked.withColumn("until", F.coalesce("until", c("first") + LISTED))
    key = [*keys, "request"]
    state = asked.where("kind = 'state'").join(checks.select(*keys, "reconciled", "residual", (c("dep_n") + c("wd_n")).alias("n_rows")), keys).select(*key, "reconciled", "residual", "n_rows")
    sought = asked.where("kind = 'find_amount' and cents is not null").select(*key, "cents")
    on = sought.join(shown.select(*keys, "page", F.abs("cents").alias("cents")), [*keys, "cents"]).groupBy(*key).agg(F.array_sort(F.collect_set("page")).alias("on_pages"))
    by = sought.join(rows.select(*keys, "row_index", "cents"), [*keys, "cents"]).groupBy(*key).agg(F.array_sort(F.collect_list("row_index")).alias("carried"))
    said = F.concat(F.lit("["), c("row_index").cast("string"), F.lit("] "), F.concat_ws(" ", c("date").cast("string"), F.substring("description", 1, 44), "side", format_cents(c("cents"))))
    # One row a place asked for: rows meet their places, not all requests of the period.
    places = asked.where("kind = 'list_rows' and until > first").select(*key, F.explode(F.sequence(c("first"), c("until") - 1)).alias("row_index"))
    listed = places.join(rows.select(*keys, "row_index", said.alias("said")), [*keys, "row_index"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row_index", "said"))).alias("l"))
    listed = listed.select(*key, F.transform("l", lambda x: x["row_index"]).alias("listed"), F.transform("l", lambda x: x["said"]).alias("row_lines"))
    read = asked.where("kind = 'read_page'").join(pages.select(*keys, "page", "text"), [*keys, "page"]).select(*key, F.split("text", "\n").alias("page_lines"))
    out = asked.select(*key, "kind", "cents")
    for part in (state, on, by, listed, read):
        out = out.join(part, key, "left")
    none = F.array().cast("array<int>")
    kinds = ("state", "find_amount", "list_rows", "read_page")
    note = (
        F.when(~F.coalesce(c("kind").isin(*kinds), F.lit(False)), "unknown request")
        .when((c("kind") == "state") & c("n_rows").isNull(), "no such period")
        .when((c("kind") == "find_amount") & c("cents").isNull(), "not an amount")
        .when((c("kind") == "find_amount") & c("on_pages").isNull() & c("carried").isNull(), "nowhere")
        .when((c("kind") == "find_amount") & c("carried").isNull(), "on a page, in no row")
        .when((c("kind") == "find_amount") & c("on_pages").isNull(), "in a row, on no page")
        .when((c("kind") == "list_rows") & c("row_lines").isNull(), "no rows there")
        .when((c("kind") == "read_page") & c("page_lines").isNull(), "no such page")
    )
    return out.select(*key, "kind", note.alias("note"), "reconciled", "residual", "n_rows", F.coalesce(c("on_pages").cast("array<int>"), none).alias("on_pages"), F.coalesce(c("carried").cast("array<int>"), c("listed").cast("array<int>"), none).alias("row_indexes"), F.coalesce("row_lines", "page_lines", F.array().cast("array<string>")).alias("lines"))
