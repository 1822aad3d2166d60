"""Tie-out of parsed rows with printed totals: six checks of three states.

``rows``: the key columns, side (deposit / withdrawal), cents (positive).
``printed``: the key columns and beginning, ending, deposits_total,
withdrawals_total (cents), deposits_count, withdrawals_count; null is not
printed. Everything is one aggregate by the key, aggregated map-side, and one
join on it; no tolerance anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRINTED = ("beginning", "ending", "deposits_total", "withdrawals_total", "deposits_count", "withdrawals_count")
CHECKS = ("printed_block_closes", "balance_equation", "deposits_total", "withdrawals_total", "deposits_count", "withdrawals_count")
SEVERITY = {"ok": 0, "unavailable": 1, "fail": 2}


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum and number of rows of each side."""
    side = lambda s: F.when(F.col("side") == s, F.col("cents"))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(side("deposit")), F.lit(0)).alias("dep_cents"), F.coalesce(F.sum(side("withdrawal")), F.lit(0)).alias("wd_cents"), F.count(side("deposit")).alias("dep_n"), F.count(side("withdrawal")).alias("wd_n")
    )


def state(same: Column) -> Column:
    """A comparison with anything unknown is unavailable."""
    return F.coalesce(F.when(same, "ok").otherwise(F.when(~same, "fail")), F.lit("unavailable"))


def reconcile(printed: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Printed and parsed figures, ``residual``, one column ``check_<name>`` each,
    ``n_ok``, ``reconciled`` and ``structural`` (why a period fails with no
    failing check). A period without rows is compared with zeros."""
    return judged(printed.join(totals(rows, keys), keys, "left").fillna(0, ["dep_cents", "wd_cents", "dep_n", "wd_n"]))


def judged(both: DataFrame) -> DataFrame:
    """The checks of printed figures that stand beside their totals."""
    c = F.col
    beginning = F.coalesce("beginning", F.lit(0))
    ending = F.coalesce("ending", beginning + F.coalesce("deposits_total", "dep_cents") - F.coalesce("withdrawals_total", "wd_cents"))
    same = {
        "printed_block_closes": c("beginning") + c("deposits_total") - c("withdrawals_total") == c("ending"),
        "balance_equation": c("beginning") + c("dep_cents") - c("wd_cents") == c("ending"),
        "deposits_total": c("dep_cents") == c("deposits_total"),
        "withdrawals_total": c("wd_cents") == c("withdrawals_total"),
        "deposits_count": c("dep_n") == c("deposits_count"),
        "withdrawals_count": c("wd_n") == c("withdrawals_count"),
    }
    out = both.withColumn("residual", beginning + c("dep_cents") - c("wd_cents") - ending)
    out = out.withColumns({f"check_{k}": state(v) for k, v in same.items()})
    states = F.array(*[c(f"check_{k}") for k in CHECKS])
    n = lambda s: F.size(F.filter(states, lambda x: x == s))
    closes = (n("fail") == 0) & ((c("check_balance_equation") == "ok") | (c("check_deposits_total") == "ok") & (c("check_withdrawals_total") == "ok"))
    out = out.withColumn("n_ok", n("ok")).withColumn("n_fail", n("fail")).withColumn("reconciled", closes)
    why = F.when(c("reconciled") | (c("n_fail") > 0), None).when(n("unavailable") == len(CHECKS), "no_printed_summary").otherwise("no_transaction_evidence")
    return out.withColumn("structural", why)


def rollup(checks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Several periods as one: first beginning, last ending, sums of both sides, the
    worst state of each check, reconciled if all are, summed residual."""
    level = lambda k: F.max(F.when(F.col(f"check_{k}") == "ok", SEVERITY["ok"]).when(F.col(f"check_{k}") == "unavailable", SEVERITY["unavailable"]).otherwise(SEVERITY["fail"]))
    state_of = lambda n: F.when(n == 0, "ok").when(n == 1, "unavailable").otherwise("fail")
    first = lambda f, c: f(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    sums = [F.sum(c).alias(c) for c in ("dep_cents", "wd_cents", "dep_n", "wd_n", "residual")]
    worst = [state_of(level(k)).alias(f"check_{k}") for k in CHECKS]
    return checks.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"), first(F.min_by, "beginning"), first(F.max_by, "ending"), *sums, F.bool_and("reconciled").alias("reconciled"), *worst)
