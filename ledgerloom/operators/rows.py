"""Row operators over an ordered ledger: balances, recovery, dates, sides.

Every window is partitioned by the account keys, so one exchange serves a chain
of them. With ``most`` a key of more rows than that is read in blocks (see
``prefix``), so that one account may hold most of a ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile
from ledgerloom.operators.prefix import along


def signed() -> Column:
    return F.when(F.col("side") == "deposit", F.col("cents")).otherwise(-F.col("cents"))


def running_balance(rows: DataFrame, keys: list[str], order: list[str], opening: Column, most: int | None = None) -> DataFrame:
    moved = along(rows.withColumn("signed", signed()), keys, order, sums={"balance": F.col("signed")}, most=most)
    return moved.withColumn("balance", opening + F.col("balance"))


def balance_step(rows: DataFrame, keys: list[str], order: list[str], opening: Column, most: int | None = None) -> DataFrame:
    """Rows whose ``signed`` wasn't read get it from the balance step; ``recovered``
    marks them. A step of zero is no transaction and stays null."""
    # In a struct, so that the row before counts also where it prints no balance.
    before = along(rows, keys, order, lasts={"before": F.struct("balance")}, most=most)
    step = F.col("balance") - F.coalesce(F.col("before.balance"), opening)
    lost = F.col("signed").isNull()
    return before.withColumn("step", step).withColumn("recovered", lost & (F.col("step") != 0)).withColumn("signed", F.coalesce("signed", F.when(F.col("step") != 0, F.col("step")))).drop("step", "before")


def inherit_date(rows: DataFrame, keys: list[str], order: list[str], start: Column, most: int | None = None) -> DataFrame:
    """A row without a date takes that of the last row with one, else the start of
    the period; ``date_inherited`` marks it."""
    found = along(rows.withColumn("date_inherited", F.col("date").isNull()), keys, order, lasts={"date_before": F.col("date")}, most=most)
    return found.withColumn("date", F.coalesce("date", "date_before", start)).drop("date_before")


def segments(rows: DataFrame, keys: list[str], order: list[str], opens: Column, most: int | None = None) -> DataFrame:
    """``segment``: number of the island a row is in; ``opens`` starts one."""
    return along(rows, keys, order, sums={"segment": F.when(opens, 1).otherwise(0)}, most=most)


def side_of(strategy: str, amount: Column, column: Column | None = None, section: Column | None = None, before: Column | None = None, balance: Column | None = None) -> Column:
    """Side by strategy: sign of the amount, column it stands in (0 is the left one,
    deposits), section heading above it, or direction of the balance."""
    if strategy == "signed":
        return F.when(amount < 0, "withdrawal").otherwise("deposit")
    if strategy == "two_columns":
        return F.when(column == 0, "deposit").otherwise("withdrawal")
    if strategy == "sections":
        return F.when(section.isin("deposits", "credits"), "deposit").when(section.isin("withdrawals", "debits"), "withdrawal")
    return F.when(before.isNotNull() & balance.isNotNull(), F.when(balance > before, "deposit").otherwise("withdrawal"))


def breach(cents: Column, day: Column, side: Column) -> Column:
    """Why a row breaks the contract of the output (an amount above zero, a date and
    a side); null if it doesn't."""
    return F.when(cents.isNull() | (cents < 0), "amount").when(cents == 0, "zero").when(day.isNull(), "date").when(side.isNull() | ~side.isin("deposit", "withdrawal"), "side")


def outside(day: Column, start: Column, end: Column) -> Column:
    """Before the period's start or after its end, where these are known."""
    return F.coalesce((day < start) | (day > end), F.lit(False))


def top_ranked(counts: DataFrame, keys: list[str], by: str, then: str, most: int) -> DataFrame:
    """The ``most`` rows of each key with the highest ``by``, ranked from 1 in ``k``."""
    return counts.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), then))).where(F.col("k") <= most)


def best_candidate(candidates: DataFrame, keys: list[str], first_reconciled: bool = False) -> DataFrame:
    """Of several readings the best: reconciled first, then more checks that hold,
    fewer recovered rows, a smaller residual, the earlier candidate. With
    ``first_reconciled`` of those that reconcile just the earliest. One aggregate,
    no sort."""
    level = lambda x: F.when(F.col("reconciled"), F.lit(0)).otherwise(x) if first_reconciled else x
    rank = F.struct(F.col("reconciled"), level(F.col("n_ok")), level(-F.col("n_recovered")), level(-F.abs("residual")), -F.col("candidate"))
    whole = F.struct(*[c for c in candidates.columns if c not in keys])
    return candidates.groupBy(*keys).agg(F.max_by(whole, rank).alias("best")).select(*keys, "best.*")


def apply_edits(rows: DataFrame, edits: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Edits (op: drop / set_side / insert, row id, side, cents) as joins: dropped
    rows leave by an anti join, sides are set by a left join, inserts are added."""
    kept = rows.join(edits.where("op = 'drop'").select(row_id), row_id, "left_anti")
    flips = edits.where("op = 'set_side'").select(row_id, F.col("side").alias("new_side"))
    kept = kept.join(flips, row_id, "left").withColumn("side", F.coalesce("new_side", "side")).drop("new_side")
    return kept.select(*keys, row_id, "side", "cents").unionByName(edits.where("op = 'insert'").select(*keys, row_id, "side", "cents"))


def fields_diff(expected: DataFrame, observed: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Expected against observed figures, one row a field: expected, observed,
    same (nulls are equal)."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("v")) for f in fields])).alias("x")).select(*keys, "x.field", F.col("x.v").alias(name))
    both = long(expected, "expected").join(long(observed, "observed"), [*keys, "field"], "full_outer")
    return both.withColumn("same", F.col("expected").eqNullSafe(F.col("observed")))


def repaired(found: DataFrame, edits: DataFrame, printed: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows with the edits of those periods that reconcile with them; all other
    periods keep their rows as they were. ``repaired`` says which a row is of."""
    edited = apply_edits(found, edits, keys, row_id)
    closed = reconcile.reconcile(printed, edited, keys).where("reconciled").select(*keys).join(edits.select(*keys).distinct(), keys, "left_semi")
    plain = found.select(*keys, row_id, "side", "cents").join(closed, keys, "left_anti").withColumn("repaired", F.lit(False))
    return plain.unionByName(edited.join(closed, keys, "left_semi").withColumn("repaired", F.lit(True)))
