"""Ranks and running values in two levels, so that no key needs a task of its own.

A window gives one key's rows to one task. Here rows are dealt by range of key and
order, so a large key lies over many blocks in order; each block is summed up in a
row, running values over the blocks are taken from these rows (as many as
blocks), and what comes before a block is joined back to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import written

#: Bits of ``monotonically_increasing_id`` below the partition's number.
_PLACE = 33


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the rank of each row from 1 in the order of all rows: a range sort
    and the row counts of its partitions. Equal rows get ranks of their own. The
    result is written, so ranks stay as they are when it is read again."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(sorted_.withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__at", _PLACE))
    counts = table.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row a partition, so broadcasting and the window over all of them are bounded.
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = table.join(F.broadcast(before), "__part")
    return placed.select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _PLACE) - 1)) + 1).alias(rank))


def along(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """Running values along each key in ``order``: every name of ``sums`` gets the sum
    up to a row, the row included; every name of ``lasts`` the last value before the
    row that isn't null.

    With ``most`` a key of more rows than that is dealt over blocks of about as many by
    range; without, and for all other keys, a window does. Both give the same. A null
    key is a key.
    """
    sums, lasts = sums or {}, lasts or {}
    if most is None:
        return _windowed(rows, keys, order, sums, lasts)
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    large = written(large.select(*[F.col(k).alias(f"__{k}") for k in keys], "__n"), "large_keys")
    held = large.agg(F.sum("__n").alias("n")).first()["n"]
    if held is None:
        return _windowed(rows, keys, order, sums, lasts)
    large = large.drop("__n")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    small = _windowed(rows.join(large, same, "left_anti"), keys, order, sums, lasts)
    return small.unionByName(_blocked(rows.join(large, same, "left_semi"), keys, order, sums, lasts, held // max(most, 1) + 1))


def _windowed(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({n: F.sum(x).over(upto) for n, x in sums.items()} | {n: F.last(x, ignorenulls=True).over(before) for n, x in lasts.items()})


def _blocked(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], lasts: dict[str, Column], blocks: int) -> DataFrame:
    """Two levels: windows inside blocks, and one row a key and block for what was
    before. Of these a key has as many as blocks, so no task holds a key's rows."""
    dealt = rows.withColumns({f"__s_{n}": x for n, x in sums.items()} | {f"__l_{n}": x for n, x in lasts.items()})
    dealt = written(dealt.repartitionByRange(blocks, *keys, *order).withColumn("__block", F.spark_partition_id()), "blocks")
    place = F.struct(*order)
    ends = [F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums] + [F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), place)).alias(f"__l_{n}") for n in lasts]
    summed = dealt.groupBy(*keys, "__block").agg(*ends)
    past = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = summed.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__at"), *[F.sum(f"__s_{n}").over(past).alias(f"__b_{n}") for n in sums], *[F.last(f"__l_{n}", ignorenulls=True).over(past).alias(f"__b_{n}") for n in lasts])
    inside = _windowed(dealt, [*keys, "__block"], order, {f"__r_{n}": F.col(f"__s_{n}") for n in sums}, {f"__r_{n}": F.col(f"__l_{n}") for n in lasts})
    found = inside.join(before, [F.col("__block") == F.col("__at"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]])
    either = lambda n: F.when(F.col(f"__b_{n}").isNull(), F.col(f"__r_{n}")).when(F.col(f"__r_{n}").isNull(), F.col(f"__b_{n}"))
    out = {n: either(n).otherwise(F.col(f"__b_{n}") + F.col(f"__r_{n}")) for n in sums} | {n: F.coalesce(f"__r_{n}", f"__b_{n}") for n in lasts}
    return found.select(*rows.columns, *[x.alias(n) for n, x in out.items()])
