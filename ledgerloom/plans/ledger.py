"""The tie-out's inputs, made of the events table: account = user, period = week.

Printed figures are those of the whole ledger; parsed rows are the ledger with a
few rows dropped, put on the wrong side or doubled, by event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.money import cents

KEYS = ["account", "period"]
OPENING = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("purchase", "signup"), "deposit").otherwise("withdrawal")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.to_date(F.date_trunc("week", "ts")).alias("period"), "event_id", "ts", cents(F.col("value")).alias("cents"), side.alias("side"))


def parsed(rows: DataFrame) -> DataFrame:
    other = F.when(F.col("side") == "deposit", "withdrawal").otherwise("deposit")
    out = rows.where("event_id % 197 <> 5 and cents <> 0").withColumn("side", F.when(F.col("event_id") % 211 == 7, other).otherwise(F.col("side")))
    return out.withColumn("copy", F.explode(F.when(F.col("event_id") % 199 == 11, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")


def printed(rows: DataFrame, hide: bool = True) -> DataFrame:
    """Printed figures; with ``hide`` some are missing, by account: no totals, no
    counts, no balances, counts alone, nothing, all."""
    side = lambda s: F.when(F.col("side") == s, F.col("cents"))
    full = rows.groupBy(*KEYS).agg(F.coalesce(F.sum(side("deposit")), F.lit(0)).alias("deposits_total"), F.coalesce(F.sum(side("withdrawal")), F.lit(0)).alias("withdrawals_total"), F.count(side("deposit")).alias("deposits_count"), F.count(side("withdrawal")).alias("withdrawals_count"))
    full = full.withColumn("beginning", F.lit(OPENING).cast("bigint")).withColumn("ending", F.col("beginning") + F.col("deposits_total") - F.col("withdrawals_total"))
    if not hide:
        return full
    kind = F.col("account") % 6
    gone = {"beginning": (2, 3, 4), "ending": (2, 3, 4), "deposits_total": (0, 3, 4), "withdrawals_total": (0, 3, 4), "deposits_count": (1, 3), "withdrawals_count": (1, 3)}
    return full.withColumns({c: F.when(~kind.isin(*k), F.col(c)) for c, k in gone.items()})
