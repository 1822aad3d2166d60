"""Tie-out over streams: ledger rows and printed figures, each as it comes.

``tied`` sums rows (account, ts timestamp, event_id, cents, side) by account and
tumbling window; printed figures (account, ts within the window, figures) wait for the
sums of their window in a stream-stream outer join. It is in append mode: a window is
given out once, when both watermarks have passed its end, and its state is dropped
then; rows later than that go. A row that comes twice counts once.

``windowed_totals`` are running sums by side; ``run_once`` gives them all out at the
end, the open windows too, so there the state is all windows there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerloom.functions.money import cents
from ledgerloom.operators import reconcile
from ledgerloom.sources.shared import place

LENGTH, START, LATE = "7 days", "4 days", "1 day"


def side_totals(rows: DataFrame, keys: list[str], length: str = LENGTH, late: str = LATE, start: str = START) -> DataFrame:
    """``window``, keys and the totals of both sides, a row of an ``event_id`` once."""
    seen = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return reconcile.totals(seen.withColumn("window", F.window("ts", length, startTime=start)), ["window", *keys])


def tied(figures: DataFrame, rows: DataFrame, keys: list[str], length: str = LENGTH, late: str = LATE, start: str = START) -> DataFrame:
    """Checks of each window of printed ``figures`` (keys, ts, PRINTED) against the rows
    of the window; zeros where there are none."""
    told = figures.withWatermark("ts", late).withColumn("window", F.window("ts", length, startTime=start)).drop("ts")
    both = told.join(side_totals(rows, keys, length, late, start), ["window", *keys], "leftOuter")
    return reconcile.judged(both.fillna(0, ["dep_cents", "wd_cents", "dep_n", "wd_n"])).withColumn("period", F.to_date("window.start")).drop("window")


def drain(out: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends what closes to Parquet under ``path``; a new run goes on from ``checkpoint``."""
    writer = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_totals(rows: DataFrame, length: str = "7 days", late: str = "1 day", start: str = "4 days") -> DataFrame:
    """Weeks begin on Mondays: the epoch's first day was a Thursday."""
    seen = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id", "copy"]) if "copy" in rows.columns else rows.withWatermark("ts", late)
    totals = seen.groupBy(F.window("ts", length, startTime=start), "side").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return totals.select(F.to_date("window.start").alias("period"), "side", "n", "cents")


def run_once(rows: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Drains what is there into a table in memory (tests, small reports)."""
    query = windowed_totals(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of the events, read as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    side = F.when(F.col("event_type").isin("purchase", "signup"), "deposit").otherwise("withdrawal")
    return stream.select(F.col("user_id").alias("account"), F.col("ts").cast("timestamp").alias("ts"), "event_id", cents(F.col("value")).alias("cents"), side.alias("side"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by week and side of the events."""
    rows = event_rows(spark, sf_dir).select("ts", "cents", "side")
    return run_once(rows, f"weekly_{uuid.uuid4().hex[:8]}", place(spark, "stream"))


def closed_weeks(spark: SparkSession, figures: DataFrame, rows: DataFrame) -> DataFrame:
    """Checks of the weeks that are over, of a table of printed ``figures`` (account,
    period, PRINTED) and a stream of rows: figures come in the last second of their week."""
    path, out = place(spark, "printed"), place(spark, "tied")
    due = F.timestamp_seconds(F.unix_timestamp(F.col("period").cast("timestamp")) + 7 * 86_400 - 1)
    figures.select("account", due.alias("ts"), *reconcile.PRINTED).write.parquet(path)
    told = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    drain(tied(told, rows, ["account"]), out, place(spark, "stream")).awaitTermination()
    return spark.read.parquet(out)
