"""Mixing sources to target weights by weighted fair queueing.

Every source is one queue. Its documents are shuffled by a hash of their id and
served in that order, up to ``epochs`` times over; the k-th word served of a queue
has the virtual finish time ``k / target``. All words of all queues, in order of
virtual finish time, are truncated at the total budget, the targets' whole words.

The budget is met at virtual time ``CUT`` = 1: a queue has as many words up to
then as its target has whole words, and these add up to the budget. So a word is
before the cut of the global order if its own virtual finish time isn't past
``CUT``; the words of a document before the cut are told from where it starts and
ends in virtual time, and the document in service then is cut there. The SQL of
op6_mixing sorts all words and truncates, to the same rows.

Scale: cumulative words need no task that holds a whole source. Documents fall
into ``buckets`` by the leading bits of their shuffle hash; sums of buckets are
aggregated (map-side first), their running totals are taken over a table of
sources x buckets rows, and only inside a bucket a window adds up single
documents. The final order is one range sort of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Virtual time at which the targets, and so the total budget, are met.
CUT = 1.0
BUCKETS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    Weights repeat over the sources in code point order, null last. Targets
    share ``share`` times all words by weight; a target stops at ``epochs``
    times its source's size, and what is left over is shared again by weight
    until none is above. In closed form: sources in order of size over weight
    fill up first, and the first level at which the next source is not full is
    the answer. The windows run over one row a source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    full = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = full.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("rank").alias("k"), F.col("level").alias("v")))).over(whole)
    filled = levels.withColumn("fill", first)
    return filled.select("source", "source_size", "weight", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fill.v") * F.col("weight"))).alias("target"))


def shuffle_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5: the shuffled place of a document in its queue."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Schedules documents (doc_id, text, source).

    Returns doc_id, size, source_size, target, taken, virtual_finish (of the
    last word taken; null where none is) and the columns ``keep`` of the same
    row, in order of virtual time. A null or
    blank text has size 0 and is taken 0 times; a null source is a source of
    its own; rows with equal ids follow each other in order of size; an empty
    table gives an empty result.
    """
    shift = (1 << 60) // buckets
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_hash(F.col("doc_id")).alias("place"), *([F.struct(*keep).alias("kept")] if keep else []))
    sized = sized.withColumn("bucket", F.floor(F.col("place") / F.lit(shift)).cast("int")).withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    keys = ["no_source", "source"]
    sums = sized.groupBy(*keys, "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(run), F.lit(0)))
    by_source = sums.groupBy(*keys).agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("no_source"), F.lit(None)).otherwise(F.col("source")))
    targets = source_targets(by_source, weights, share, epochs).withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    places = starts.join(targets, keys).select(*keys, "bucket", "start", "source_size", "target")
    inner = Window.partitionBy(*keys, "bucket").orderBy("place", "doc_id", "size", *([F.xxhash64("kept")] if keep else [])).rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("upto", F.sum("size").over(inner)).join(places, [*keys, "bucket"])
    queued = queued.withColumn("before", F.col("start") + F.col("upto") - F.col("size"))
    # In pass e a document's words are those after ``before + e * source_size`` of its queue.
    due = F.floor(F.lit(CUT) * F.col("target")).cast("long")  # words of the queue before the cut
    before_cut = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), due - F.col("before") - F.col("source_size") * e))
    taken = sum((before_cut(e) for e in range(1, epochs)), before_cut(0)).cast("long")
    full = F.least(F.lit(epochs - 1), F.floor(F.try_divide(F.col("taken") - 1, F.col("size")))).cast("long")
    last = F.when(F.col("taken") > 0, (full * F.col("source_size") + F.col("before") + F.col("taken") - full * F.col("size")) / F.col("target"))
    out = queued.withColumn("taken", taken).withColumn("virtual_finish", last)
    return out.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish", *(F.col("kept")[c].alias(c) for c in keep)).orderBy(F.col("virtual_finish").asc_nulls_last(), "doc_id")
