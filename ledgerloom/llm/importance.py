"""Target-distribution importance resampling: documents drawn at random, likelier
the more their hashed word runs look like those of a target text.

A document's features are all runs of one to ``orders`` consecutive words, each in
the bucket of its hash. Higher-order functions make the array of a document's
buckets, which is written once; counting the totals of the buckets, ``buckets``
rows at most a task, is the only shuffle over it. The gain of a bucket is a log ratio of
smoothed shares; the gains stand in the plan as one literal array, and a
document's weight is an aggregate over its bucket array, without an explode or a
join. Gumbel noise on the weights makes the highest scores a draw without
replacement; ranks come from a range sort and the row counts of its partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import let, materialize
from ledgerloom.llm.decontamination import terms
from ledgerloom.operators.prefix import ranked

BUCKETS = 10_000
ORDERS = 3
SCALE = 1000


def features(words: Column, orders: int = ORDERS) -> Column:
    """All runs of 1 to ``orders`` words, joined by one space, repeats counted."""

    def longer(k: int, runs: Column, words: Column) -> list[Column]:
        """``runs`` of k words each, and those of more."""
        if k == orders:
            return [runs]
        there = F.greatest(F.size(words) - k, F.lit(0))
        grown = F.zip_with(F.slice(runs, F.lit(1), there), F.slice(words, F.lit(k + 1), there), lambda a, b: F.concat(a, F.lit(" "), b))
        return [runs, let(grown, lambda x: F.concat(*longer(k + 1, x, words)))]

    return let(words, lambda w: F.concat(*longer(1, w, w)))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned, by its remainder."""
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def hashed(docs: DataFrame, *keys: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(text, keys) -> keys, n_words, buckets; written."""
    words = docs.select(*keys, terms(F.col("text")).alias("w"))
    return materialize(words.select(*keys, F.size("w").alias("n_words"), F.transform(features(F.col("w"), orders), lambda x: bucket(x, buckets)).alias("buckets")), "buckets")


def totals(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all rows in each bucket; a bounded list, whatever the input."""
    found = rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()
    out = [0] * buckets
    for r in found:
        out[r["b"]] = r["count"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the ratio of the shares), each bucket's count one higher."""
    all_source, all_target = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(SCALE * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source, target, strict=True)]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, of the first 32 bits of the SHA-256 of
    ``seed:doc_id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(share))).cast("long")


def weight(buckets: Column, gain: list[int]) -> Column:
    """Sum of the gains of a bucket array; the literal is folded once a plan."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate(buckets, F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(table, b + 1))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text), (text) -> doc_id, n_words, n_features, weight, score, rank.

    Of the N documents of ``least_words`` words or more, floor(percent N / 100) are
    drawn by score; ``rank`` counts them from 1, ties to the smaller id, and is null
    for the others. A null, empty or wordless text has no feature and weight 0.
    Repeated rows of an id each take part, with the same noise; among equal scores a
    null id comes last. An empty ``docs`` gives an empty result, an empty ``target``
    a uniform target.
    """
    rows = hashed(docs, "doc_id", orders=orders, buckets=buckets)
    gain = gains(totals(rows, buckets), totals(hashed(target, orders=orders, buckets=buckets), buckets))
    scored = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    eligible = F.col("n_words") >= least_words
    order = [(~eligible).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = ranked(scored, order)
    drawn = placed.where(eligible).count() * percent // 100
    return placed.withColumn("rank", F.when(eligible & (F.col("rank") <= drawn), F.col("rank")))
