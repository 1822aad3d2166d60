"""Connected components of a table of links, by alternating star contraction.

Each turn links every node's larger neighbours to its smallest neighbour (large
star), then the smaller ones likewise (small star), as aggregations and joins;
after a logarithmic number of turns every node is linked to the smallest node
of its component alone. Turns are written tables in the shared folder, so
lineage stays short and nothing is brought to the driver but one count a turn. The
smallest neighbours are a written table too: so both sides of the join with them are
shuffled for the join alone, and AQE can split the rows of a hub over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, small_enough

BROADCAST_BYTES = 16 << 20


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links (a, b), a < b, distinct."""
    if small:
        near = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    moved = near.join(F.broadcast(least) if small_enough(least, F.lit(96), BROADCAST_BYTES) else least, "u")
    if small:
        out = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    else:
        out = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable. Only nodes that
    have a link are returned."""
    now = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        # A node below another and above a third isn't settled yet; nor is one below two.
        tops = now.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        loose = tops.where("n > 1").select("b").unionByName(tops.select("b").join(now.select(F.col("a").alias("b")), "b", "left_semi"))
        if loose.isEmpty():
            break
        now = materialize(_star(_star(now, False), True), "links")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
