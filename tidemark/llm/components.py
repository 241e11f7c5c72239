"""Connected components of a link table by alternating star contractions.

Each round moves links towards the smallest neighbour: *large star* hangs all
larger neighbours of a node on its smallest neighbour, *small star* hangs a
node and its smaller neighbours on the smallest. Rounds are logarithmic in the
component's size, and every round is two aggregations and two joins over the
links, written to the checkpoint folder. No node's links are ever listed; a
node with very many links is one aggregated row and a skewed join that AQE
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage_table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``links`` (u, v)."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # each link from its larger end
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): every node of ``links`` (u long, v long) with the least
    node that it reaches, itself included."""
    now = stage_table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    while True:
        now = stage_table(_star(_star(now, True), False), name)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
