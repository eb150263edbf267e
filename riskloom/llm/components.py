"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is a join and an aggregate; tables are cut by checkpoint() into the shared folder, and
nothing but row counts and one sum reaches the driver.  A hub's links are never gathered in one
row: the hub's smallest neighbour is aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b) with a > b."""
    if large:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return up.where("a > b").distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(least, "a")
    moved = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b) that isn't its component's smallest node."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = saved(links)
    state = None
    while True:
        links = saved(_star(_star(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == state and now[0] == now[2]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
