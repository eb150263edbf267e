"""Counterfactuals of graphs: the smallest sets of edges without which a prediction flips.

Candidates are sets of removed edges as rows, of all graphs at once.  A level adds one edge to every candidate that is left, has
one scoring job over the edges that stay, and ends each graph that flips; sets that hold a flip are never tried, as its
graph is done.  Without a beam all sets of a size are tried, each once (edges are added in order); with one, only the `beam`
candidates of each graph whose score is nearest to flipping go on, so what is found flips but may not be the smallest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.graph import cut


def smallest_flips(edges: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, most: int, beam: int | None = None) -> DataFrame:
    """(graph, removed, score, before) of the graphs that flip by removing `most` edges at most.

    edges: (graph, edge, ...) with whatever score reads.  score: of edges with (graph, candidate, ...), the score of each
    (graph, candidate); a candidate without edges left has score 0.  A flip crosses the threshold, at and above which is one side.
    Of equal sizes the flip whose score went furthest, then the first by edges, is told.
    """
    graphs = cut(score(edges.withColumn("candidate", F.array().cast("array<string>"))).select("graph", F.col("score").alias("before")))
    high = F.col("before") >= threshold
    # Without a beam edges are added in order, so each set comes up once; with one, in any order, and sets that come up twice are one.
    own = cut(edges.select("graph", F.col("edge").cast("string").alias("next")).distinct())
    front, found = graphs.select("graph", "before", F.array().cast("array<string>").alias("candidate")), None
    for _ in range(most):
        wider = front.join(own, "graph").where(~F.array_contains("candidate", F.col("next")) & (F.lit(beam is not None) | (F.col("next") > F.coalesce(F.array_max("candidate"), F.lit("")))))
        front = wider.select("graph", "before", F.array_sort(F.concat("candidate", F.array("next"))).alias("candidate")).distinct()
        front = cut(front)
        if front.isEmpty():
            break
        left = edges.join(front.select("graph", "candidate"), "graph").where(~F.array_contains("candidate", F.col("edge").cast("string")))
        scored = front.join(score(left).select("graph", "candidate", "score"), ["graph", "candidate"], "left").fillna(0.0, ["score"])
        scored = cut(scored.withColumn("flips", high != (F.col("score") >= threshold)))
        nearest = F.when(high, F.col("score")).otherwise(-F.col("score"))
        flips = scored.where("flips").groupBy("graph").agg(F.min(F.struct(nearest.alias("near"), F.col("candidate"), F.col("score"), F.col("before"))).alias("best"))
        flips = cut(flips.select("graph", F.col("best.candidate").alias("removed"), "best.score", "best.before"))
        found = flips if found is None else found.unionByName(flips)
        front = scored.join(flips.select("graph"), "graph", "left_anti")
        if beam is not None:
            place = F.row_number().over(Window.partitionBy("graph").orderBy(nearest, "candidate"))
            front = front.withColumn("place", place).where(F.col("place") <= beam)
        front = front.select("graph", "before", "candidate")
    return found if found is not None else graphs.select("graph", F.array().cast("array<string>").alias("removed"), F.col("before").alias("score"), "before").limit(0)
