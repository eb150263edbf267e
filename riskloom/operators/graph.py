"""Reachability, roots, simple paths, label propagation and degrees over edges(source, target).

Fixpoints are frontier rounds: each joins the edges with what the last round found new and removes what
is known.  Rounds are cut by checkpoint() into the shared folder; what is known stays as the rounds' parts.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources import shared


def cut(df: DataFrame) -> DataFrame:
    """df computed once, as a checkpoint in the shared folder."""
    return shared.checkpointed(df)


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) of all nodes reachable from seeds(seed), themselves included."""
    step = edges.select("source", "target").distinct()
    known = cut(seeds.select("seed", F.col("seed").alias("node")).distinct())
    new = known
    while True:
        new = new.join(step, F.col("node") == F.col("source")).select("seed", F.col("target").alias("node")).distinct()
        new = cut(new.join(known, ["seed", "node"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionAll(new)


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def roots(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(seed, root): of each target the nodes that reach it and that nothing leads to."""
    back = closure(reversed_(edges), targets)
    return back.join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti").select("seed", F.col("node").alias("root"))


def explained(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(seed, sources, reason) of targets(seed): the roots that reach it, sorted and joined, and why it may yet not be tainted."""
    nodes = edges.select(F.col("source").alias("seed")).union(edges.select("target")).distinct().withColumn("there", F.lit(True))
    found = roots(edges, targets).groupBy("seed").agg(F.array_join(F.array_sort(F.collect_set("root")), ",").alias("sources"))
    out = targets.join(nodes, "seed", "left").join(found, "seed", "left")
    reason = F.when(F.col("there").isNull(), "target_not_in_graph").when(F.col("sources").isNull(), "no_path_from_sources").otherwise("taint_not_propagated")
    # A target that isn't in the graph is its own root, and has no source.
    return out.select("seed", F.when(F.col("there").isNull(), "").otherwise(F.coalesce("sources", F.lit(""))).alias("sources"), reason.alias("reason"))


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int | None = 8, stop: bool = True) -> DataFrame:
    """(path, hops) of the paths without a repeated node from starts(node) to ends(node), of at most
    `most` hops, or of any number.  stop: a path goes no further than the first end."""
    last = ends.select(F.col("node").alias("target"), F.lit(True).alias("ended"))
    step = edges.select("source", "target").join(last, "target", "left").select("source", "target", F.coalesce("ended", F.lit(False)).alias("ended"))
    front = cut(starts.select(F.array("node").alias("path"), F.col("node").alias("at")))
    out = None
    for hops in count(1) if most is None else range(1, most + 1):
        front = front.join(step, F.col("at") == F.col("source")).where(~F.array_contains("path", F.col("target")))
        front = cut(front.select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("at"), "ended"))
        done = front.where("ended").select("path", F.lit(hops).alias("hops"))
        out = done if out is None else out.unionAll(done)
        front = (front.where("not ended") if stop else front).select("path", "at")
        if front.isEmpty():
            break
    return out


def labels_backward(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, labels): each node's own labels(node, label) and those of all that it reaches, sorted."""
    back = closure(reversed_(edges), labels.select(F.col("node").alias("seed")))
    return back.join(labels.select(F.col("node").alias("seed"), "label"), "seed").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def degrees(edges: DataFrame) -> DataFrame:
    """In-degree of every node, over the number of other nodes."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()
    n = nodes.agg(F.count("*").alias("n"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("indegree"))
    out = nodes.join(into, "node", "left").na.fill(0, ["indegree"]).crossJoin(F.broadcast(n))
    return out.select("node", "indegree", F.round(F.col("indegree") / (F.col("n") - 1), 12).alias("centrality"))
