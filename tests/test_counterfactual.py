"""Smallest flips against exhaustive search on graphs of up to twelve edges."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from riskloom.operators.counterfactual import smallest_flips


def pairs(rows):
    """The number of pairs of edges that meet: an edge's target is another's source; not a sum over edges."""
    ends = rows.select("graph", "candidate", F.col("source").alias("at"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(rows.select("graph", "candidate", F.col("target").alias("at"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    met = ends.groupBy("graph", "candidate", "at").agg((F.sum("out") * F.sum("into")).alias("n"))
    return met.groupBy("graph", "candidate").agg(F.sum("n").cast("double").alias("score"))


def brute(edges, threshold, most):
    def value(kept):
        return sum(1 for a in kept for b in kept if a[2] == b[1])

    before = value(edges)
    for k in range(1, most + 1):
        flips = [(value([e for e in edges if e not in c]), sorted(x[0] for x in c)) for c in combinations(edges, k) if (value([e for e in edges if e not in c]) >= threshold) != (before >= threshold)]
        if flips:
            return min(flips) if before >= threshold else min((-s, c) for s, c in flips)
    return None


def test_smallest_flips(spark):
    r, graphs = random.Random(9), {}
    for g in range(10):
        n = r.randint(1, 12)
        graphs[f"g{g}"] = [(f"e{i:02d}", r.randrange(4), r.randrange(4)) for i in range(n)]
    rows = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], "graph string, edge string, source int, target int")
    got = {x.graph: (x.score, x.removed) for x in smallest_flips(rows, pairs, 4, 3).collect()}
    want = {g: w for g, es in graphs.items() if (w := brute(es, 4, 3))}
    assert got == want and len(want) > 3
    beam = {x.graph: x for x in smallest_flips(rows, pairs, 4, 6, beam=3).collect()}
    assert want.keys() <= beam.keys() and all((x.score >= 4) != (x.before >= 4) and len(x.removed) >= len(want.get(g, (0, x.removed))[1]) for g, x in beam.items())
    assert smallest_flips(rows, pairs, 4, 0).count() == 0
