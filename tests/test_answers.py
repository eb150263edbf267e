"""Answers from the index against the closure, and what an answer reads."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskloom.operators import answers, graph


def test_answers(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)] + [("x", "y")]
    edges = spark.createDataFrame(rows, "source string, target string")
    sources = spark.createDataFrame([("n0",), ("n7",), ("alone",), ("n0",)], "source string")
    answers.write_index(edges, sources, f"{tmp_path}/index", buckets=8)
    index = answers.read_index(spark, f"{tmp_path}/index")
    closed = {(x.seed, x.node) for x in graph.closure(edges, sources.select(F.col("source").alias("seed"))).collect()}
    got = [x for x in index.collect() if x.source is not None]
    assert {(x.source, x.node) for x in got} == closed and len(got) == len(closed)
    after, steps = {}, set(rows)
    for a, b in rows:
        after.setdefault(a, set()).add(b)
    for x in got:
        assert x.path[0] == x.source and x.path[-1] == x.node and len(x.path) == x.hops + 1
        assert all(p in steps for p in zip(x.path, x.path[1:], strict=False))
        seen, front, hops = {x.source}, {x.source}, 0
        while x.node not in seen:
            front = {b for a in front for b in after.get(a, ())} - seen
            seen |= front
            hops += 1
        assert hops == x.hops
    # One bucket is read.
    plan = answers.why(index, "n3", 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "xxhash64" not in plan
    answers.functions(spark, f"{tmp_path}/index", buckets=8)
    for node in ("n3", "n0", "alone", "y", "nowhere"):
        want = {(s, h) for s, h in ((x.source, x.hops) for x in got if x.node == node)}
        assert {(x.source, x.hops) for x in spark.sql(f"SELECT * FROM why('{node}')").collect()} == want == {(x.source, x.hops) for x in answers.why(index, node, 8).collect()}
    target = next(x for x in got if x.hops > 1)
    assert [x.node for x in spark.sql(f"SELECT * FROM path('{target.source}', '{target.node}') ORDER BY place").collect()] == target.path
    reason = lambda n: spark.sql(f"SELECT * FROM why_not('{n}')").first()[0]
    assert (reason("y"), reason("nowhere"), reason(target.node), reason("alone")) == ("no_path_from_sources", "target_not_in_graph", "reached", "reached")
