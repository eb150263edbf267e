"""Properties that hold for any input."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from riskloom.functions.ranking import numbered
from riskloom.operators import calibration, evidence, graph
from riskloom.sources import files


def test_fusion_never_lowers_and_stays_in_range(spark):
    rng = random.Random(5)
    odd = [0.0, 0.2, 0.4, 0.55, 0.7, 0.85, 0.95, 0.9500001, 1.0, -1.0, 2.0, math.nan, math.inf, 0.85 - 0.15]
    draw = lambda: rng.choice(odd) if rng.random() < 0.4 else rng.random()
    rows = [(draw(), draw(), draw(), rng.random() < 0.1) for _ in range(1000)]
    df = spark.createDataFrame(rows, "h double, v double, s double, ood boolean")
    combined, how = evidence.fused(F.col("h"), F.col("v"), F.col("s"), F.col("ood"))
    names = set()
    for r in df.select("h", combined.alias("c"), how.alias("how")).collect():
        assert 0 <= r.c <= 1
        if math.isfinite(r.h):
            assert r.c >= min(1.0, max(0.0, r.h)) - 1e-12
        names.add(r.how)
    assert {"gnn_boost", "heuristic_only", "error_nan_heuristic", "heuristic_only_ood", "gnn_only", "gnn_calibrated", "heuristic_only_nan_gnn"} == names


def test_perfect_and_wrong_predictions(spark):
    perfect = spark.createDataFrame([(1.0, 1, 1)] * 10, "conf double, label int, pred int")
    wrong = spark.createDataFrame([(1.0, 1, 0)] * 10, "conf double, label int, pred int")
    assert calibration.errors(calibration.bins(perfect)).first().ece == 0
    e = calibration.errors(calibration.bins(wrong)).first()
    assert e.ece > 0 and e.security >= e.ece


def test_closure_is_idempotent(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    once = graph.closure(edges, spark.createDataFrame([("a",)], "seed string"))
    again = graph.closure(once.select(F.col("seed").alias("source"), F.col("node").alias("target")), spark.createDataFrame([("a",)], "seed string"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [("a", x) for x in "abcd"]


def test_numbered_is_a_total_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert [r.rn for r in numbered(df, "x").orderBy("x").collect()] == list(range(1, 1001))


def test_readers(spark, tmp_path):
    (tmp_path / "A.java").write_text("class A {}")
    (tmp_path / "b.txt").write_text("no")
    assert [r.code for r in files.source_tree(spark, str(tmp_path)).collect()] == ["class A {}"]
    (tmp_path / "expected.csv").write_text("# comment\n\nT1, SQLi ,TRUE,89\nshort,row\nT2,xss,false,79\n")
    assert sorted(map(tuple, files.expected_results(spark, str(tmp_path / "expected.csv")).collect())) == [("T1", "sqli", True, "89"), ("T2", "xss", False, "79")]
    (tmp_path / "records.csv").write_text("vul_id,cwe_id\nV1, 1\n,2\nV1,3\nV2,4\n")
    assert sorted((r.vul_id, r.cwe_id) for r in files.records(spark, str(tmp_path / "records.csv")).collect()) == [("V1", "3"), ("V2", "4")]
    (tmp_path / "p.json").write_text('[{"confidence": 0.7, "ground_truth": 1, "graph_nodes": 60}, {"confidence": 0.2}]')
    assert [tuple(r) for r in files.predictions(spark, str(tmp_path / "p.json")).collect()] == [(0.7, 1, 1, "medium")]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": 0, "node_type": "METHOD"}, {"id": 1, "node_type": "CALL"}], "edges": []}')
    assert tuple(files.graph_summary(files.program_graphs(spark, str(tmp_path / "g.json"))).first()) == (2, 1, 1, 3)


def test_simple_paths_of_any_length(spark):
    from riskloom.plans import graphs

    chain = [("src", "n0"), *[(f"n{i}", f"n{i + 1}") for i in range(22)], ("n22", "sink")]
    edges = spark.createDataFrame(chain, "source string, target string")
    before, graphs.edges = graphs.edges, lambda *_: edges
    try:
        assert [(r.path.count(">"), r.hops) for r in graphs.all_simple_paths(spark, "").collect()] == [(24, 24)]
    finally:
        graphs.edges = before
    starts, ends = spark.createDataFrame([("src",)], "node string"), spark.createDataFrame([("sink",)], "node string")
    assert graph.simple_paths(edges, starts, ends, 23).count() == 0
