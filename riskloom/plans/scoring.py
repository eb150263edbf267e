"""Queries of the evidence algebra, over evidence and votes bound to lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import evidence as E
from riskloom.plans.registry import register

SINKS = [g[0] for g in E.GATES] + ["UNKNOWN"]
TYPES = list(E.WEIGHTS)
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
EVIDENCE = f"""evidence AS (SELECT l_orderkey AS case_id, {_list(SINKS)}[(l_orderkey % 12 + 1)::INT] AS sink, l_orderkey % 2 = 0 AS direct, {_list(TYPES)}[l_linenumber] AS evidence_type,
 least(l_discount * 10, 1.0::DOUBLE) AS confidence FROM lineitem)"""
GATES = "gates(sink, direct_at, indirect_at, required, least, fp_penalty) AS (VALUES " + ", ".join(f"('{g[0]}', {g[1]}::DOUBLE, {g[2]}::DOUBLE, {_list(g[3])}, {g[4]}, {g[5]}::DOUBLE)" for g in E.GATES) + ")"
WEIGHTS = "weights(evidence_type, w) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in E.WEIGHTS.items()) + ")"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), at.cast("int"))
    return lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("case_id"), pick(SINKS, F.col("l_orderkey") % 12 + 1).alias("sink"), (F.col("l_orderkey") % 2 == 0).alias("direct"),
        pick(TYPES, F.col("l_linenumber")).alias("evidence_type"), F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("confidence"),
    )


@register(
    "e06_sink_gate",
    f"""WITH {EVIDENCE}, {GATES}, {WEIGHTS},
    g AS (SELECT case_id, sink, direct, count(*) AS n, sum(w * confidence) / sum(w) AS raw, list(DISTINCT evidence_type) AS types FROM evidence JOIN weights USING (evidence_type) GROUP BY case_id, sink, direct),
    j AS (SELECT *, n >= least AND list_has_all(types, required) AS met, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw * CASE WHEN direct THEN 1.05::DOUBLE ELSE 0.95::DOUBLE END)) * CASE WHEN list_contains(types, 'MULTIPLE_PATHS') THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
      * CASE WHEN list_contains(types, 'DANGEROUS_PATTERN') THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END AS a FROM g LEFT JOIN gates USING (sink)),
    c AS (SELECT *, CASE WHEN required IS NULL THEN 0.5::DOUBLE WHEN NOT met THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN list_contains(types, 'WEAK_VALIDATION') OR list_contains(types, 'INEFFECTIVE_SANITIZER') THEN a * 0.85::DOUBLE - fp_penalty ELSE a END)) END AS confidence FROM j)
    SELECT case_id, sink, direct, n, round(raw, 9) AS weighted, round(confidence, 9) AS confidence, coalesce(required IS NOT NULL AND met AND confidence >= CASE WHEN direct THEN direct_at ELSE indirect_at END, false) AS passed FROM c""",
)
def sink_gate(spark, sf_dir):
    return E.gated(evidence(spark, sf_dir), "case_id")


@register(
    "e05_evidence_requirement",
    f"""WITH {EVIDENCE}, {GATES}, g AS (SELECT case_id, sink, count(*) AS n, list(DISTINCT evidence_type) AS types FROM evidence GROUP BY case_id, sink)
    SELECT sink, count(*) AS cases, count(*) FILTER (n >= least AND list_has_all(types, required)) AS met FROM g JOIN gates USING (sink) GROUP BY sink""",
)
def evidence_requirement(spark, sf_dir):
    g = evidence(spark, sf_dir).groupBy("case_id", "sink").agg(F.count("*").alias("n"), F.collect_set("evidence_type").alias("types")).join(F.broadcast(E.gate_table(spark)), "sink")
    met = (F.col("n") >= F.col("least")) & (F.size(F.array_except("required", "types")) == 0)
    return g.groupBy("sink").agg(F.count("*").alias("cases"), F.count_if(met).alias("met"))


_V0, _H = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, v_in))", "greatest(0.0::DOUBLE, least(1.0::DOUBLE, h_in))"


@register(
    "e15_asymmetric_fusion",
    f"""WITH i AS (SELECT l_discount * 10 AS h_in, CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE (l_extendedprice * 100)::BIGINT % 1100 / 1000.0::DOUBLE END AS v_in, CASE WHEN l_quantity > 25 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS s_in, l_tax > 0.07 AS ood FROM lineitem),
    n AS (SELECT *, {_H} AS h, {_V0} AS v0, CASE WHEN s_in <= 0 THEN 1 - {_V0} ELSE s_in END AS s0 FROM i), p AS (SELECT *, CASE WHEN s0 + v0 > 0 THEN v0 / (s0 + v0) ELSE v0 END AS v FROM n),
    c AS (SELECT *, CASE WHEN isnan(v_in) THEN 'heuristic_only_nan_gnn' WHEN ood THEN 'heuristic_only_ood' WHEN h >= 0.7 THEN CASE WHEN abs(v - h) <= 0.15::DOUBLE + 1e-12::DOUBLE AND v >= h THEN 'gnn_boost' ELSE 'heuristic_only' END
      WHEN h >= 0.4 THEN CASE WHEN v > h AND v >= 0.55 THEN 'gnn_boost' ELSE 'heuristic_only' END WHEN h >= 0.2 THEN CASE WHEN v >= 0.85 THEN 'gnn_calibrated' ELSE 'heuristic_only' END WHEN v >= 0.85 THEN 'gnn_only' ELSE 'heuristic_only' END AS how FROM p),
    r AS (SELECT *, CASE how WHEN 'heuristic_only_ood' THEN greatest(h, 0.6::DOUBLE) WHEN 'gnn_only' THEN greatest(0.5::DOUBLE, 0.7::DOUBLE * v) WHEN 'gnn_calibrated' THEN greatest(h, CASE WHEN v > 0.95 THEN 0.7::DOUBLE * h + 0.3::DOUBLE * 0.85::DOUBLE ELSE 0.6::DOUBLE * h + 0.4::DOUBLE * v END)
      WHEN 'gnn_boost' THEN CASE WHEN h >= 0.7 THEN least(1.0::DOUBLE, h + 0.3::DOUBLE * (v - h)) ELSE greatest(h, least(0.95::DOUBLE, h + 0.3::DOUBLE * (CASE WHEN v > 0.95 THEN 0.8::DOUBLE ELSE v END - h))) END ELSE h END AS combined FROM c)
    SELECT how, count(*) AS n, round(avg(combined), 6) AS mean, round(min(combined - h), 6) AS least_gain, round(max(combined), 6) AS most FROM r GROUP BY how""",
)
def asymmetric_fusion(spark, sf_dir):
    i = lineitem(spark, sf_dir).select(
        (F.col("l_discount") * 10).alias("h"),
        F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.round(F.col("l_extendedprice") * 100).cast("long") % 1100 / 1000.0).alias("v"),
        F.when(F.col("l_quantity") > 25, 0.0).otherwise(0.5).alias("s"), (F.col("l_tax") > 0.07).alias("ood"),
    )
    combined, how = E.fused(F.col("h"), F.col("v"), F.col("s"), F.col("ood"))
    r = i.select(how.alias("how"), combined.alias("combined"), E.clamp(F.col("h")).alias("h"))
    return r.groupBy("how").agg(F.count("*").alias("n"), F.round(F.avg("combined"), 6).alias("mean"), F.round(F.min(F.col("combined") - F.col("h")), 6).alias("least_gain"), F.round(F.max("combined"), 6).alias("most"))


VOTES = "votes AS (SELECT l_orderkey AS item, l_linenumber AS model, round(avg(l_discount * 10), 4) AS p, round(avg(l_tax * 10), 4) AS c, (l_linenumber::DOUBLE) AS w FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("model")).agg(F.round(F.avg(F.col("l_discount") * 10), 4).alias("p"), F.round(F.avg(F.col("l_tax") * 10), 4).alias("c"), F.first(F.col("l_linenumber").cast("double")).alias("w"))


@register(
    "e18_weighted_voting",
    f"""WITH {VOTES} SELECT item, round(sum(CASE WHEN p > 0.5 THEN w ELSE 0 END) / sum(w), 9) AS hard, round(least(1.0::DOUBLE, 0.5 + abs(round(sum(CASE WHEN p > 0.5 THEN w ELSE 0 END) / sum(w), 9) - 0.5)), 9) AS hard_confidence,
    round(CASE WHEN sum(w * c) > 0 THEN sum(p * w * c) / sum(w * c) ELSE 0 END, 12) AS soft, round(sum(c * w) / sum(w), 12) AS soft_confidence FROM votes GROUP BY item""",
)
def weighted_voting(spark, sf_dir):
    w, p, c = F.col("w"), F.col("p"), F.col("c")
    hard = F.round(F.sum(F.when(p > 0.5, w).otherwise(0.0)) / F.sum("w"), 9)
    wc = F.sum(w * c)
    return votes(spark, sf_dir).groupBy("item").agg(
        hard.alias("hard"), F.round(F.least(F.lit(1.0), 0.5 + F.abs(hard - 0.5)), 9).alias("hard_confidence"), F.round(F.when(wc > 0, F.sum(p * w * c) / wc).otherwise(0.0), 12).alias("soft"), F.round(F.sum(c * w) / F.sum("w"), 12).alias("soft_confidence")
    )


@register("e17_model_ensemble", f"WITH {VOTES} SELECT item, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS sd, count(*) FILTER (p > 0.5) * 2 > count(*) AS majority FROM votes GROUP BY item")
def model_ensemble(spark, sf_dir):
    return votes(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_pop("p"), 6).alias("sd"), (F.count_if(F.col("p") > 0.5) * 2 > F.count("*")).alias("majority"))


@register("e19_vote_diversity", f"WITH {VOTES}, k AS (SELECT item, count(*) AS n, count(*) FILTER (p > 0.5) AS y FROM votes GROUP BY item) SELECT item, n, round(CASE WHEN n > 1 THEN y * (n - y) / (n * (n - 1) / 2.0::DOUBLE) ELSE 0 END, 9) AS diversity FROM k")
def vote_diversity(spark, sf_dir):
    """Disagreeing pairs of voters over all pairs, from the counts: no pair is made."""
    k = votes(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"), F.count_if(F.col("p") > 0.5).alias("y"))
    return k.select("item", "n", F.round(F.when(F.col("n") > 1, F.col("y") * (F.col("n") - F.col("y")) / (F.col("n") * (F.col("n") - 1) / 2.0)).otherwise(0.0), 9).alias("diversity"))


@register("e16_temperature_scaling", "SELECT l_discount, count(*) AS n, round(1 / (1 + exp(-ln(greatest(1e-6::DOUBLE, least((1 - 1e-6)::DOUBLE, l_discount * 10)) / (1 - greatest(1e-6::DOUBLE, least((1 - 1e-6)::DOUBLE, l_discount * 10)))) / 1.5::DOUBLE)), 9) AS scaled FROM lineitem GROUP BY l_discount")
def temperature_scaling(spark, sf_dir):
    g = lineitem(spark, sf_dir).groupBy("l_discount").agg(F.count("*").alias("n"))
    return g.select("l_discount", "n", F.round(E.temperature_scaled(F.col("l_discount") * 10, 1.5), 9).alias("scaled"))


@register(
    "e26_severity",
    "SELECT CASE WHEN c >= 0.9 THEN 'critical' WHEN c >= 0.7 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM (SELECT l_discount * 10 AS c FROM lineitem) GROUP BY ALL",
)
def severity(spark, sf_dir):
    c = F.col("l_discount") * 10
    return lineitem(spark, sf_dir).groupBy(F.when(c >= 0.9, "critical").when(c >= 0.7, "high").when(c >= 0.5, "medium").otherwise("low").alias("severity")).agg(F.count("*").alias("n"))


@register(
    "g16_reachability_confidence",
    "WITH k AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS flows, count(*) AS sinks FROM orders GROUP BY o_custkey) SELECT id, flows, CASE WHEN flows = 0 THEN 'unreachable' WHEN flows = 1 THEN 'direct' WHEN flows <= 3 THEN 'indirect' ELSE 'conditional' END AS kind, CASE WHEN flows = 0 THEN 0.0::DOUBLE WHEN flows = 1 THEN 0.85::DOUBLE WHEN flows <= 3 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM k",
)
def reachability_confidence(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("flows"))
    n = F.col("flows")
    kind = F.when(n == 0, "unreachable").when(n == 1, "direct").when(n <= 3, "indirect").otherwise("conditional")
    return k.select("id", "flows", kind.alias("kind"), F.when(n == 0, 0.0).when(n == 1, 0.85).when(n <= 3, 0.75).otherwise(0.65).alias("confidence"))


@register(
    "e29_quality_issues",
    "WITH q AS (SELECT o_custkey AS id, avg(o_totalprice) / 500000 AS conf, count(*) AS nodes, count(*) FILTER (o_orderstatus = 'O') AS missing FROM orders GROUP BY o_custkey), i AS (SELECT *, (conf < 0.3)::INT + (nodes < 10)::INT + (missing > 5)::INT AS issues FROM q) SELECT id, issues, round((least(1.0::DOUBLE, conf) + CASE WHEN missing = 0 THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END + least(1.0::DOUBLE, nodes / 100.0::DOUBLE) + greatest(0.0::DOUBLE, 1 - 0.2::DOUBLE * issues)) / 4, 6) AS score FROM i",
)
def quality_issues(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg((F.avg("o_totalprice") / 500000).alias("conf"), F.count("*").alias("nodes"), F.count_if(F.col("o_orderstatus") == "O").alias("missing"))
    issues = F.array_compact(F.array(F.when(F.col("conf") < 0.3, "confidence"), F.when(F.col("nodes") < 10, "nodes"), F.when(F.col("missing") > 5, "missing")))
    score = (F.least(F.lit(1.0), F.col("conf")) + F.when(F.col("missing") == 0, 0.8).otherwise(0.4) + F.least(F.lit(1.0), F.col("nodes") / 100.0) + F.greatest(F.lit(0.0), 1 - 0.2 * F.size(issues))) / 4
    return q.select("id", F.size(issues).alias("issues"), F.round(score, 6).alias("score"))
