"""Scores of a file's findings: evidence items and their gate, confidences, uncertainty, routing, combination.

A signals table has a row for each (file_id, vuln_type): taint_flows, sink_hits, guard_hits (sanitizers of this
sink), sanitizer_hits, sanitized (variables), input_hits, reach_flows, reach_sources, reach_sinks (of a program
graph), effectiveness (of the sink's sanitizers; null if unknown), framework_safe, framework_unsafe,
template_off, template_on, template_unsafe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of findings whose evidence is weighed, and that are gated.
INJECTIONS = ("sql_injection", "command_injection", "ldap_injection", "xss", "xxe", "el_injection", "http_response_splitting", "path_traversal", "reflection_injection")
SEVERITIES = ("critical", "high", "medium", "low")


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def reachability(flows: Column, sources: Column, sinks: Column) -> Column:
    """How sure a graph's flows make a finding."""
    return F.when((sources == 0) | (sinks == 0) | (flows == 0), 0.0).when(flows == 1, 0.85).when(flows <= 3, 0.75).otherwise(0.65)


def evidence_items(signals: DataFrame) -> DataFrame:
    """(file_id, vuln_type, direct, evidence_type, confidence): what speaks for and against each finding."""
    c = F.col
    direct = ((c("taint_flows") > 0) & (c("sink_hits") > 0)) | (c("reach_flows") > 0)
    guarded = (c("sanitized") > 0) | (c("sanitizer_hits") > 0) | (c("guard_hits") > 0)
    in_template = c("vuln_type").isin("xss", "el_injection")
    open_template = (c("template_off") > 0) | (c("template_unsafe") > 0)
    unsafe = c("framework_unsafe") > 0
    weak = F.when(c("effectiveness") >= 0.60, F.lit("WEAK_VALIDATION")).otherwise("INEFFECTIVE_SANITIZER")
    cases = [
        (c("reach_flows") > 0, "DIRECT_TAINT_PATH", reachability(c("reach_flows"), c("reach_sources"), c("reach_sinks"))),
        (c("reach_flows") > 1, "MULTIPLE_PATHS", F.lit(0.85)),
        (c("taint_flows") > 0, F.when(direct, "DIRECT_TAINT_PATH").otherwise("INDIRECT_TAINT_PATH"), 0.70 + F.least(F.lit(0.20), 0.05 * c("taint_flows"))),
        (c("taint_flows") > 1, "MULTIPLE_PATHS", F.lit(0.80)),
        (c("sink_hits") > 0, "DANGEROUS_PATTERN", F.lit(0.75)),
        (unsafe, "DANGEROUS_PATTERN", F.lit(0.78)),
        (~unsafe & (c("framework_safe") > 0), "WEAK_VALIDATION", F.lit(0.35)),
        (in_template & open_template, "DANGEROUS_PATTERN", F.lit(0.80)),
        (in_template & ~open_template & (c("template_on") > 0), "WEAK_VALIDATION", F.lit(0.35)),
        (~guarded, "NO_SANITIZER", F.lit(0.85)),
        ((c("guard_hits") > 0) & ~F.coalesce(c("effectiveness") >= 0.85, F.lit(False)), weak, F.when(c("effectiveness") >= 0.60, 0.45).otherwise(0.30)),
        (guarded & (c("guard_hits") == 0), "WEAK_VALIDATION", F.lit(0.40)),
        ((c("input_hits") > 0) & (c("taint_flows") > 0), "DIRECT_TAINT_PATH", F.lit(0.78)),
    ]
    items = [F.when(when, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("evidence_type"), value.cast("double").alias("confidence"))) for when, kind, value in cases]
    out = signals.select("file_id", "vuln_type", direct.alias("direct"), F.explode(F.array_compact(F.array(*items))).alias("e"))
    return out.select("file_id", "vuln_type", "direct", "e.evidence_type", "e.confidence")


def taint_verdict(signals: DataFrame) -> DataFrame:
    """(file_id, vuln_type, verdict): kept, or why a finding is dropped where no sink gate judges it."""
    c = F.col
    other = (c("taint_flows") > 0) | (c("sink_hits") > 0) | (c("input_hits") > 0)
    guarded = (c("sanitized") > 0) | (c("sanitizer_hits") > 0) | (c("guard_hits") > 0)
    slight = (c("taint_flows") <= 1) & (c("sink_hits") <= 1) & (c("input_hits") == 0)
    verdict = (
        F.when(~c("vuln_type").isin(*INJECTIONS), "kept").when((c("reach_sinks") > 0) & (c("reach_sources") > 0) & (c("reach_flows") == 0) & ~other, "joern_unreachable")
        .when(c("taint_flows") <= 0, "no_taint_flows").when(c("sink_hits") <= 0, "no_sink_evidence").when(guarded & slight, "sanitization_evidence").otherwise("kept")
    )
    return signals.select("file_id", "vuln_type", verdict.alias("verdict"))


def evidence_adjustment(signals: DataFrame) -> DataFrame:
    """(file_id, adjustment): the mean over a file's findings of what its evidence moves their confidence by, 0.15 at most."""
    c = F.col

    def worth(when: Column, value: float | Column) -> Column:
        return F.when(when, value).otherwise(0.0)

    guarded = (c("sanitized") > 0) | (c("sanitizer_hits") > 0) | (c("guard_hits") > 0)
    cut = -F.least(F.lit(0.08), 0.02 * F.greatest(c("sanitized"), F.lit(1))) - worth(c("guard_hits") > 0, F.least(F.lit(0.06), 0.02 * c("guard_hits")))
    xss = worth((c("template_off") > 0) | (c("template_unsafe") > 0), 0.04) + worth((c("template_on") > 0) & (c("template_unsafe") == 0), -0.03)
    injected = reduce(Column.__add__, [
        worth(c("taint_flows") > 0, 0.08), worth(c("input_hits") > 0, 0.05), worth(c("sink_hits") > 0, 0.05), worth(c("framework_unsafe") > 0, 0.04),
        worth((c("framework_safe") > 0) & (c("framework_unsafe") == 0), -0.03), worth(c("vuln_type") == "xss", xss), worth(guarded, cut),
    ])
    # Of the other kinds, sink_hits counts the markers of the kind itself, guard_hits those of its safe form.
    each = (
        F.when(c("vuln_type").isin(*INJECTIONS), injected).when(c("vuln_type") == "weak_crypto", F.when(c("sink_hits") > 0, 0.08).otherwise(-0.04))
        .when(c("vuln_type") == "insecure_randomness", worth(c("sink_hits") > 0, 0.05) + worth(c("guard_hits") > 0, -0.05)).when(c("vuln_type") == "deserialization", F.when(c("sink_hits") > 0, 0.08).otherwise(-0.03))
        .when(c("vuln_type") == "hardcoded_credentials", F.when(c("sink_hits") > 0, 0.05).otherwise(-0.02)).otherwise(worth(c("taint_flows") > 0, 0.03))
    )
    return signals.groupBy("file_id").agg(_clamp(F.avg(each), -0.15, 0.15).alias("adjustment"))


def traditional_confidence(nodes: Column, findings: Column, graph: Column, adjustment: Column) -> Column:
    """graph: whether a program graph was there."""
    return _clamp(0.5 + F.least(nodes / 100, F.lit(0.3)) + 0.2 * findings + F.when(graph, 0.1).otherwise(0.0) + adjustment)


def noise_free_mean(nodes: Column, methods: Column, calls: Column, findings: Column) -> Column:
    """The mean prediction of the sampled network, without its noise."""
    return 1 / (1 + F.exp(-(0.5 + F.least(nodes / 200, F.lit(0.3)) + F.least(methods / 20, F.lit(0.2)) + F.least(calls / 30, F.lit(0.15)) + 0.15 * findings)))


def uncertainty(nodes: Column, findings: Column) -> tuple[Column, Column]:
    """(uncertainty, its band)."""
    u = F.when(nodes > 500, 0.15).when(nodes > 200, 0.10).otherwise(0.05) + F.when(findings == 0, 0.20).when(findings <= 5, 0.05).otherwise(0.10)
    return u, F.when(u < 0.1, "low").when(u < 0.25, "medium").when(u < 0.4, "high").otherwise("very_high")


def route(total: Column, reliable: Column) -> Column:
    return F.when(total > 0.3, "secondary_pass").when(~reliable, "expert").otherwise("automated")


def blended(bayesian: Column, traditional: Column) -> Column:
    return 0.7 * bayesian + 0.3 * traditional


def adaptive_factor(accuracy: Column) -> Column:
    """What a model's weight is multiplied by."""
    return F.when(accuracy > 0.8, 1.1).when(accuracy < 0.6, 0.9).otherwise(1.0)


def meta_ensemble(votes: DataFrame) -> DataFrame:
    """(item, prediction, confidence) of votes(item, prediction, confidence, uncertainty, method); stacking has no vote."""
    kept = votes.where("method <> 'stacking'")
    return kept.groupBy("item").agg(F.avg("prediction").alias("prediction"), F.avg(F.coalesce("confidence", 1 - F.col("uncertainty"))).alias("confidence"))


def multi_scale(scales: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, weighted, best, attention, flagged) of scales(id, scale, score, flag): four ways to combine scales."""
    w = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("scale"))
    first = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(weights) for x in (name, -i)]), F.col("scale"))  # of equal scores the first scale
    return scales.groupBy("id").agg(
        (F.sum(w * F.col("score")) / F.sum(w)).alias("weighted"), F.max_by("scale", F.struct("score", first)).alias("best"),
        (F.sum(F.exp("score") * F.col("score")) / F.sum(F.exp("score"))).alias("attention"), F.bool_or("flag").alias("flagged"),
    )


def impact(steps: Column, difficulty: Column, feasible: Column) -> Column:
    """A score of 10 at most; halves are rounded to even.  0 if infeasible."""
    return F.when(feasible, F.bround((0.7 * F.greatest(F.lit(0.1), 1 - steps / 1000) + 0.3 * _clamp(difficulty)) * 10, 1)).otherwise(0.0)


def adapted_threshold(base: Column, false_positives: Column, false_negatives: Column) -> Column:
    return base - F.when(false_positives < 0.05, 0.05).otherwise(0.0) + F.when(false_negatives < 0.10, 0.05).otherwise(0.0)


def consolidated(methods: DataFrame) -> DataFrame:
    """(id, n_methods, mean, severity) of methods(id, detected, confidence, severity): of the detecting methods the
    mean confidence and the worst severity."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return methods.where("detected").groupBy("id").agg(F.count("*").alias("n_methods"), F.avg("confidence").alias("mean"), F.min_by("severity", rank).alias("severity"))


def edge_importance(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(source, target, score): the edges whose ends' mean importance makes them most telling (a top-k)."""
    a, b = nodes.select(F.col("id").alias("source"), F.col("score").alias("sa")), nodes.select(F.col("id").alias("target"), F.col("score").alias("sb"))
    scored = edges.join(a, "source").join(b, "target").select("source", "target", (0.6 + (F.col("sa") + F.col("sb")) / 2).alias("score"))
    return scored.orderBy(F.desc("score"), "source", "target").limit(top)


def cluster_confidence(contrastive: Column, cluster: Column) -> Column:
    return 1 / (1 + F.exp(-5 * (0.6 * F.exp(-contrastive) + 0.4 * F.exp(-cluster) - 0.5)))


def patch_confidence(*verified: Column) -> Column:
    """Of three layers of verification."""
    return sum((F.when(v, w).otherwise(0.0) for v, w in zip(verified, (0.33, 0.33, 0.34), strict=True)), F.lit(0.0))


def patience(epochs: DataFrame, key: str, order: list[str], loss: str) -> DataFrame:
    """(key, patience): the most epochs in a row of a run without a new least loss."""
    w = Window.partitionBy(key).orderBy(*order)
    best = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = epochs.select(key, F.row_number().over(w).alias("epoch"), (best.isNull() | (F.col(loss) < best)).alias("better"))
    since = F.col("epoch") - F.max(F.when(F.col("better"), F.col("epoch"))).over(Window.partitionBy(key).orderBy("epoch"))
    return seen.select(key, since.alias("since")).groupBy(key).agg(F.max("since").alias("patience"))


def rises(rows: DataFrame, key: str, order: list[str], value: str, times: int = 2) -> DataFrame:
    """The rows that end `times` rises in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    values = [F.col(value), *[F.lag(value, i).over(w) for i in range(1, times + 1)]]
    return rows.withColumn("_up", reduce(Column.__and__, (a > b for a, b in zip(values, values[1:], strict=False)))).where("_up").drop("_up")
