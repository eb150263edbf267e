"""Evidence algebra: weighted evidence, sink gates, fusion of a heuristic with a model, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Evidence weights, and of each sink its thresholds, required evidence, least count and penalty.
WEIGHTS = {
    "DIRECT_TAINT_PATH": 0.25, "INDIRECT_TAINT_PATH": 0.15, "NO_SANITIZER": 0.20, "INEFFECTIVE_SANITIZER": 0.15, "DANGEROUS_PATTERN": 0.15, "WEAK_VALIDATION": 0.10,
    "MULTIPLE_PATHS": 0.10,
}
GATES = [
    ("SQL_QUERY", 0.65, 0.80, ["DIRECT_TAINT_PATH", "NO_SANITIZER"], 2, 0.20),
    ("HTML_OUTPUT", 0.60, 0.75, ["DIRECT_TAINT_PATH", "NO_SANITIZER"], 2, 0.18),
    ("COMMAND_EXEC", 0.70, 0.85, ["DIRECT_TAINT_PATH", "NO_SANITIZER"], 2, 0.25),
    ("PATH_TRAVERSAL", 0.62, 0.78, ["DIRECT_TAINT_PATH", "DANGEROUS_PATTERN"], 2, 0.17),
    ("URL_REDIRECT", 0.55, 0.70, ["DIRECT_TAINT_PATH"], 1, 0.15),
    ("FILE_OPERATION", 0.50, 0.68, ["DIRECT_TAINT_PATH"], 1, 0.12),
    ("XPATH_QUERY", 0.60, 0.75, ["DIRECT_TAINT_PATH", "NO_SANITIZER"], 2, 0.16),
    ("LDAP_QUERY", 0.60, 0.75, ["DIRECT_TAINT_PATH", "NO_SANITIZER"], 2, 0.16),
    ("XXE", 0.60, 0.75, ["DIRECT_TAINT_PATH", "NO_SANITIZER"], 2, 0.16),
    ("HTTP_RESPONSE_SPLITTING", 0.60, 0.75, ["DIRECT_TAINT_PATH", "NO_SANITIZER"], 2, 0.16),
    ("EL_INJECTION", 0.68, 0.82, ["DIRECT_TAINT_PATH", "NO_SANITIZER", "DANGEROUS_PATTERN"], 2, 0.20),
]
DIRECT, INDIRECT, MANY_PATHS, DANGEROUS, WEAK = 1.05, 0.95, 1.10, 1.08, 0.85
STRONG, MODERATE, FAINT, DELTA, BOOST, UNDER, OVER, LEAST_BOOST = 0.70, 0.40, 0.20, 0.15, 0.30, 0.55, 0.95, 0.85


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _nine(x: Column) -> Column:
    """x to nine places: a half of the last place is judged after scaling."""
    return F.round(x * 1e9) / 1e9


def gate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GATES, "sink string, direct_at double, indirect_at double, required array<string>, least int, fp_penalty double")


def exact_sum(x: Column) -> Column:
    """The sum of x, the same in any order of the rows: exact to 15 places, where no value is out of that form's range."""
    fits = F.abs(x) < 1e12  # not so for NaN, which counts as greatest
    whole = F.sum(F.when(fits, F.when(fits, x).cast("decimal(28,15)")))
    return F.when(F.bool_and(F.coalesce(fits, F.lit(True))), whole.cast("double")).otherwise(F.sum(x))


def gated(evidence: DataFrame, *by: str) -> DataFrame:
    """evidence(*by, sink, direct, evidence_type, confidence) -> one row for each *by, sink, direct:
    n, weighted, confidence and passed.  An unknown sink has confidence 0.5 and doesn't pass; too little
    evidence or a missing required type gives 0."""
    spark = evidence.sparkSession
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("evidence_type"))
    e = evidence.withColumn("w", weight)
    out = e.groupBy(*by, "sink", "direct").agg(F.count("*").alias("n"), (exact_sum(F.col("w") * F.col("confidence")) / exact_sum(F.col("w"))).alias("raw"), F.collect_set("evidence_type").alias("types"))
    out = out.join(F.broadcast(gate_table(spark)), "sink", "left")  # one row for each sink
    met = (F.col("n") >= F.col("least")) & (F.size(F.array_except("required", "types")) == 0)
    flow = clamp(F.col("raw") * F.when(F.col("direct"), DIRECT).otherwise(INDIRECT))
    adjusted = flow * F.when(F.array_contains("types", "MULTIPLE_PATHS"), MANY_PATHS).otherwise(1.0) * F.when(F.array_contains("types", "DANGEROUS_PATTERN"), DANGEROUS).otherwise(1.0)
    weak = F.array_contains("types", "WEAK_VALIDATION") | F.array_contains("types", "INEFFECTIVE_SANITIZER")
    adjusted = clamp(F.when(weak, adjusted * WEAK - F.col("fp_penalty")).otherwise(adjusted))
    confidence = F.when(F.col("required").isNull(), 0.5).when(~met, 0.0).otherwise(adjusted)
    passed = F.col("required").isNotNull() & met & (confidence >= F.when(F.col("direct"), F.col("direct_at")).otherwise(F.col("indirect_at")))
    return out.select(*by, "sink", "direct", "n", _nine(F.col("raw")).alias("weighted"), _nine(confidence).alias("confidence"), F.coalesce(passed, F.lit(False)).alias("passed"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def fused(heuristic: Column, vuln: Column, safe: Column, ood: Column) -> tuple[Column, Column]:
    """(combined, how): a model can raise a heuristic's confidence, never lower it.  ood: out of distribution."""
    h, v0 = clamp(heuristic), clamp(vuln)
    s0 = F.when((clamp(safe) <= 0) & v0.between(0, 1), 1 - v0).otherwise(clamp(safe))
    v = F.when(s0 + v0 > 0, v0 / (s0 + v0)).otherwise(v0)
    agrees = (F.abs(v - h) <= DELTA + 1e-12) & (v >= h)
    raised = (v > h) & (v >= UNDER)
    boosted = F.greatest(h, F.least(F.lit(0.95), h + BOOST * (F.when(v > OVER, 0.80).otherwise(v) - h)))
    calibrated = F.greatest(h, F.when(v > OVER, 0.70 * h + 0.30 * 0.85).otherwise(0.60 * h + 0.40 * v))
    cases = [
        (~finite(heuristic), F.lit(0.5), "error_nan_heuristic"), (~(finite(vuln) & finite(safe)), h, "heuristic_only_nan_gnn"), (ood, F.greatest(h, F.lit(0.60)), "heuristic_only_ood"),
        ((h >= STRONG) & agrees, F.least(F.lit(1.0), h + BOOST * (v - h)), "gnn_boost"), (h >= STRONG, h, "heuristic_only"), ((h >= MODERATE) & raised, boosted, "gnn_boost"),
        (h >= MODERATE, h, "heuristic_only"), ((h >= FAINT) & (v >= LEAST_BOOST), calibrated, "gnn_calibrated"), (h >= FAINT, h, "heuristic_only"),
        (v >= LEAST_BOOST, F.greatest(F.lit(0.50), 0.70 * v), "gnn_only"),
    ]
    combined, how = None, None
    for when, value, name in cases:
        combined = F.when(when, value) if combined is None else combined.when(when, value)
        how = F.when(when, name) if how is None else how.when(when, name)
    return combined.otherwise(h), how.otherwise("heuristic_only")


def temperature_scaled(p: Column, t: float, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return 1 / (1 + F.exp(-F.ln(q / (1 - q)) / t))
