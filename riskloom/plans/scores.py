"""Queries of the scores of a file's findings.  Counts of the tables stand in for a file's counts of flows, hits and nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import scores as S
from riskloom.plans.registry import register

KINDS = (*S.INJECTIONS, "weak_crypto", "insecure_randomness", "deserialization", "hardcoded_credentials", "csrf")
SQL_SIGNALS = f"""s AS (SELECT 'f' || o_custkey::VARCHAR AS file_id, [{', '.join(f"'{k}'" for k in KINDS)}][1 + (o_custkey % {len(KINDS)})::INT] AS vuln_type, count(*) FILTER (o_orderstatus = 'F') AS taint_flows,
    count(*) FILTER (o_orderstatus = 'O') AS sink_hits, count(*) FILTER (o_orderpriority = '1-URGENT') AS guard_hits, count(*) FILTER (o_orderpriority = '2-HIGH') AS sanitizer_hits, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS sanitized,
    count(*) FILTER (o_orderpriority = '5-LOW') AS input_hits, count(*) FILTER (o_orderstatus = 'P') AS reach_flows, o_custkey % 3 AS reach_sources, o_custkey % 2 AS reach_sinks,
    CASE o_custkey % 4 WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.9::DOUBLE END AS effectiveness, o_custkey % 3 AS framework_safe, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS framework_unsafe,
    o_custkey % 2 AS template_off, o_custkey % 7 AS template_on, CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS template_unsafe FROM orders GROUP BY o_custkey)"""


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark, sf_dir):
    k = F.col("o_custkey")
    n = lambda column, value: F.count_if(F.col(column) == value)
    rows = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        n("o_orderstatus", "F").alias("taint_flows"), n("o_orderstatus", "O").alias("sink_hits"), n("o_orderpriority", "1-URGENT").alias("guard_hits"), n("o_orderpriority", "2-HIGH").alias("sanitizer_hits"),
        n("o_orderpriority", "3-MEDIUM").alias("sanitized"), n("o_orderpriority", "5-LOW").alias("input_hits"), n("o_orderstatus", "P").alias("reach_flows"),
    )
    told = {
        "file_id": F.concat(F.lit("f"), k.cast("string")), "vuln_type": F.element_at(F.array(*map(F.lit, KINDS)), (1 + k % len(KINDS)).cast("int")), "reach_sources": k % 3, "reach_sinks": k % 2,
        "effectiveness": F.element_at(F.array(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.7), F.lit(0.9)), (1 + k % 4).cast("int")), "framework_safe": k % 3, "framework_unsafe": (k % 5 == 0).cast("int"),
        "template_off": k % 2, "template_on": k % 7, "template_unsafe": (k % 11 == 0).cast("int"),
    }
    return rows.withColumns(told).drop("o_custkey")


_GUARDED = "(sanitized > 0 OR sanitizer_hits > 0 OR guard_hits > 0)"
_OPEN = "(template_off > 0 OR template_unsafe > 0)"
_ITEMS = [
    ("reach_flows > 0", "'DIRECT_TAINT_PATH'", "CASE WHEN reach_sources = 0 OR reach_sinks = 0 THEN 0 WHEN reach_flows = 1 THEN 0.85 WHEN reach_flows <= 3 THEN 0.75 ELSE 0.65 END"),
    ("reach_flows > 1", "'MULTIPLE_PATHS'", "0.85"),
    ("taint_flows > 0", "CASE WHEN direct THEN 'DIRECT_TAINT_PATH' ELSE 'INDIRECT_TAINT_PATH' END", "0.7 + least(0.2, 0.05 * taint_flows)"),
    ("taint_flows > 1", "'MULTIPLE_PATHS'", "0.8"),
    ("sink_hits > 0", "'DANGEROUS_PATTERN'", "0.75"),
    ("framework_unsafe > 0", "'DANGEROUS_PATTERN'", "0.78"),
    ("framework_unsafe = 0 AND framework_safe > 0", "'WEAK_VALIDATION'", "0.35"),
    (f"vuln_type IN ('xss', 'el_injection') AND {_OPEN}", "'DANGEROUS_PATTERN'", "0.8"),
    (f"vuln_type IN ('xss', 'el_injection') AND NOT {_OPEN} AND template_on > 0", "'WEAK_VALIDATION'", "0.35"),
    (f"NOT {_GUARDED}", "'NO_SANITIZER'", "0.85"),
    ("guard_hits > 0 AND (effectiveness IS NULL OR effectiveness < 0.6)", "'INEFFECTIVE_SANITIZER'", "0.3"),
    ("guard_hits > 0 AND effectiveness >= 0.6 AND effectiveness < 0.85", "'WEAK_VALIDATION'", "0.45"),
    ("guard_hits = 0 AND (sanitizer_hits > 0 OR sanitized > 0)", "'WEAK_VALIDATION'", "0.4"),
    ("input_hits > 0 AND taint_flows > 0", "'DIRECT_TAINT_PATH'", "0.78"),
]


@register("e01_evidence_items", f"WITH {SQL_SIGNALS}, d AS (SELECT *, (taint_flows > 0 AND sink_hits > 0) OR reach_flows > 0 AS direct FROM s) " + " UNION ALL ".join(
    f"SELECT file_id, vuln_type, direct, {kind} AS evidence_type, round(({value})::DOUBLE, 9) AS confidence FROM d WHERE {when}" for when, kind, value in _ITEMS))
def evidence_items(spark, sf_dir):
    return S.evidence_items(signals(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@register("e08_taint_gating", f"""WITH {SQL_SIGNALS} SELECT file_id, vuln_type, CASE WHEN vuln_type IN ('weak_crypto', 'insecure_randomness', 'deserialization', 'hardcoded_credentials', 'csrf') THEN 'kept'
    WHEN reach_sinks > 0 AND reach_sources > 0 AND reach_flows = 0 AND taint_flows = 0 AND sink_hits = 0 AND input_hits = 0 THEN 'joern_unreachable' WHEN taint_flows = 0 THEN 'no_taint_flows' WHEN sink_hits = 0 THEN 'no_sink_evidence'
    WHEN {_GUARDED} AND taint_flows <= 1 AND sink_hits <= 1 AND input_hits = 0 THEN 'sanitization_evidence' ELSE 'kept' END AS verdict FROM s""")  # fmt: skip
def taint_gating(spark, sf_dir):
    return S.taint_verdict(signals(spark, sf_dir))


@register("e09_evidence_adjustment", f"""WITH {SQL_SIGNALS}, a AS (SELECT file_id, CASE vuln_type WHEN 'weak_crypto' THEN CASE WHEN sink_hits > 0 THEN 0.08 ELSE -0.04 END WHEN 'deserialization' THEN CASE WHEN sink_hits > 0 THEN 0.08 ELSE -0.03 END
    WHEN 'hardcoded_credentials' THEN CASE WHEN sink_hits > 0 THEN 0.05 ELSE -0.02 END WHEN 'insecure_randomness' THEN CASE WHEN sink_hits > 0 THEN 0.05 ELSE 0 END - CASE WHEN guard_hits > 0 THEN 0.05 ELSE 0 END
    WHEN 'csrf' THEN CASE WHEN taint_flows > 0 THEN 0.03 ELSE 0 END ELSE
      CASE WHEN taint_flows > 0 THEN 0.08 ELSE 0 END + CASE WHEN input_hits > 0 THEN 0.05 ELSE 0 END + CASE WHEN sink_hits > 0 THEN 0.05 ELSE 0 END + CASE WHEN framework_unsafe > 0 THEN 0.04 WHEN framework_safe > 0 THEN -0.03 ELSE 0 END
      + CASE WHEN vuln_type = 'xss' AND {_OPEN} THEN 0.04 ELSE 0 END - CASE WHEN vuln_type = 'xss' AND template_on > 0 AND template_unsafe = 0 THEN 0.03 ELSE 0 END
      - CASE WHEN {_GUARDED} THEN least(0.08, 0.02 * greatest(sanitized, 1)) + CASE WHEN guard_hits > 0 THEN least(0.06, 0.02 * guard_hits) ELSE 0 END ELSE 0 END END::DOUBLE AS x FROM s)
    SELECT file_id, round(greatest(-0.15, least(0.15, avg(x))) + 1e-10, 8)::DOUBLE AS adjustment FROM a GROUP BY file_id""")  # fmt: skip
def evidence_adjustment(spark, sf_dir):
    return S.evidence_adjustment(signals(spark, sf_dir)).withColumn("adjustment", F.round(F.col("adjustment") + 1e-10, 8))


def _orders(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("nodes"), F.count_if(F.col("l_returnflag") == "R").alias("findings"), F.count_distinct("l_suppkey").alias("methods"), F.sum("l_linenumber").alias("calls"))


SQL_FILES = "f AS (SELECT l_orderkey AS id, count(*) AS nodes, count(*) FILTER (l_returnflag = 'R') AS findings, count(DISTINCT l_suppkey) AS methods, sum(l_linenumber) AS calls FROM lineitem GROUP BY 1)"


@register("e10_traditional_confidence", f"WITH {SQL_FILES} SELECT id, round(greatest(0, least(1, 0.5 + least(nodes / 100, 0.3) + 0.2 * findings + CASE WHEN id % 2 = 0 THEN 0.1 ELSE 0 END - 0.05)), 9)::DOUBLE AS confidence FROM f")
def traditional_confidence(spark, sf_dir):
    f = _orders(spark, sf_dir)
    return f.select("id", F.round(S.traditional_confidence(F.col("nodes"), F.col("findings"), F.col("id") % 2 == 0, F.lit(-0.05)), 9).alias("confidence"))


@register("e11_uncertainty_mean", f"WITH {SQL_FILES} SELECT id, round(1 / (1 + exp(0::DOUBLE - (0.5::DOUBLE + least(nodes / 200, 0.3) + least(methods / 20, 0.2) + least(calls / 30, 0.15) + 0.15 * findings))), 9) AS mean FROM f")
def uncertainty_mean(spark, sf_dir):
    return _orders(spark, sf_dir).select("id", F.round(S.noise_free_mean(F.col("nodes"), F.col("methods"), F.col("calls"), F.col("findings")), 9).alias("mean"))


@register("e12_uncertainty_bands", f"""WITH {SQL_FILES}, u AS (SELECT id, ([0.05, 0.1, 0.15]::DOUBLE[])[1 + (nodes * 100 > 200)::INT + (nodes * 100 > 500)::INT] + ([0.2, 0.05, 0.1]::DOUBLE[])[1 + (findings > 0)::INT + (findings > 5)::INT] AS u FROM f)
    SELECT id, round(u, 9) AS uncertainty, ['low', 'medium', 'high', 'very_high'][1 + (round(u, 9) >= 0.1)::INT + (round(u, 9) >= 0.25)::INT + (round(u, 9) >= 0.4)::INT] AS band FROM u""")  # fmt: skip
def uncertainty_bands(spark, sf_dir):
    u, band = S.uncertainty(F.col("nodes") * 100, F.col("findings"))
    return _orders(spark, sf_dir).select("id", F.round(u, 9).alias("uncertainty"), band.alias("band"))


@register("e13_routing", "SELECT route, count(*) AS n FROM (SELECT CASE WHEN value / 100 <= 0.3 THEN CASE WHEN event_type IN ('error', 'view') THEN 'automated' ELSE 'expert' END ELSE 'secondary_pass' END AS route FROM events) GROUP BY route")
def routing(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy(S.route(F.col("value") / 100, F.col("event_type").isin("error", "view")).alias("route")).agg(F.count("*").alias("n"))


@register("e14_heuristic_blend", "SELECT event_id, round(value / 100 - 0.3 * (value / 100 - 0.4), 9) AS confidence FROM events")
def heuristic_blend(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.round(S.blended(F.col("value") / 100, F.lit(0.4)), 9).alias("confidence"))


@register("e20_adaptive_weights", "SELECT user_id, CASE WHEN good * 10 > n * 8 THEN 1.1::DOUBLE WHEN good * 10 < n * 6 THEN 0.9::DOUBLE ELSE 1::DOUBLE END AS factor FROM (SELECT user_id, count(*) FILTER (value > 30) AS good, count(*) AS n FROM events GROUP BY user_id)")
def adaptive_weights(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("value") > 30).cast("double")).alias("accuracy"))
    return rows.select("user_id", S.adaptive_factor(F.round("accuracy", 12)).alias("factor"))


@register("e22_meta_ensemble", """SELECT user_id AS item, round(avg(value / 100) + 1e-10, 8) AS prediction, round(avg(CASE WHEN event_id % 3 = 0 THEN 0.9 ELSE 1 - value / 200 END) + 1e-10, 8)::DOUBLE AS confidence
    FROM events WHERE event_type IN ('view', 'error', 'purchase', 'signup') GROUP BY user_id""")  # fmt: skip
def meta_ensemble(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    method = F.when(F.col("event_type") == "click", "stacking").otherwise(F.col("event_type"))
    votes = e.select(F.col("user_id").alias("item"), (F.col("value") / 100).alias("prediction"), F.when(F.col("event_id") % 3 == 0, 0.9).alias("confidence"), (F.col("value") / 200).alias("uncertainty"), method.alias("method"))
    return S.meta_ensemble(votes).select("item", *[F.round(F.col(c) + 1e-10, 8).alias(c) for c in ("prediction", "confidence")])


@register("e23_multi_scale_combine", """SELECT p_partkey AS id, round(0.4 * f + 0.3 * g + 0.3 * h, 9)::DOUBLE AS weighted, CASE WHEN f >= g AND f >= h THEN 'function' WHEN g >= h THEN 'file' ELSE 'project' END AS best,
    round((exp(f) * f + exp(g) * g + exp(h) * h) / (exp(f) + exp(g) + exp(h)), 9) AS attention, greatest(f, g, h) > 0.5 AS flagged
    FROM (SELECT p_partkey, ((p_partkey % 11) / 10)::DOUBLE AS f, ((p_size % 7) / 10)::DOUBLE AS g, ((p_partkey % 5) / 10)::DOUBLE AS h FROM part)""")  # fmt: skip
def multi_scale(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    scales = [(name, (F.col(c) % m / 10)) for name, c, m in (("function", "p_partkey", 11), ("file", "p_size", 7), ("project", "p_partkey", 5))]
    rows = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), x.cast("double").alias("score"), (x > 0.5).alias("flag")) for n, x in scales])).alias("s")).select("id", "s.*")
    out = S.multi_scale(rows, {"function": 0.4, "file": 0.3, "project": 0.3})
    return out.withColumns({c: F.round(c, 9) for c in ("weighted", "attention")})


@register("e27_impact_score", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 0::DOUBLE ELSE round_even((0.7::DOUBLE * greatest(0.1::DOUBLE, 1 - p_size::DOUBLE * 25 / 1000) + 0.3::DOUBLE * least(1::DOUBLE, (p_partkey % 13) / 10::DOUBLE + 0.001)) * 10, 1) END AS score FROM part")
def impact_score(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.impact(F.col("p_size") * 25, (F.col("p_partkey") % 13) / 10 + 0.001, F.col("p_size") % 3 != 0).alias("score"))


@register("e28_adaptive_threshold", "SELECT user_id, round((0.7 - CASE WHEN 20 * a < n THEN 0.05 ELSE 0 END + CASE WHEN 10 * b < n THEN 0.05 ELSE 0 END)::DOUBLE, 9) AS threshold FROM (SELECT user_id, count(*) AS n, count(*) FILTER (value > 95) AS a, count(*) FILTER (value < 8) AS b FROM events GROUP BY user_id)")
def adaptive_threshold(spark, sf_dir):
    rate = lambda c: F.round(F.avg(c.cast("double")), 12)
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(rate(F.col("value") > 95).alias("fp"), rate(F.col("value") < 8).alias("fn"))
    return rows.select("user_id", F.round(S.adapted_threshold(F.lit(0.7), F.col("fp"), F.col("fn")), 9).alias("threshold"))


@register("e30_method_consolidation", """SELECT l_orderkey AS id, count(*) AS n_methods, round(avg(l_discount * 10) + 1e-10, 8) AS mean, ['critical', 'high', 'medium', 'low'][min(CASE WHEN l_discount > 0.085 THEN 1 WHEN l_discount > 0.065 THEN 2 WHEN l_discount > 0.035 THEN 3 ELSE 4 END)] AS severity
    FROM lineitem WHERE l_tax > 0.025 GROUP BY l_orderkey""")  # fmt: skip
def method_consolidation(spark, sf_dir):
    d = F.col("l_discount")
    severity = F.when(d > 0.085, "critical").when(d > 0.065, "high").when(d > 0.035, "medium").otherwise("low")
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_tax") > 0.025).alias("detected"), (d * 10).alias("confidence"), severity.alias("severity"))
    return S.consolidated(rows).withColumn("mean", F.round(F.col("mean") + 1e-10, 8))


@register("e31_counterfactual_importance", """WITH n AS (SELECT p_partkey AS id, (p_size % 10) / 20 + CASE WHEN starts_with(p_type, 'ECONOMY') THEN 0.3 ELSE 0 END AS score FROM part), e AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS b FROM lineitem)
    SELECT e.a AS source, e.b AS target, round(0.6 + (x.score + y.score) / 2, 9)::DOUBLE AS score FROM e JOIN n x ON x.id = e.a JOIN n y ON y.id = e.b ORDER BY 3 DESC, 1, 2 LIMIT 5""")  # fmt: skip
def counterfactual_importance(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    n = p.count()
    nodes = p.select(F.col("p_partkey").alias("id"), ((F.col("p_size") % 10) / 20 + F.when(F.col("p_type").startswith("ECONOMY"), 0.3).otherwise(0.0)).alias("score"))
    edges = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).alias("target")).distinct()
    return S.edge_importance(nodes.withColumn("score", F.round("score", 9)), edges).withColumn("score", F.round("score", 9))


@register("x03_cluster_confidence", "SELECT vec_id, round(1 / (1 + exp(2.5 - 3 * exp((vec_id % 10) / (-10::DOUBLE)) - 2 * exp((vec_id % 7) / (-10::DOUBLE)))), 9) AS confidence FROM embeddings")
def cluster_confidence(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.cluster_confidence((F.col("vec_id") % 10) / 10, (F.col("vec_id") % 7) / 10), 9).alias("confidence"))


@register("x16_patch_confidence", "SELECT p_partkey, round((33 * (p_size % 2 = 0)::INT + 33 * (p_size % 3 = 0)::INT + 34 * (p_size % 5 = 0)::INT) / 100::DOUBLE, 9) AS confidence FROM part")
def patch_confidence(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(S.patch_confidence(*[F.col("p_size") % i == 0 for i in (2, 3, 5)]), 9).alias("confidence"))


@register("n08_early_stopping", """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), m AS (SELECT a.user_id, a.rn, a.value < coalesce(min(a.value) OVER (PARTITION BY a.user_id ORDER BY a.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS better FROM e a),
    g AS (SELECT user_id, rn, sum(better::INT) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM m) SELECT user_id, max(n) - 1 AS patience FROM (SELECT user_id, run, count(*) AS n FROM g GROUP BY user_id, run) GROUP BY user_id""")  # fmt: skip
def early_stopping(spark, sf_dir):
    return S.patience(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").withColumn("patience", F.col("patience").cast("long"))


@register("n05_three_increases", "SELECT c.user_id, c.event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) c JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) b ON b.user_id = c.user_id AND b.rn = c.rn - 1 JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) a ON a.user_id = c.user_id AND a.rn = c.rn - 2 WHERE a.value < b.value AND b.value < c.value")
def three_increases(spark, sf_dir):
    return S.rises(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id")
