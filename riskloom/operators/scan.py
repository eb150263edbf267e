"""One scan from source files to judged findings, in the order in which each step needs the one before.

Detector bank over all files -> of the files with findings: taint facts, syntax-tree counts, framework sinks, template engines,
sanitizers and markers -> signals of each finding -> evidence items -> the gate of the finding's sink, or the taint rule where
there is none -> the file's confidence, blended and, where a model's prediction is given, fused with it -> rows for reports.

The bank is one projection; what is behind it reads the files with findings only, and joins by file and kind.  Rows that
repeat a file's id count as one file.  A file without text has no findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import detectors, evidence, lines, scanners, scores, syntax, taint
from riskloom.operators.graph import cut

#: The sink that gates each kind of finding.
SINK_OF = {
    "sql_injection": "SQL_QUERY", "xss": "HTML_OUTPUT", "command_injection": "COMMAND_EXEC", "path_traversal": "PATH_TRAVERSAL", "url_redirect": "URL_REDIRECT", "file_operation": "FILE_OPERATION",
    "xpath_injection": "XPATH_QUERY", "ldap_injection": "LDAP_QUERY", "xxe": "XXE", "http_response_splitting": "HTTP_RESPONSE_SPLITTING", "el_injection": "EL_INJECTION",
}
#: The kinds of findings that a sanitizer guards.
GUARDED_BY = {
    "HTML Entity Escaping": "xss", "HTML Sanitization (Allowlist)": "xss", "URL Encoding": "http_response_splitting", "SQL Parameterization": "sql_injection", "Path Normalization": "path_traversal",
    "LDAP Escaping": "ldap_injection", "XXE Hardening": "xxe", "Command Argument List": "command_injection",
}


def _map(values: dict):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def signals(files: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """The signals table of scores for found(file_id, vuln_type), from files(file_id, code) and their taint facts."""
    flows = taint.assembled(facts).select("file_id", F.col("n_flows").alias("taint_flows"), F.col("n_sanitized").alias("sanitized"))
    out = scanners.signals(files, found, flows).drop("effectiveness", "framework_safe", "framework_unsafe", "template_off", "template_on", "template_unsafe")
    each = lines.numbered_lines(files)
    sinks = lines.framework_sinks(each).groupBy("file_id", "vuln_type").agg(F.count_if("is_safe").cast("int").alias("framework_safe"), F.count_if(~F.col("is_safe")).cast("int").alias("framework_unsafe"))
    guards = lines.sanitizers(each).select("file_id", _map(GUARDED_BY)[F.col("sanitizer")].alias("vuln_type"), "effectiveness").groupBy("file_id", "vuln_type").agg(F.max("effectiveness").alias("effectiveness"))
    engines = scanners.template_engines(files).groupBy("file_id").agg(
        F.count_if(F.col("mode") == "disabled").cast("int").alias("template_off"), F.count_if(F.col("mode") == "enabled").cast("int").alias("template_on"), F.sum("unsafe").cast("int").alias("template_unsafe")
    )
    out = out.join(sinks, ["file_id", "vuln_type"], "left").join(guards, ["file_id", "vuln_type"], "left").join(engines, "file_id", "left")
    return out.fillna(0, ["framework_safe", "framework_unsafe", "template_off", "template_on", "template_unsafe"])


def judged(told: DataFrame) -> DataFrame:
    """(file_id, vuln_type, gate, passed, verdict) of signals: a sink's gate judges where there is one, else the taint rule.

    gate: the gate's confidence, null without one.
    """
    items = scores.evidence_items(told).withColumn("sink", _map(SINK_OF)[F.col("vuln_type")]).where("sink is not null")
    gates = evidence.gated(items, "file_id", "vuln_type").select("file_id", "vuln_type", F.col("confidence").alias("gate"), "passed")
    out = scores.taint_verdict(told).join(gates, ["file_id", "vuln_type"], "left")
    verdict = F.when(F.col("passed").isNull(), F.col("verdict")).when(F.col("passed"), "kept").otherwise("gate")
    return out.select("file_id", "vuln_type", "gate", (verdict == "kept").alias("passed"), verdict.alias("verdict"))


def confidences(told: DataFrame, kept: DataFrame, nodes: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(file_id, heuristic, confidence, how): of each file in told, with kept(file_id, vuln_type) its findings that passed.

    model: (file_id, vuln, safe, ood) of a classifier; None, or no row, leaves the heuristic.
    """
    n = lambda kind: F.count_if(F.col("kind") == kind)
    size = nodes.groupBy("file_id").agg(F.count("*").alias("nodes"), n("method").alias("methods"), n("call").alias("calls"))
    found = kept.groupBy("file_id").agg(F.count("*").alias("n"))
    out = scores.evidence_adjustment(told).join(size, "file_id", "left").join(found, "file_id", "left").fillna(0, ["nodes", "methods", "calls", "n"])
    c = F.col
    heuristic = scores.blended(scores.noise_free_mean(c("nodes"), c("methods"), c("calls"), c("n")), scores.traditional_confidence(c("nodes"), c("n"), c("nodes") > 0, c("adjustment")))
    out = out.withColumn("heuristic", F.when(c("n") > 0, heuristic).otherwise(0.0))
    if model is None:
        return out.select("file_id", "heuristic", F.col("heuristic").alias("confidence"), F.lit("heuristic_only").alias("how"))
    both = out.join(model.select("file_id", "vuln", "safe", "ood"), "file_id", "left")
    combined, how = evidence.fused(c("heuristic"), c("vuln"), c("safe"), F.coalesce("ood", F.lit(False)))
    return both.select("file_id", "heuristic", combined.alias("confidence"), how.alias("how"))


def scan(files: DataFrame, model: DataFrame | None = None, id_: str = "file_id", code: str = "code") -> DataFrame:
    """(file_id, vuln_type, gate, passed, verdict, confidence, how, level) of every finding in files; confidence: of the file, 0 where nothing passed.

    level: that of a report, error from a confidence of 0.7, warning below, note for what didn't pass.
    """
    rows = files.select(F.col(id_).cast("string").alias("file_id"), F.col(code).alias("code"))
    found = cut(detectors.findings(rows).select("file_id", "vuln_type").distinct())
    flagged = cut(rows.join(found.select("file_id").distinct(), "file_id", "left_semi").dropDuplicates(["file_id"]))
    told = cut(signals(flagged, found, taint.facts(flagged)))
    verdicts = cut(judged(told))
    sure = confidences(told, verdicts.where("passed"), syntax.tree(flagged), model)
    out = verdicts.join(sure.select("file_id", "confidence", "how"), "file_id")
    level = F.when(~F.col("passed"), "note").when(F.col("confidence") >= 0.7, "error").otherwise("warning")
    return out.select("file_id", "vuln_type", "gate", "passed", "verdict", F.round("confidence", 6).alias("confidence"), "how", level.alias("level"))
