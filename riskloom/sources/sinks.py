"""Report formats as columns over findings(file_id, vuln_type, confidence): SARIF, JUnit, JSON, event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sarif_result() -> Column:
    """One SARIF 2.1.0 result: an error from a confidence of 0.7."""
    return F.to_json(F.struct(
        F.upper("vuln_type").alias("ruleId"), F.when(F.col("confidence") >= 0.7, "error").otherwise("warning").alias("level"),
        F.struct(F.concat(F.col("vuln_type"), F.lit(" in "), F.col("file_id")).alias("text")).alias("message"),
    ))


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def junit_case(found: Column) -> Column:
    """One test case for a file, failed if something was found."""
    name = escaped(F.col("file_id"))
    return F.when(found > 0, F.format_string('<testcase name="%s"><failure message="%d findings"/></testcase>', name, found)).otherwise(F.format_string('<testcase name="%s"/>', name))


def event(findings: DataFrame) -> DataFrame:
    """Flat security events with a magnitude by severity."""
    c = F.col("confidence")
    severity = F.when(c >= 0.9, "critical").when(c >= 0.7, "high").when(c >= 0.5, "medium").otherwise("low")
    out = findings.select("file_id", "vuln_type", "confidence", severity.alias("severity"))
    return out.withColumn("magnitude", F.when(severity == "critical", 10).when(severity == "high", 8).when(severity == "medium", 6).otherwise(4))
