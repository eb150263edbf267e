"""Queries of the detector bank."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.rules import SQL_SUBJECTS, matches, quoted, subjects
from riskloom.operators import detectors as D
from riskloom.plans.registry import register
from riskloom.sources.snippets import SQL_SOURCES, sources

_LEAK_SQL = (
    "SELECT *, list_distinct(flatten([" + ", ".join(f"regexp_extract_all(code, {quoted(rf'\b{t}\s+(\w+)\s*=\s*new\s+{t}')}, 1)" for t in D.RESOURCES)
    + rf", CASE WHEN contains(code, 'DriverManager.getConnection') THEN regexp_extract_all(code, 'Connection\s+(\w+)\s*=', 1) ELSE [] END])) AS names FROM sources"
)
_LEAK = (
    "((len(names) > 0 OR contains(code, 'DriverManager.getConnection')) AND NOT (contains(code, 'try (') OR contains(code, 'try(')) AND "
    "(NOT (contains(code, 'finally') AND contains(code, '.close()')) OR len(list_filter(names, lambda n: NOT contains(code, n || '.close()'))) > 0))"
)


def _one(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    src = sources(spark, sf_dir)
    rule = dict(D.BANK).get(name)
    hit = rule.column(subjects(F.col("code"))) if rule else D.resource_leak(F.col("code"))
    return src.select("file_id", hit.alias("hit"))


for _i, (_name, _rule) in enumerate(D.BANK, 1):
    register(f"p{_i:02d}_{_name}", f"WITH {SQL_SOURCES} SELECT file_id, {_rule.sql(SQL_SUBJECTS)} AS hit FROM sources")(partial(_one, name=_name))
register("p25_resource_leak", f"WITH {SQL_SOURCES}, n AS ({_LEAK_SQL}) SELECT file_id, {_LEAK} AS hit FROM n")(partial(_one, name=D.LEAK))

_ALL = " UNION ALL ".join(f"SELECT file_id, {i} AS pos, {quoted(D.REPORTED.get(n, n))} AS vuln_type FROM n WHERE {r.sql(SQL_SUBJECTS)}" for i, (n, r) in enumerate(D.BANK))


@register("p00_detector_bank", f"WITH {SQL_SOURCES}, n AS ({_LEAK_SQL}) {_ALL} UNION ALL SELECT file_id, {len(D.BANK)} AS pos, '{D.LEAK}' AS vuln_type FROM n WHERE {_LEAK}")
def detector_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.findings(sources(spark, sf_dir))


_QUICK = {n: matches(*p, ignore_case=True) for n, p in D.QUICK.items()}


@register(
    "p26_quick_scan",
    f"WITH {SQL_SOURCES}, h AS (SELECT file_id, " + ", ".join(f"{r.sql(SQL_SUBJECTS)} AS {n}" for n, r in _QUICK.items()) + " FROM sources) SELECT *, round(least(1.0::DOUBLE, 0.3::DOUBLE * ("
    + " + ".join(f"{n}::INT" for n in _QUICK) + ")), 9) AS confidence FROM h",
)
def quick_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = subjects(F.col("code"))
    flags = sources(spark, sf_dir).select("file_id", *[r.column(by).alias(n) for n, r in _QUICK.items()])
    total = sum((F.col(n).cast("int") for n in _QUICK), F.lit(0))
    return flags.withColumn("confidence", F.round(F.least(F.lit(1.0), F.lit(0.3) * total), 9))


@register(
    "p28_exploitability",
    f"WITH {SQL_SOURCES}, c AS (SELECT file_id, " + " + ".join(f"{r.sql(SQL_SUBJECTS)}::INT" for r in _QUICK.values())
    + " AS n FROM sources) SELECT file_id, n, CASE WHEN n = 0 THEN 0.1::DOUBLE ELSE least(round(0.3 + 0.1 * n, 9)::DOUBLE, 0.9::DOUBLE) END AS score, CASE WHEN n = 0 THEN 0.3::DOUBLE ELSE least(round(0.4 + 0.1 * n, 9)::DOUBLE, 0.7::DOUBLE) END AS confidence FROM c",
)
def exploitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = subjects(F.col("code"))
    n = sum((r.column(by).cast("int") for r in _QUICK.values()), F.lit(0))
    out = sources(spark, sf_dir).select("file_id", n.alias("n"))
    return out.select(
        "file_id", "n",
        F.when(F.col("n") == 0, 0.1).otherwise(F.least(F.round(0.3 + 0.1 * F.col("n"), 9), F.lit(0.9))).alias("score"),
        F.when(F.col("n") == 0, 0.3).otherwise(F.least(F.round(0.4 + 0.1 * F.col("n"), 9), F.lit(0.7))).alias("confidence"),
    )


@register(
    "a24_findings_summary",
    f"WITH {SQL_SOURCES}, n AS ({_LEAK_SQL}), f AS ({_ALL} UNION ALL SELECT file_id, {len(D.BANK)}, '{D.LEAK}' FROM n WHERE {_LEAK}) SELECT vuln_type, count(*) AS n_findings, count(DISTINCT file_id) AS n_files FROM f GROUP BY vuln_type",
)
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.findings(sources(spark, sf_dir)).groupBy("vuln_type").agg(F.count("*").alias("n_findings"), F.countDistinct("file_id").alias("n_files"))
