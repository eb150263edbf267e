"""Rule-bank queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.registry import register

#: Fixed: names of secrets assigned a literal.
CREDENTIAL = r"""(?i)(password|passwd|api[_-]?key|secret|token)\s*=\s*["']"""


@register(
    "credential_findings_by_language",
    rf"""SELECT lang, count(*) AS n_docs, count(*) FILTER (regexp_matches(text, '{CREDENTIAL.replace("'", "''")}')) AS n_hits,
    round(count(*) FILTER (regexp_matches(text, '{CREDENTIAL.replace("'", "''")}'))::DOUBLE / count(*), 9) AS share
    FROM documents GROUP BY lang""",
)
def credential_findings_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.col("text").rlike(CREDENTIAL)
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(hit).alias("n_hits")).withColumn("share", F.round(F.col("n_hits") / F.col("n_docs"), 9))
