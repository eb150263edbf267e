"""The corpus pipeline: five filters and a mix, each by an operator of riskloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
docs.  Documents with null texts pass as empty texts.  Rows that repeat an id are judged by id and
text in exact dedup, of which one stays, and by id in near dedup, where all stay if one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, saved, table
from riskloom.llm.decontamination import contamination
from riskloom.llm.exact_dedup import exact_groups, normalised
from riskloom.llm.mixing import mixture
from riskloom.llm.simhash import near_duplicates
from riskloom.llm.toxicity import toxicity

#: SQL that gives run()'s rows: none, as the models and hashes of the stages have no SQL form.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict toxic."""
    found = free_name(docs, "toxicity")
    out = toxicity(docs, table(spark, sf_dir, "labels"), found=found)
    return out.where(F.col(f"{found}.predicted") == 0).select(*_columns(docs))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the most code points, then the smallest id."""
    groups = exact_groups(docs)
    told = groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).where("rows > 1 or not stays")
    told = told.select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"), "stays")
    row, sha, stays, place = "row", "sha", "stays", "place"
    rows = docs.select(F.struct(*_columns(docs)).alias(row), F.sha2(normalised(F.col("text")), 256).alias(sha))
    rows = rows.join(told, F.col("row.doc_id").eqNullSafe(F.col("i")) & (F.col(sha) == F.col("s")), "left").where(F.coalesce(F.col(stays), F.lit(True)))
    # Only rows that repeat an id and text are told apart, so no window holds many rows.
    twice = Window.partitionBy("row.doc_id", sha).orderBy(F.length("row.text").desc_nulls_last(), F.xxhash64(row))
    once = rows.where(F.col(stays).isNull()).select("row.*")
    return once.unionAll(rows.where(F.col(stays)).withColumn(place, F.row_number().over(twice)).where(F.col(place) == 1).select("row.*"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of linked fingerprints."""
    keep = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("i")).distinct()
    rows = docs.select(F.struct(*_columns(docs)).alias("row"))
    return rows.join(keep, F.col("row.doc_id").eqNullSafe(F.col("i")), "left_semi").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = free_name(docs, "found")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), found=found)
    return out.where(~F.col(f"{found}.contaminated")).select(*_columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixture(docs)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
