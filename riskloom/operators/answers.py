"""Questions about a graph, answered from an index: why a node is reached, by which path, and why it isn't.

The index is made once, by frontier rounds: of each source and each node that it reaches the shortest path, of equal ones the
first in the order of names.  It is written by bucket of the node, so that an answer reads the files of one bucket instead of
running a closure.  Nodes that nothing reaches are in it too, without a source.

`functions` makes the questions table functions of SQL: `SELECT * FROM why('node')`, `why_not('node')` and `path('source', 'node')`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.graph import cut

BUCKETS = 64
SCHEMA = "node string, source string, hops int, path array<string>, bucket int"


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def shortest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, hops, path) of all nodes that sources(source) reach over edges(source, target), themselves included."""
    step = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    known = new = cut(sources.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0).alias("hops"), F.array("source").alias("path")))
    while True:
        new = new.join(step, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("to")).agg(F.min(F.struct(F.concat("path", F.array("b")).alias("path"), (F.col("hops") + 1).alias("hops"))).alias("best"))
        new = new.select("source", F.col("to").alias("node"), "best.hops", "best.path")
        new = cut(new.join(known, ["source", "node"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionAll(new)


def write_index(edges: DataFrame, sources: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes the index of all nodes of edges and sources below folder."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).union(sources.select("source")).distinct()
    rows = nodes.join(shortest(edges, sources), "node", "left").withColumn("bucket", _bucket(F.col("node"), buckets))
    rows.select("node", "source", "hops", "path", "bucket").repartition("bucket").sortWithinPartitions("bucket", "node").write.partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def why(index: DataFrame, node: str, buckets: int = BUCKETS) -> DataFrame:
    """(source, hops, path): what reaches the node, from the files of its bucket alone."""
    return index.where((F.col("bucket") == _bucket(F.lit(node), buckets)) & (F.col("node") == node) & F.col("source").isNotNull()).select("source", "hops", "path")


def functions(spark: SparkSession, folder: str, buckets: int = BUCKETS, view: str = "reached") -> None:
    """Registers why, why_not and path for the session, over the index in folder."""
    read_index(spark, folder).createOrReplaceTempView(view)
    mine = f"{view}.bucket = CAST(pmod(xxhash64({{0}}), {buckets}) AS INT) AND {view}.node = {{0}}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION why(asked STRING) RETURNS TABLE(source STRING, hops INT, path ARRAY<STRING>) RETURN SELECT {view}.source, {view}.hops, {view}.path FROM {view} WHERE {mine.format('asked')} AND {view}.source IS NOT NULL")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION path(first STRING, asked STRING) RETURNS TABLE(place INT, node STRING) RETURN SELECT p.pos AS place, p.col AS node FROM {view} LATERAL VIEW posexplode({view}.path) p AS pos, col WHERE {mine.format('asked')} AND {view}.source = first")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION why_not(asked STRING) RETURNS TABLE(reason STRING) RETURN SELECT CASE WHEN count(*) = 0 THEN 'target_not_in_graph' WHEN count({view}.source) = 0 THEN 'no_path_from_sources' ELSE 'reached' END FROM {view} WHERE {mine.format('asked')}"
    )
