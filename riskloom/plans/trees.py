"""Queries that write a form of the tables to the shared folder and read it back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.plans.registry import register
from riskloom.plans.scores import _table
from riskloom.sources import files, shared


@register("s01_directory_scan", "SELECT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, count(*) AS n_lines, sum(length(doc_id || ' ' || n_chars) + 1)::BIGINT AS n_chars FROM documents GROUP BY 1, 2")
def directory_scan(spark, sf_dir):
    """A tree of folders by language and source, in which each document has a line in a source file, beside files that aren't sources."""
    path, docs = shared.folder(spark, "tree"), _table(spark, sf_dir, "documents")
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    rows = docs.select(*[F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")], line.alias("value"))
    rows.write.partitionBy("lang", "source").option("maxRecordsPerFile", 100_000).text(path)
    rows.write.partitionBy("lang", "source").mode("append").option("maxRecordsPerFile", 100_000).csv(path)
    found = files.source_tree(spark, path, suffix=".txt")
    folder = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    # The reader decodes no names of folders: language and source are plain.
    lines = F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit("")))
    return found.select(folder("lang"), folder("source"), lines.alias("n"), F.length("code").alias("c")).groupBy("lang", "source").agg(F.sum("n").cast("long").alias("n_lines"), F.sum("c").cast("long").alias("n_chars"))


@register("s02_path_dispatch", """SELECT page_id, (ARRAY['source', 'records', 'tree', 'unsupported', 'tree'])[1 + (page_id % 5)::INT] AS reader FROM pages""")
def path_dispatch(spark, sf_dir):
    endings = F.element_at(F.array(*map(F.lit, ("/A.java", "/v.CSV", "/src/", "/a.txt", "/main"))), (1 + F.col("page_id") % 5).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", files.reader_of(F.concat("url", endings)).alias("reader"))


SQL_RECORDS = "SELECT 'VUL-' || (s_suppkey % 40) AS vul_id, arg_max(s_name, s_suppkey) AS cve_id FROM supplier WHERE s_suppkey % 40 <> 7 GROUP BY 1"


def _records(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").orderBy("s_suppkey").coalesce(1)
    key = F.when(F.col("s_suppkey") % 40 == 7, "  ").otherwise(F.concat(F.lit(" VUL-"), (F.col("s_suppkey") % 40).cast("string"), F.lit(" ")))
    rows = s.select(key.alias("vul_id"), F.concat(F.col("s_name"), F.lit("  ")).alias("cve_id"))
    return shared.round_trip(rows, "records", lambda w, p: w.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p), files.records)


@register("s03_vulnerability_records", SQL_RECORDS)
def vulnerability_records(spark, sf_dir):
    return _records(spark, sf_dir)


@register("s04_records_summary", f"WITH r AS ({SQL_RECORDS}), f AS (SELECT * FROM r ORDER BY regexp_extract(vul_id, '(\\d+)$', 1)::BIGINT, vul_id LIMIT 2) SELECT count(*) AS n, min(vul_id) AS first, max(vul_id) AS last FROM f")
def records_summary(spark, sf_dir):
    """The first two records in natural order, as a demonstration run takes them (a top-k)."""
    return _records(spark, sf_dir).orderBy(*files.natural_order("vul_id")).limit(2).agg(F.count("*").alias("n"), F.min("vul_id").alias("first"), F.max("vul_id").alias("last"))


@register("s07_program_graphs", """WITH g AS (SELECT l_orderkey AS k, count(*) AS n_nodes, count(*) FILTER (l_returnflag = 'A') AS n_methods, count(*) FILTER (l_returnflag = 'R') AS n_calls, count(*) FILTER (l_linenumber > 3) AS n_links FROM lineitem GROUP BY 1)
    SELECT n_nodes, n_methods, n_calls, CASE WHEN n_links = 0 THEN n_calls + 2 * n_methods ELSE n_links END AS n_edges, count(*) AS graphs FROM g GROUP BY ALL""")  # fmt: skip
def program_graphs(spark, sf_dir):
    """A graph of each order's lines, as JSON lines."""
    line = F.col("l_linenumber").cast("int")
    kind = F.when(F.col("l_returnflag") == "A", "METHOD").when(F.col("l_returnflag") == "R", "CALL").otherwise("LITERAL")
    node = F.struct(line.alias("id"), kind.alias("node_type"), F.lit("x").alias("code"), line.alias("line"))
    edge = F.struct(F.lit(1).alias("source"), line.alias("target"), F.lit("AST").alias("edge_type"))
    graphs = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(node).alias("nodes"), F.collect_list(F.when(line > 3, edge)).alias("edges")).drop("l_orderkey")
    read = shared.round_trip(graphs, "graphs", lambda w, p: w.json(p), lambda s, p: files.program_graphs(s, p, lines=True))
    told = files.graph_summary(read).select(*[F.col(c).cast("long").alias(c) for c in ("n_nodes", "n_methods", "n_calls", "n_edges")])
    return told.groupBy("n_nodes", "n_methods", "n_calls", "n_edges").agg(F.count("*").alias("graphs"))


@register("s19_sarif_issues", "SELECT 'u' || user_id AS file, event_type AS rule, CASE WHEN value >= 70 THEN 'error' ELSE 'warning' END AS level, event_id::INT AS line FROM events WHERE value > 50")
def sarif_issues(spark, sf_dir):
    """The findings of each user as a SARIF log, read back as issues; a warning needn't name its level."""
    place = F.struct(F.struct(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uri")).alias("artifactLocation"), F.struct(F.col("event_id").cast("int").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("event_type").alias("ruleId"), F.when(F.col("value") >= 70, "error").alias("level"), F.struct(F.lit("m").alias("text")).alias("message"), F.array(place).alias("locations"))
    logs = _table(spark, sf_dir, "events").where("value > 50").groupBy("user_id").agg(F.array(F.struct(F.collect_list(result).alias("results"))).alias("runs")).select("runs")
    return shared.round_trip(logs, "sarif", lambda w, p: w.json(p), files.sarif_issues).drop("text")


@register("w01_json_rows", "SELECT event_id, event_type, round(value, 6) AS value, user_id FROM events")
def json_rows(spark, sf_dir):
    """Rows with a nested part, written as JSON and read under their own schema."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.struct("value", "user_id").alias("inner")).alias("outer"))
    read = shared.round_trip(rows, "json", lambda w, p: w.json(p), lambda s, p: s.read.schema(rows.schema).json(p))
    return read.select("event_id", "outer.event_type", F.round("outer.inner.value", 6).alias("value"), "outer.inner.user_id")


@register("w04_text_report", "SELECT line FROM (SELECT event_type || ': ' || count(*) || ' findings, most sure ' || printf('%.2f', max(value) / 100) AS line FROM events GROUP BY event_type)")
def text_report(spark, sf_dir):
    told = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.format_string("%s: %d findings, most sure %.2f", F.first("event_type"), F.count("*"), F.max("value") / 100).alias("line")).select("line")
    return shared.round_trip(told, "report", lambda w, p: w.text(p), lambda s, p: s.read.text(p)).withColumnRenamed("value", "line")


@register("w11_split_tables", "SELECT CASE WHEN event_id % 10 < 8 THEN 'train' WHEN event_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def split_tables(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("split", F.when(F.col("event_id") % 10 < 8, "train").when(F.col("event_id") % 10 == 8, "val").otherwise("test"))
    read = shared.round_trip(rows, "splits", lambda w, p: w.partitionBy("split").parquet(p), lambda s, p: s.read.parquet(p))
    return read.groupBy("split").agg(F.count("*").alias("n"), F.sum("event_id").cast("long").alias("ids"))


@register("w12_telemetry", "SELECT 'all' AS kind, count(*) + 2 * count(*) FILTER (event_id % 2 = 1) AS n FROM events UNION ALL SELECT 'latest', count(*) FILTER (event_id % 2 = 1) * 2 FROM events")
def telemetry(spark, sf_dir):
    """Two runs appended to one table; the latest is a table that each run writes over."""
    path, rows = shared.folder(spark, "telemetry"), _table(spark, sf_dir, "events")
    odd = rows.where("event_id % 2 = 1")
    for part in (rows, odd.unionAll(odd)):
        part.write.mode("overwrite").parquet(f"{path}/latest")
        part.write.mode("append").parquet(f"{path}/all")
    counted = [spark.read.parquet(f"{path}/{k}").agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("all", "latest")]
    return counted[0].unionAll(counted[1])
