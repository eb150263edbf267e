"""Readers: source trees, expected-result lists, vulnerability records, predictions and program graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "vul_id, cve_id, cwe_id, cwe_name, repo_slug, human_patch, build_system, compliance_level, failing_tests, compile_cmd, test_all_cmd, test_cmd, cmd_options, failing_module, src, test, warning"
NODE = "id int, node_type string, category string, code string, name string, line int, column int, order int"
EDGE = "source int, target int, edge_type string, edge_type_id int"
GRAPH = f"nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>"


def source_tree(spark: SparkSession, path: str, suffix: str = ".java", recursive: bool = True) -> DataFrame:
    """(path, code) of the files below path; whoever shows them sorts the paths."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return read.select("path", F.decode("content", "UTF-8").alias("code"))


def expected_results(spark: SparkSession, path: str) -> DataFrame:
    """test_name, category, real_vuln, cwe; blank and # lines and rows of fewer than 4 fields are skipped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    cells = lines.select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("c")).where(F.size("c") >= 4)
    return cells.select(F.col("c")[0].alias("test_name"), F.lower(F.col("c")[1]).alias("category"), (F.lower(F.col("c")[2]) == "true").alias("real_vuln"), F.col("c")[3].alias("cwe"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Vulnerability records of a CSV with a header: trimmed, keyed by vul_id; of one key the last row holds."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.trim(F.col(c)).alias(c) for c in rows.columns]).withColumn("_at", F.monotonically_increasing_id())
    return last_of_key(rows.where(F.col("vul_id") != ""), "vul_id", "_at").drop("_at")


def last_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by one aggregate that keeps a row for each key and task."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def natural_order(key: str) -> list:
    """Sort keys: the number at the key's end, then the key."""
    return [F.expr(rf"try_cast(regexp_extract({key}, '(\\d+)$', 1) as bigint)").asc_nulls_last(), F.col(key)]


def labelled_path(path: str = "path") -> list:
    """cwe number and label of a path: the number after CWE, bad before good; base files have none."""
    p = F.lower(F.col(path))
    return [F.regexp_extract(path, r"CWE(\d+)_", 1).alias("cwe"), F.when(p.contains("_bad"), 1).when(p.contains("_good"), 0).alias("label")]


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """conf, label, pred, subgroup of prediction rows, whichever of the accepted names they use."""
    rows = spark.read.json(path, multiLine=True)
    some = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit(None))
    conf = some("confidence", "combined", "score").cast("double")
    nodes = some("graph_nodes", "num_nodes").cast("int")
    out = rows.select(
        conf.alias("conf"), F.coalesce(some("ground_truth", "label", "y_binary").cast("int"), F.lit(-1)).alias("label"),
        F.coalesce(some("predicted_class", "prediction").cast("int"), (conf >= 0.5).cast("int")).alias("pred"),
        F.when(nodes < 50, "small").when(nodes < 200, "medium").when(nodes.isNotNull(), "large").otherwise("unknown").alias("subgroup"),
    )
    return out.where(F.col("label") >= 0)


def program_graphs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Program graphs of JSON files, a graph in each file or in each of its lines: nodes and edges with explicit schemas."""
    return spark.read.schema(GRAPH).json(path, multiLine=not lines)


def sarif_issues(spark: SparkSession, path: str) -> DataFrame:
    """(file, rule, level, text, line) of SARIF logs, a log in each line."""
    place = "physicalLocation struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>"
    result = f"struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<{place.replace(' ', ': ', 1)}>>>"
    logs = spark.read.schema(f"runs array<struct<results: array<{result}>>>").json(path)
    r = logs.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    first = F.col("r.locations")[0]["physicalLocation"]
    return r.select(first["artifactLocation"]["uri"].alias("file"), F.col("r.ruleId").alias("rule"), F.coalesce("r.level", F.lit("warning")).alias("level"), F.col("r.message.text").alias("text"), first["region"]["startLine"].alias("line"))


def reader_of(path) -> object:
    """What reads a path: by its ending the records of a CSV or a source file; a folder without an ending as a tree."""
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.when(F.lower(name).endswith(".java"), "source").when(F.lower(name).endswith(".csv"), "records").when(path.endswith("/") | ~name.contains("."), "tree").otherwise("unsupported")


def graph_summary(graphs: DataFrame) -> DataFrame:
    """Counts by node and edge kind; without edges they are estimated as calls + 2 * methods."""
    of = lambda kind: F.size(F.filter("nodes", lambda n: n["node_type"] == kind))
    edges = F.size("edges")
    return graphs.select(F.size("nodes").alias("n_nodes"), of("METHOD").alias("n_methods"), of("CALL").alias("n_calls"), F.when(edges == 0, of("CALL") + 2 * of("METHOD")).otherwise(edges).alias("n_edges"))
