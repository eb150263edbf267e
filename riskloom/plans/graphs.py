"""Queries of the graph operators over the tables' own containment, and beside it a taint graph of known shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.rules import quoted
from riskloom.operators import answers, counterfactual
from riskloom.operators import graph as G
from riskloom.plans.registry import register
from riskloom.sources import shared

#: Chain, diamond, cycle, isolated sink, duplicate edge, sanitized end, a path longer than eight hops.
EDGES = [
    ("src1", "a"), ("a", "b"), ("b", "sink1"), ("src2", "c"), ("c", "d"), ("c", "e"), ("d", "sink2"), ("e", "sink2"), ("src2", "c"), ("f", "g"), ("g", "h"), ("h", "f"), ("h", "sink3"),
    ("src3", "clean"), ("clean", "sink4"), *[(f"l{i}", f"l{i + 1}") for i in range(12)], ("l12", "sink5"), ("src4", "l0"), ("src1", "sink1"),
]
LABELS = [("sink1", "sql"), ("sink2", "xss"), ("sink2", "sql"), ("sink3", "xxe"), ("sink5", "ssrf")]
_values = lambda rows: ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in rows)
TABLE_EDGES = """e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'AST' AS kind FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CFG' FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'DFG' FROM orders UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'CDG' FROM supplier)"""


def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, a, x, b, y, kind in (("nation", "r", "n_regionkey", "n", "n_nationkey", "AST"), ("customer", "n", "c_nationkey", "c", "c_custkey", "CFG"), ("orders", "c", "o_custkey", "o", "o_orderkey", "DFG"), ("supplier", "n", "s_nationkey", "s", "s_suppkey", "CDG")):
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        parts.append(t.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"), F.lit(kind).alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


SQL_EDGES = f"{TABLE_EDGES}, edges(source, target) AS (SELECT * FROM (VALUES {_values(EDGES)}) v(a, b) UNION ALL SELECT source, target FROM e)"
CLOSURE = "closure(seed, node) AS (SELECT DISTINCT s, s FROM seeds(s) UNION SELECT seed, e.t FROM closure JOIN step e ON e.s = node)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(EDGES, "source string, target string").unionAll(table_edges(spark, sf_dir).select("source", "target"))


def seeds(e: DataFrame, pattern: str) -> DataFrame:
    """The nodes whose name begins as the pattern says."""
    return e.select("source").union(e.select("target")).distinct().where(F.col("source").rlike(pattern)).select(F.col("source").alias("seed"))


#: Ends of the taint graph; of closures and roots also the regions and suppliers.
SINKS = "SELECT DISTINCT target FROM edges WHERE starts_with(target, 'sink')"
SOURCES = "SELECT DISTINCT source FROM edges WHERE starts_with(source, 'src')"


@register("g08_reachable", f"WITH RECURSIVE {SQL_EDGES}, step(s, t) AS (SELECT DISTINCT * FROM edges), seeds(s) AS ({SOURCES} OR regexp_matches(source, '^r[0-9]')), {CLOSURE.replace('seeds(s)', 'seeds').replace('SELECT DISTINCT s, s', 'SELECT s, s')} SELECT * FROM closure")
def reachable(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.closure(e, seeds(e, "^(src|r[0-9])"))


@register(
    "g09_roots",
    f"WITH RECURSIVE {SQL_EDGES}, step(s, t) AS (SELECT DISTINCT target, source FROM edges), seeds(s) AS ({SINKS} OR regexp_matches(target, '^s[0-9]')), closure(seed, node) AS (SELECT s, s FROM seeds UNION SELECT seed, e.t FROM closure JOIN step e ON e.s = node) SELECT seed, node AS root FROM closure WHERE node NOT IN (SELECT target FROM edges)",
)
def roots(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.roots(e, seeds(e, "^(sink|s[0-9])"))


_PATHS = """paths(path, cur, hops) AS (SELECT [source], source, 0 FROM ({starts}) UNION ALL SELECT list_append(path, e.target), e.target, hops + 1 FROM paths JOIN {edges} e ON e.source = cur WHERE NOT list_contains(path, e.target) AND hops < {most}{stop})"""


@register(
    "g10_simple_paths",
    f"WITH RECURSIVE {SQL_EDGES}, once AS (SELECT DISTINCT * FROM edges), {_PATHS.format(starts=SOURCES, edges='once', most=20, stop='')} SELECT array_to_string(path, '>') AS path, hops::INT AS hops FROM paths WHERE starts_with(cur, 'sink')",
)
def all_simple_paths(spark, sf_dir):
    e = edges(spark, sf_dir)
    starts, ends = (seeds(e, p).withColumnRenamed("seed", "node") for p in ("^src", "^sink"))
    out = G.simple_paths(e.distinct(), starts, ends, None, stop=False)
    return out.select(F.array_join("path", ">").alias("path"), "hops")


@register(
    "g12_bounded_paths",
    f"WITH RECURSIVE {SQL_EDGES}, {_PATHS.format(starts=SOURCES, edges='edges', most=8, stop=' AND NOT starts_with(cur, $$sink$$)')} SELECT array_to_string(path, '>') AS path, hops::INT AS hops FROM paths WHERE starts_with(cur, 'sink')",
)
def bounded_paths(spark, sf_dir):
    """Duplicate edges are not collapsed: they give a path each."""
    e = edges(spark, sf_dir)
    starts, ends = (seeds(e, p).withColumnRenamed("seed", "node") for p in ("^src", "^sink"))
    return G.simple_paths(e, starts, ends).select(F.array_join("path", ">").alias("path"), "hops")


WHY = f"step(s, t) AS (SELECT DISTINCT target, source FROM edges), seeds(s) AS ({SINKS}), closure(seed, node) AS (SELECT s, s FROM seeds UNION SELECT seed, e.t FROM closure JOIN step e ON e.s = node)"


@register("g11_why_tainted", f"WITH RECURSIVE {SQL_EDGES}, {WHY} SELECT seed, string_agg(node, ',' ORDER BY node) AS sources FROM closure WHERE node NOT IN (SELECT target FROM edges) GROUP BY seed UNION ALL SELECT s, '' FROM seeds WHERE s NOT IN (SELECT seed FROM closure WHERE node NOT IN (SELECT target FROM edges))")
def why_tainted(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.explained(e, seeds(e, "^sink")).select("seed", "sources")


@register("g11_why_not_tainted", f"WITH RECURSIVE {SQL_EDGES}, {WHY} SELECT s AS seed, CASE WHEN EXISTS (SELECT 1 FROM closure WHERE seed = s AND node NOT IN (SELECT target FROM edges)) THEN 'taint_not_propagated' ELSE 'no_path_from_sources' END AS reason FROM seeds UNION ALL SELECT 'nowhere', 'target_not_in_graph'")
def why_not_tainted(spark, sf_dir):
    """Beside the sinks, a target that the graph doesn't have."""
    e = edges(spark, sf_dir)
    asked = seeds(e, "^sink").unionAll(spark.createDataFrame([("nowhere",)], "seed string"))
    return G.explained(e, asked).select("seed", "reason")


@register(
    "g13_label_propagation",
    f"WITH RECURSIVE {SQL_EDGES}, labels(node, label) AS (VALUES {_values(LABELS)}), step(s, t) AS (SELECT DISTINCT target, source FROM edges), closure(seed, node) AS (SELECT node, node FROM labels UNION SELECT seed, e.t FROM closure JOIN step e ON e.s = node) SELECT c.node, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM closure c JOIN labels l ON l.node = c.seed GROUP BY c.node",
)
def label_propagation(spark, sf_dir):
    return G.labels_backward(edges(spark, sf_dir), spark.createDataFrame(LABELS, "node string, label string"))


@register(
    "g07_containment_closure",
    f"WITH RECURSIVE {TABLE_EDGES}, closure(seed, node) AS (SELECT DISTINCT source, source FROM e WHERE kind = 'AST' UNION SELECT seed, e.target FROM closure JOIN e ON e.source = node) SELECT seed, substr(node, 1, 1) AS kind, count(*) AS n FROM closure WHERE node <> seed GROUP BY ALL",
)
def containment_closure(spark, sf_dir):
    e = table_edges(spark, sf_dir)
    reached = G.closure(e, e.where("kind = 'AST'").select(F.col("source").alias("seed")))
    return reached.where("node <> seed").groupBy("seed", F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@register(
    "g29_degree_centrality",
    f"WITH {TABLE_EDGES}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e), d AS (SELECT target AS node, count(*) AS k FROM e GROUP BY target) SELECT node, coalesce(k, 0) AS indegree, round(coalesce(k, 0)::DOUBLE / ((SELECT count(*) FROM n) - 1), 12) AS centrality FROM n LEFT JOIN d USING (node)",
)
def degree_centrality(spark, sf_dir):
    return G.degrees(table_edges(spark, sf_dir))


@register("a27_edge_families", f"WITH {TABLE_EDGES} SELECT kind, count(*) AS n, count(DISTINCT source) AS sources FROM e GROUP BY kind")
def edge_families(spark, sf_dir):
    return table_edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


LINES = """lines AS (SELECT conv_id, turn, text, role = 'user' AS is_source, contains(lower(text), 'the') AS is_sink FROM conversations)"""


@register(
    "g26_order_taint",
    f"WITH {LINES}, f AS (SELECT conv_id, turn, is_sink, coalesce(bool_or(is_source) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), false) AS seen FROM lines) SELECT conv_id, turn FROM f WHERE is_sink AND seen",
)
def order_taint(spark, sf_dir):
    """Once a source line was seen in a file, that and every later sink line is a flow."""
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.coalesce(F.bool_or(F.col("role") == "user").over(w), F.lit(False))
    return c.select("conv_id", "turn", F.lower("text").contains("the").alias("sink"), seen.alias("seen")).where("sink and seen").select("conv_id", "turn")


@register("f07_path_index", f"""WITH RECURSIVE {SQL_EDGES}, step(s, t) AS (SELECT DISTINCT * FROM edges), first(s) AS ({SOURCES} OR regexp_matches(source, '^r[0-9]')),
    walk(source, node, hops) AS (SELECT s, s, 0 FROM first UNION SELECT w.source, t, hops + 1 FROM walk w JOIN step ON step.s = w.node WHERE hops < 20),
    near AS (SELECT source, node, min(hops) AS hops FROM walk GROUP BY source, node), nodes(node) AS (SELECT source FROM edges UNION SELECT target FROM edges UNION SELECT s FROM first)
    SELECT node, source, hops, hops + 1 AS n FROM nodes LEFT JOIN near USING (node)""")  # fmt: skip
def path_index(spark, sf_dir):
    """The index of shortest paths from the sources and regions, written by bucket and read back."""
    e, folder = edges(spark, sf_dir), shared.folder(spark, "paths")
    answers.write_index(e, seeds(e, "^(src|r[0-9])").select(F.col("seed").alias("source")), folder)
    return answers.read_index(spark, folder).select("node", "source", "hops", F.when(F.col("source").isNotNull(), F.size("path")).alias("n"))


@register("x07_counterfactuals", """WITH o AS (SELECT o_custkey AS graph, o_totalprice AS w, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
    c AS (SELECT *, sum(w) OVER (PARTITION BY graph ORDER BY k) AS gone FROM o) SELECT graph, min(k)::INT AS removed FROM c WHERE (total - gone) / total < 0.7 GROUP BY graph HAVING min(k) <= 3""")  # fmt: skip
def counterfactuals(spark, sf_dir):
    """Of each customer's orders the fewest without which less than 0.7 of their value is left, three at most; the dearest first is exact here, so a beam of one is."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    total = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    rows = o.join(total, "o_custkey").select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("edge"), (F.col("o_totalprice") / F.col("total")).alias("share"))
    found = counterfactual.smallest_flips(rows, lambda left: left.groupBy("graph", "candidate").agg(F.sum("share").alias("score")), 0.7, 3, beam=1)
    return found.select("graph", F.size("removed").alias("removed"))
