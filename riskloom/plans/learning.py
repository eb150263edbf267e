"""Queries of what feeds and follows models."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import learning as N
from riskloom.plans.registry import register
from riskloom.plans.scores import _table


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def _vector_edges(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    n = v.count()
    steps = F.explode(F.array(*[F.struct(F.pmod(F.col("id") * m + 1, F.lit(n)).alias("target"), F.lit(m).alias("kind")) for m in (3, 7)]))
    return v.select(F.col("id").alias("source"), steps.alias("e")).select("source", "e.target", "e.kind")


SQL_VECTORS = """v AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), n AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings),
    e AS (SELECT vec_id AS source, (vec_id * kind + 1) % n.n AS target, kind FROM embeddings, n, (VALUES (3), (7)) k(kind))"""


@register("g30_message_passing", f"""WITH {SQL_VECTORS}, g AS (SELECT e.source, e.target, e.kind, 1 / (1 + exp(-sum(a.x * b.x) / sqrt(any_value(n.d)))) AS gate FROM e JOIN v a ON a.id = e.source JOIN v b ON b.id = e.target AND a.i = b.i CROSS JOIN n GROUP BY ALL),
    m AS (SELECT target, kind, i, avg(x * gate) AS m FROM g JOIN v ON v.id = g.source GROUP BY ALL) SELECT target AS id, i AS place, round(sum(m) + 1e-10, 6) + 0.0 AS value FROM m GROUP BY target, i""")  # fmt: skip
def message_passing(spark, sf_dir):
    out = N.messages(_vectors(spark, sf_dir), _vector_edges(spark, sf_dir)).select("id", F.posexplode("vector").alias("place", "value"))
    return out.select("id", F.col("place").cast("long").alias("place"), (F.round(F.col("value") + 1e-10, 6) + 0.0).alias("value"))


@register("g33_mean_pooling", f"WITH {SQL_VECTORS} SELECT label, i AS place, round(sum(x) / count(*) + 1e-10, 6) + 0.0 AS value FROM v GROUP BY label, i")
def mean_pooling(spark, sf_dir):
    out = N.element_means(_vectors(spark, sf_dir), ["label"], "vector").select("label", F.posexplode("vector").alias("place", "value"))
    return out.select("label", F.col("place").cast("long").alias("place"), (F.round(F.col("value") + 1e-10, 6) + 0.0).alias("value"))


@register("x05_attention_edges", """WITH l AS (SELECT l_suppkey AS s, (l_partkey * 3) % 97 AS t, l_linenumber AS layer, l_discount AS w FROM lineitem), i AS (SELECT t AS id, avg(w) AS v FROM (SELECT t, layer, avg(w) AS w FROM l GROUP BY t, layer) GROUP BY t)
    SELECT s AS source, t AS target, round((coalesce(a.v, 0) + coalesce(b.v, 0)) / 2 + 1e-10, 8) AS importance FROM (SELECT DISTINCT s, t FROM l) LEFT JOIN i a ON a.id = s LEFT JOIN i b ON b.id = t""")  # fmt: skip
def attention_edges(spark, sf_dir):
    layers = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") * 3 % 97).alias("target"), F.col("l_linenumber").alias("layer"), F.col("l_discount").alias("weight"))
    return N.attention(layers)[1].withColumn("importance", F.round(F.col("importance") + 1e-10, 8))


@register("x09_neighbour_mean", """WITH s AS (SELECT s_suppkey AS id, CASE WHEN max(s_acctbal) OVER () > min(s_acctbal) OVER () THEN (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) * 2 * pi() ELSE 0 END AS v FROM supplier),
    e AS (SELECT DISTINCT l_suppkey AS a, l_orderkey % 10 AS b FROM lineitem), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), m AS (SELECT a, avg(v) AS n FROM u JOIN s ON s.id = u.b GROUP BY a)
    SELECT id, round(CASE WHEN n IS NULL THEN v ELSE 0.7 * v + 0.3 * n END + 1e-10, 7) AS value FROM s LEFT JOIN m ON m.a = s.id""")  # fmt: skip
def neighbour_mean(spark, sf_dir):
    nodes = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    edges = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") % 10).alias("target")).distinct()
    return N.neighbour_blend(nodes, edges).withColumn("value", F.round(F.col("value") + 1e-10, 7))


@register("x12_feature_concatenation", "SELECT vec_id AS id, len(embedding) + 2 AS width, round(list_sum(embedding::DOUBLE[]) + label + 1, 6) AS total, 0.3::DOUBLE AS importance FROM embeddings")
def feature_concatenation(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("tail", F.array(F.col("label").cast("double"), F.lit(1.0)))
    out = N.concatenated(rows, {"vector": 0.7, "tail": 0.3})
    return out.select("id", F.size("features").cast("long").alias("width"), F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.element_at("importance", "tail").alias("importance"))


@register("q03_diverse_sampling")
def diverse_sampling(spark, sf_dir):
    """One row for each of 8 clusters; clusters have no SQL form."""
    return N.diverse(_vectors(spark, sf_dir), 8)


@register("e21_stacking")
def stacking(spark, sf_dir):
    """Each order line judged by a regression that didn't see it; a fit has no SQL form."""
    rows = _table(spark, sf_dir, "lineitem")
    keyed = rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") / 50).alias("c"))
    return N.stacked(keyed, ["a", "b", "c"], "label", "id")


@register("q11_minimal_failing_set", "SELECT n_name FROM nation WHERE n_nationkey IN (3, 17)")
def minimal_failing_set(spark, sf_dir):
    def fails(candidates):
        """Sets with both of two nations."""
        return candidates.groupBy("candidate").agg(F.count_if(F.col("n_name").isin("NATION_3", "NATION_17")).alias("n")).where("n = 2")

    return N.minimal_failing(_table(spark, sf_dir, "nation"), fails, "n_nationkey", "n_name")


@register("q12_epsilon_greedy", "WITH q AS (SELECT user_id, event_type AS path, sum(value) / 100 AS q FROM events GROUP BY ALL) SELECT user_id, path, round(q, 6) AS q FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY q DESC, path) = 1")
def epsilon_greedy(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("path"), "value")
    return N.greedy_choice(rows, "user_id", "path", "value").withColumn("q", F.round("q", 6))


@register("x01_warnings_in_methods", """WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 7 END AS parent, 'C' || p_partkey AS name FROM part), t AS (SELECT id, name AS class FROM c WHERE parent IS NULL UNION ALL SELECT c.id, t.class || '$' || c.name FROM c JOIN t ON c.parent = t.id)
    SELECT t.class, count(*) AS warnings FROM lineitem l JOIN t ON t.id = l.l_partkey JOIN (SELECT DISTINCT o_orderkey % 2000 AS id, o_orderkey % 5 AS method FROM orders WHERE o_orderstatus = 'P') m ON m.id = l.l_partkey AND m.method = l.l_suppkey % 5 GROUP BY t.class""")  # fmt: skip
def warnings_in_methods(spark, sf_dir):
    k = F.col("p_partkey")
    tree = N.class_tree(_table(spark, sf_dir, "part").select(k.alias("id"), F.when(k != 0, F.floor(k / 7)).cast("long").alias("parent"), F.concat(F.lit("C"), k.cast("string")).alias("name"))).withColumnRenamed("name", "class")
    modified = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 2000).alias("id"), (F.col("o_orderkey") % 5).alias("method")).distinct()
    warned = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 5).alias("method"))
    return warned.join(modified, ["id", "method"]).join(tree, "id").groupBy("class").agg(F.count("*").alias("warnings"))
