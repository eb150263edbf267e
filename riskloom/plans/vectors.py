"""Queries of prototypes, out-of-distribution scores and batch losses over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import vectors as V
from riskloom.plans.registry import register

UNIT = """unit AS (SELECT vec_id AS id, label AS class, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"""
CENTRES = f"""{UNIT}, el AS (SELECT class, i, avg(u[i]) AS m FROM unit, range(1, 65) r(i) GROUP BY class, i), means AS (SELECT class, list(m ORDER BY i) AS m FROM el GROUP BY class),
 centre AS (SELECT class, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS centroid FROM means),
 proto AS (SELECT class, count(*) AS n, avg(1 - list_dot_product(u, centroid)) AS radius, coalesce(stddev_samp(1 - list_dot_product(u, centroid)), 0) AS sd FROM unit JOIN centre USING (class) GROUP BY class)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("class"))


@register("a17_prototypes", f"WITH {CENTRES} SELECT class, n, round(radius, 7) AS radius, round(sd, 7) AS sd, round(centroid[1], 7) AS c1, round(centroid[64], 7) AS c64 FROM proto JOIN centre USING (class)")
def prototypes(spark, sf_dir):
    p = V.prototypes(vectors(spark, sf_dir), 64)
    return p.select("class", "n", F.round("radius", 7).alias("radius"), F.round("sd", 7).alias("sd"), F.round(F.col("centroid")[0], 7).alias("c1"), F.round(F.col("centroid")[63], 7).alias("c64"))


@register(
    "a20_prototype_scores",
    f"""WITH {CENTRES}, s AS (SELECT id, unit.class AS own, centre.class AS near, list_dot_product(u, centroid) AS sim FROM unit, centre), b AS (SELECT id, own, arg_max(near, sim) AS nearest, max(sim) AS top FROM s GROUP BY id, own),
    t AS (SELECT s.id, sum(exp((sim - top) / 0.07::DOUBLE)) AS total FROM s JOIN b USING (id) GROUP BY s.id) SELECT id, own, nearest, round(1 - top, 7) AS distance, round(1 / total, 7) AS share FROM b JOIN t USING (id)""",
)
def prototype_scores(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return V.scored(v, V.prototypes(v, 64)).select("id", "own", "nearest", F.round("distance", 7).alias("distance"), F.round("share", 7).alias("share"))


@register("a21_ood_threshold", f"WITH {CENTRES}, g AS (SELECT avg(sd) AS g FROM proto) SELECT z, round(max(radius + z * sd) / max(g), 6) AS threshold FROM proto, g, (VALUES (1.282::DOUBLE), (1.645::DOUBLE), (2.326::DOUBLE)) q(z) GROUP BY z")
def ood_threshold(spark, sf_dir):
    p = V.prototypes(vectors(spark, sf_dir), 64)
    z = F.explode(F.array(F.lit(1.282), F.lit(1.645), F.lit(2.326)))
    g = F.broadcast(p.agg(F.avg("sd").alias("g")))
    return p.select("radius", "sd", z.alias("z")).crossJoin(g).groupBy("z").agg(F.round(F.max(F.col("radius") + F.col("z") * F.col("sd")) / F.max("g"), 6).alias("threshold"))


@register(
    "a19_contrastive_loss",
    f"""WITH {UNIT}, p AS (SELECT a.id, a.id // 32 AS batch, a.class = b.class AS same, list_dot_product(a.u, b.u) / 0.07::DOUBLE AS s FROM unit a JOIN unit b ON a.id // 32 = b.id // 32 AND a.id <> b.id),
    m AS (SELECT id, batch, max(s) AS top FROM p GROUP BY id, batch), r AS (SELECT p.id, p.batch, max(top) + ln(sum(exp(s - top))) AS lse, avg(s) FILTER (same) AS pos FROM p JOIN m USING (id, batch) GROUP BY p.id, p.batch) SELECT batch, count(pos) AS anchors, round(avg(lse - pos), 6) AS loss FROM r GROUP BY batch""",
)
def contrastive_loss(spark, sf_dir, size: int = 32):
    """Within batches of fixed size, so the pairs grow with the rows, not with their square."""
    u = vectors(spark, sf_dir).select("id", "class", F.floor(F.col("id") / size).alias("batch"), V.normalised(F.col("v")).alias("u"))
    a, b = u.alias("a"), u.alias("b")
    p = a.join(b, (F.col("a.batch") == F.col("b.batch")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("id"), F.col("a.batch").alias("batch"), (F.col("a.class") == F.col("b.class")).alias("same"), (V.dot(F.col("a.u"), F.col("b.u")) / 0.07).alias("s"))
    r = p.groupBy("id", "batch").agg(F.ln(F.sum(F.exp("s"))).alias("lse"), F.avg(F.when(F.col("same"), F.col("s"))).alias("pos"))
    return r.groupBy("batch").agg(F.count("pos").alias("anchors"), F.round(F.avg(F.col("lse") - F.col("pos")), 6).alias("loss"))


@register(
    "g31_graph_compression",
    "WITH n AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) DESC, vec_id) AS rn FROM embeddings), k AS (SELECT id, rn - 1 AS idx FROM n WHERE rn <= 100), e AS (SELECT vec_id AS s, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS t, label AS edge_type FROM embeddings) SELECT a.idx AS source, b.idx AS target, edge_type FROM e JOIN k a ON a.id = s JOIN k b ON b.id = t",
)
def graph_compression(spark, sf_dir, keep: int = 100):
    """The induced subgraph of the `keep` nodes of largest norm, renumbered, with edge types aligned."""
    v = vectors(spark, sf_dir)
    d = F.transform("v", lambda x: x.cast("double"))
    top = v.select("id", V.dot(d, d).alias("norm")).orderBy(F.desc("norm"), "id").limit(keep)
    from riskloom.functions.ranking import numbered

    k = F.broadcast(numbered(top, F.desc("norm"), "id").select("id", (F.col("rn") - 1).cast("long").alias("idx")))
    n = F.broadcast(v.agg(F.count("*").alias("n")))
    e = v.crossJoin(n).select(F.col("id").alias("s"), ((F.col("id") * 7 + 3) % F.col("n")).alias("t"), F.col("class").alias("edge_type"))
    a, b = k.select(F.col("id").alias("s"), F.col("idx").alias("source")), k.select(F.col("id").alias("t"), F.col("idx").alias("target"))
    return e.join(a, "s").join(b, "t").select("source", "target", "edge_type")
