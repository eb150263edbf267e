"""What feeds and follows models: messages over graphs, pooling, importance, samples, stacking, greedy choices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.graph import cut


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def element_means(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, vector): element by element the means; cells are averaged before the shuffle."""
    cells = rows.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("m"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias(vector))


def messages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, vector): over the kinds of edges the sum of the means of the sources' vectors, each gated by the sigmoid of its
    product with the target's by the root of the dimension.  nodes(id, vector), edges(source, target, kind); no weights."""
    a = nodes.select(F.col("id").alias("source"), F.col("vector").alias("s"))
    b = nodes.select(F.col("id").alias("target"), F.col("vector").alias("t"))
    told = edges.join(a, "source").join(b, "target")
    gate = 1 / (1 + F.exp(-_dot(F.col("s"), F.col("t")) / F.sqrt(F.size("s"))))
    sent = told.select("target", "kind", F.posexplode(F.transform("s", lambda x: x * gate)).alias("i", "x"))
    summed = sent.groupBy("target", "kind", "i").agg(F.avg("x").alias("m")).groupBy("target", "i").agg(F.sum("m").alias("m"))
    return summed.groupBy(F.col("target").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("vector"))


def neighbour_blend(nodes: DataFrame, edges: DataFrame, own: float = 0.7) -> DataFrame:
    """(id, value): values scaled to [0, 2 pi] over all nodes, blended with the mean of the neighbours in either direction."""
    span = nodes.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = nodes.crossJoin(F.broadcast(span)).select("id", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 2 * F.pi()).otherwise(0.0).alias("v"))  # one row
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionAll(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).where("a <> b").distinct()
    around = both.join(scaled.select(F.col("id").alias("b"), "v"), "b").groupBy("a").agg(F.avg("v").alias("n"))
    return scaled.join(around, scaled.id == around.a, "left").select("id", F.coalesce(own * F.col("v") + (1 - own) * F.col("n"), F.col("v")).alias("value"))


def attention(layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, importance), edges(source, target, importance)) of layers(source, target, layer, weight): a node's importance is
    the mean over layers of its mean incoming weight, an edge's the mean of its ends', 0 for an end without any."""
    by_layer = layers.groupBy(F.col("target").alias("id"), "layer").agg(F.avg("weight").alias("w"))
    nodes = by_layer.groupBy("id").agg(F.avg("w").alias("importance"))
    a, b = nodes.select(F.col("id").alias("source"), F.col("importance").alias("ia")), nodes.select(F.col("id").alias("target"), F.col("importance").alias("ib"))
    edges = layers.select("source", "target").distinct().join(a, "source", "left").join(b, "target", "left")
    return nodes, edges.select("source", "target", ((F.coalesce("ia", F.lit(0.0)) + F.coalesce("ib", F.lit(0.0))) / 2).alias("importance"))


def concatenated(rows: DataFrame, parts: dict[str, float]) -> DataFrame:
    """rows with `features`, the parts' arrays after each other, and `importance`, a map of the parts' weights."""
    weights = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    return rows.withColumns({"features": F.concat(*parts), "importance": weights})


def diverse(rows: DataFrame, k: int, seed: int = 42, vector: str = "vector", id_: str = "id") -> DataFrame:
    """(cluster, id_): of each of k clusters the row nearest to its centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = rows.select(id_, vector, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(known)
    centres = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    gap = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return model.transform(known).join(F.broadcast(centres), "cluster").groupBy("cluster").agg(F.min_by(id_, F.struct(gap, id_)).alias(id_))  # k rows


def stacked(votes: DataFrame, models: Sequence[str], label: str, id_: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(id_, label, probability): a logistic regression over the models' confidences, each row judged by a fit on the other folds.

    Folds are dealt within a label by a seeded hash, so each has its share of both.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(models), outputCol="_v").transform(votes).withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), label, id_), F.lit(folds)))
    out = None
    for fold in range(folds):
        model = LogisticRegression(featuresCol="_v", labelCol=label, regParam=0.01).fit(rows.where(F.col("_fold") != fold))
        part = model.transform(rows.where(F.col("_fold") == fold)).select(id_, label, vector_to_array("probability")[1].alias("probability"))
        out = part if out is None else out.unionAll(part)
    return out


def minimal_failing(items: DataFrame, fails: Callable[[DataFrame], DataFrame], order: str, item: str) -> DataFrame:
    """What is left of items(order, item) when each is left out, one at a time in order, if the rest still fails.

    fails: of candidates(candidate, item), sets of items as rows, the candidates (candidate) that fail.  Leaving out one
    after the other goes on up to the first that is needed; a round tests all these sets at once, keeps that one and goes on
    behind it, so there are as many rounds as items that stay, and one more.
    """
    rows = cut(items.select(F.row_number().over(Window.orderBy(order)).alias("place"), item))  # the items of one report
    kept: list[int] = []
    n, done = rows.count(), 0
    while done < n:
        # Candidate j leaves out the items after `done` up to j.
        tried = rows.where(F.col("place") > done).select("place", item, F.explode(F.sequence(F.lit(done + 1), F.lit(n))).alias("candidate")).where(F.col("place") > F.col("candidate"))
        stays = rows.where(F.col("place").isin(kept)).select(item, F.explode(F.sequence(F.lit(done + 1), F.lit(n))).alias("candidate"))
        failing = {r[0] for r in fails(tried.select("candidate", item).unionByName(stays.select("candidate", item))).select("candidate").distinct().collect()}
        needed = next((j for j in range(done + 1, n + 1) if j not in failing), n + 1)
        if needed <= n:
            kept.append(needed)
        done = needed
    return rows.where(F.col("place").isin(kept)).select(item)


def greedy_choice(rewards: DataFrame, key: str, path: str, reward: str, rate: float = 0.01, explore: float = 0.0, seed: int = 42) -> DataFrame:
    """(key, path, q): of each key the path of the highest value, which grows by rate * reward; of a share `explore` of the keys
    a path by a seeded hash."""
    q = rewards.groupBy(key, path).agg((rate * F.sum(reward)).alias("q"))
    order = F.xxhash64(F.lit(seed), key, path)
    best, other = F.min_by(F.struct(path, "q"), F.struct(-F.col("q"), F.col(path))), F.min_by(F.struct(path, "q"), order)
    chance = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    told = q.groupBy(key).agg(best.alias("b"), other.alias("o")).withColumn("x", F.when(chance < explore, F.col("o")).otherwise(F.col("b")))
    return told.select(key, F.col(f"x.{path}").alias(path), F.col("x.q").alias("q"))


def class_tree(classes: DataFrame, joiner: str = "$") -> DataFrame:
    """(id, name) of classes(id, parent, name): names of inner classes after those of their outer ones, a level a round."""
    level = classes.where("parent is null").select("id", F.col("name").alias("full"))
    out = level
    while True:
        level = classes.join(level.select(F.col("id").alias("parent"), "full"), "parent").select("id", F.concat("full", F.lit(joiner), "name").alias("full"))
        if level.isEmpty():
            return out.withColumnRenamed("full", "name")
        out = out.unionAll(level)
