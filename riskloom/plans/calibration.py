"""Queries of calibration and curation, over predictions bound to lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators import calibration as C
from riskloom.plans.registry import register

PREDS = """preds AS (SELECT least(l_discount * 10, 1.0::DOUBLE) AS conf, (l_returnflag = 'R')::INT AS label, (l_discount * 10 >= 0.5)::INT AS pred, l_linestatus AS subgroup, l_linenumber AS type,
 CASE WHEN l_quantity > 49 THEN 'timeout' END AS error, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity FROM lineitem)"""
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "label")
HIT = "(pred = label)::INT"
BINS = f"bins AS (SELECT {{by}} least(floor(conf * {{n}}), {{n}} - 1)::INT AS bin, count(*) AS n, avg(conf) AS conf, avg({HIT}) AS accuracy, avg(conf) - avg({HIT}) AS gap FROM preds GROUP BY ALL)"
ERRORS = """{by} sum(n)::BIGINT AS n, round(sum(n * abs(gap)) / sum(n), 9) AS ece, round(max(abs(gap)), 9) AS mce, round(sqrt(sum(n * gap * gap) / sum(n)), 9) AS l2,
 round(sum(CASE WHEN gap > 0 THEN n * abs(gap) ELSE 0 END) / sum(n), 9) AS over, round(sum(CASE WHEN gap > 0 THEN 0 ELSE n * abs(gap) END) / sum(n), 9) AS under,
 round(sum(CASE WHEN gap > 0 THEN n ELSE 0 END) / sum(n), 9) AS over_share, round(sum(n * abs(gap) * CASE WHEN gap > 0 THEN 2.0 ELSE 1.0 END) / sum(n), 9) AS security"""
CONFUSION = """count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (pred = 1) AS predicted, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
 count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn"""
RATES = """round(CASE WHEN n > 0 THEN (tp + tn)::DOUBLE / n ELSE 0 END, 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 9) AS recall"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.col("l_discount") * 10
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.least(conf, F.lit(1.0)).alias("conf"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (conf >= 0.5).cast("int").alias("pred"), F.col("l_linestatus").alias("subgroup"),
        F.col("l_linenumber").alias("type"), F.when(F.col("l_quantity") > 49, "timeout").alias("error"), *[c for c in KEY if c != "label"], "l_quantity",
    )


@register("a03_confusion_by_type", f"WITH {PREDS}, c AS (SELECT type, {CONFUSION} FROM preds WHERE error IS NULL GROUP BY type) SELECT *, {RATES} FROM c")
def confusion_by_type(spark, sf_dir):
    return C.confusion(preds(spark, sf_dir).where("error is null"), "type")


@register("a03_confusion_global", f"WITH {PREDS}, c AS (SELECT {CONFUSION} FROM preds) SELECT *, {RATES} FROM c")
def confusion_global(spark, sf_dir):
    return C.confusion(preds(spark, sf_dir))


@register("a04_brier", f"WITH {PREDS} SELECT round(avg((conf - label) ** 2), 9) AS brier FROM preds")
def brier(spark, sf_dir):
    return C.brier(preds(spark, sf_dir))


@register("a05_label_rate_ece", f"WITH {PREDS}, b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(label) AS r FROM preds WHERE error IS NULL GROUP BY bin) SELECT round(sum(n * abs(c - r)) / sum(n), 9) AS ece FROM b")
def label_rate_ece(spark, sf_dir):
    return C.label_rate_error(preds(spark, sf_dir).where("error is null"))


@register(
    "a06_accuracy_bins",
    f"WITH {PREDS}, {BINS.format(by='', n=15)} SELECT i::INT AS bin, round(i / 15.0::DOUBLE, 9) AS lo, round((i + 1) / 15.0::DOUBLE, 9) AS hi, coalesce(n, 0) AS n, round(coalesce(conf, 0), 9) AS conf, round(coalesce(accuracy, 0), 9) AS accuracy, round(coalesce(gap, 0), 9) AS gap FROM range(15) r(i) LEFT JOIN bins ON bin = i",
)
def accuracy_bins(spark, sf_dir):
    return C.all_bins(preds(spark, sf_dir))


@register("a07_calibration_errors", f"WITH {PREDS}, {BINS.format(by='', n=15)} SELECT {ERRORS.format(by='')} FROM bins")
def calibration_errors(spark, sf_dir):
    return C.errors(C.bins(preds(spark, sf_dir)))


@register(
    "a08_adaptive_ece",
    f"WITH {PREDS}, r AS (SELECT conf, {HIT} AS hit, (row_number() OVER (ORDER BY conf, {', '.join(KEY)}) - 1) // greatest(1, (SELECT count(*) FROM preds) // 15) AS bin FROM preds), b AS (SELECT bin, count(*) AS n, avg(conf) - avg(hit) AS gap FROM r GROUP BY bin) SELECT count(*) AS chunks, round(sum(n * abs(gap)) / sum(n), 9) AS ece FROM b",
)
def adaptive_ece(spark, sf_dir):
    return C.adaptive_error(preds(spark, sf_dir), *KEY)


@register("a11_ece_by_class", f"WITH {PREDS}, {BINS.format(by='label,', n=15)} SELECT {ERRORS.format(by='label,')} FROM bins GROUP BY label")
def ece_by_class(spark, sf_dir):
    return C.errors(C.bins(preds(spark, sf_dir), 15, ("label",)), "label")


@register("a11_ece_by_subgroup", f"WITH {PREDS}, {BINS.format(by='subgroup,', n=15)} SELECT {ERRORS.format(by='subgroup,')} FROM bins GROUP BY subgroup")
def ece_by_subgroup(spark, sf_dir):
    return C.errors(C.bins(preds(spark, sf_dir), 15, ("subgroup",)), "subgroup")


@register("a12_calibration_report", f"WITH {PREDS}, {BINS.format(by='', n=15)}, e AS (SELECT {ERRORS.format(by='')} FROM bins) SELECT *, CASE WHEN ece <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict, (SELECT count(*) FROM bins) AS filled_bins FROM e")
def calibration_report(spark, sf_dir):
    b = C.bins(preds(spark, sf_dir))
    filled = b.agg(F.count("*").alias("filled_bins"))
    return C.errors(b).withColumn("verdict", F.when(F.col("ece") <= 0.05, "PASS").otherwise("FAIL")).crossJoin(F.broadcast(filled))


@register(
    "a13_epoch_warnings",
    f"""WITH {PREDS}, e AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS epoch, round(avg(abs(conf - label)), 9) AS err FROM preds GROUP BY ALL),
    l AS (SELECT *, lag(err, 1) OVER (ORDER BY epoch) AS a, lag(err, 2) OVER (ORDER BY epoch) AS b FROM e) SELECT epoch, err, coalesce(err > a AND a > b, false) AS warned FROM l""",
)
def epoch_warnings(spark, sf_dir):
    epoch = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    e = preds(spark, sf_dir).groupBy(epoch.cast("long").alias("epoch")).agg(F.round(F.avg(F.abs(F.col("conf") - F.col("label"))), 9).alias("err"))
    w = Window.orderBy("epoch")  # one row for each epoch
    a, b = F.lag("err", 1).over(w), F.lag("err", 2).over(w)
    return e.select("epoch", "err", F.coalesce((F.col("err") > a) & (a > b), F.lit(False)).alias("warned"))


MAP = """m AS (SELECT l_partkey AS sample_id, round(avg(conf), 9) AS confidence, round(stddev_pop(conf), 9) AS variability, round(avg((pred = label)::INT), 9) AS correctness FROM preds GROUP BY l_partkey),
s AS (SELECT *, round(0.4::DOUBLE * confidence + 0.3::DOUBLE * (1 - variability) + 0.3::DOUBLE * correctness, 10) AS score,
 CASE WHEN confidence >= 0.7 AND variability <= 0.2 THEN 'easy' WHEN confidence <= 0.4 AND variability <= 0.2 THEN 'hard' WHEN variability > 0.2 THEN 'ambiguous' ELSE 'medium' END AS region FROM m)"""


def dataset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = preds(spark, sf_dir).groupBy(F.col("l_partkey").alias("sample_id")).agg(
        F.round(F.avg("conf"), 9).alias("confidence"), F.round(F.stddev_pop("conf"), 9).alias("variability"), F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 9).alias("correctness")
    )
    c, v = F.col("confidence"), F.col("variability")
    region = F.when((c >= 0.7) & (v <= 0.2), "easy").when((c <= 0.4) & (v <= 0.2), "hard").when(v > 0.2, "ambiguous").otherwise("medium")
    return m.withColumn("score", F.round(0.4 * c + 0.3 * (1 - v) + 0.3 * F.col("correctness"), 10)).withColumn("region", region)


register("a14_dataset_map", f"WITH {PREDS}, {MAP} SELECT * FROM s")(dataset_map)


@register(
    "a15_dataset_report",
    f"WITH {PREDS}, {MAP} SELECT region, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.75), 9) AS p75, min(score) AS lo, max(score) AS hi FROM s GROUP BY region",
)
def dataset_report(spark, sf_dir):
    q = [F.round(F.percentile("score", F.lit(p)), 9).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return dataset_map(spark, sf_dir).groupBy("region").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("sd"), *q, F.min("score").alias("lo"), F.max("score").alias("hi")
    )


@register(
    "a16_class_weights",
    """WITH c AS (SELECT label AS class, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT class, n, (SELECT sum(n) FROM c)::DOUBLE / (12 * n) AS raw FROM c), k AS (SELECT avg(raw) AS m FROM w)
    SELECT i::INT AS class, coalesce(n, 0) AS n, round(coalesce(raw / m, 1.0::DOUBLE), 9) AS weight FROM range(12) r(i) LEFT JOIN w ON class = i CROSS JOIN k""",
)
def class_weights(spark, sf_dir, classes: int = 12):
    """Inverse frequency, with mean 1 over the classes that occur; a class without rows has weight 1."""
    c = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("label").cast("int").alias("class")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    w = c.crossJoin(F.broadcast(total)).withColumn("raw", F.col("total") / (classes * F.col("n")))
    mean = w.agg(F.avg("raw").alias("m"))
    every = spark.range(classes).select(F.col("id").cast("int").alias("class"))
    return every.join(w, "class", "left").crossJoin(F.broadcast(mean)).select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce(F.col("raw") / F.col("m"), F.lit(1.0)), 9).alias("weight"))


@register(
    "q01_prune_lowest",
    f"WITH {PREDS}, {MAP}, r AS (SELECT *, row_number() OVER (ORDER BY score, sample_id) AS rn FROM s) SELECT sample_id, score, region FROM r WHERE rn <= (SELECT count(*) FROM s) // 10 OR region = 'hard'",
)
def prune_lowest(spark, sf_dir):
    """The tenth of lowest score, and what its region says to prune."""
    from riskloom.functions.ranking import numbered

    m = dataset_map(spark, sf_dir)
    ranked = numbered(m, "score", "sample_id")
    n = ranked.agg(F.floor(F.count("*") / 10).alias("most"))
    return ranked.crossJoin(F.broadcast(n)).where("rn <= most or region = 'hard'").select("sample_id", "score", "region")


@register("q02_top_priority", f"WITH {PREDS}, {MAP} SELECT sample_id, score, region FROM s ORDER BY score DESC, sample_id LIMIT 50")
def top_priority(spark, sf_dir):
    return dataset_map(spark, sf_dir).select("sample_id", "score", "region").orderBy(F.desc("score"), "sample_id").limit(50)


@register(
    "q04_stratified_cap",
    "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('1337|' || doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= 25",
)
def stratified_cap(spark, sf_dir, most: int = 25, seed: int = 1337):
    """At most `most` rows of each stratum, by a seeded hash.

    A stratum may hold a third of all rows, so it isn't ranked in one task: each hash bucket is ranked by
    itself and the first `most` of each bucket are ranked again.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "doc_id", F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string"))).alias("h"))
    first = Window.partitionBy("lang", "bucket").orderBy("h", "doc_id")
    some = d.withColumn("bucket", F.substring("h", 1, 2)).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= most)
    return some.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rn") <= most).select("lang", "doc_id")


@register(
    "q05_balanced_sample",
    """WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('7|' || doc_id::VARCHAR), doc_id) AS rn FROM labels), k AS (SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM labels)
    SELECT doc_id, toxic FROM r, k WHERE rn <= CASE WHEN toxic = 1 THEN least(p, greatest(50, 100 - n)) ELSE least(n, greatest(50, 100 - p)) END""",
)
def balanced_sample(spark, sf_dir, size: int = 100, seed: int = 7):
    """Half of either label; what one lacks the other fills."""
    d = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic", F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string"))).alias("h"))
    k = d.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n"))
    some = d.withColumn("rn", F.row_number().over(Window.partitionBy("toxic", F.substring("h", 1, 2)).orderBy("h", "doc_id"))).where(F.col("rn") <= size)
    ranked = some.withColumn("rn", F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))).crossJoin(F.broadcast(k))
    half = size // 2
    room = F.when(F.col("toxic") == 1, F.least(F.col("p"), F.greatest(F.lit(half), size - F.col("n")))).otherwise(F.least(F.col("n"), F.greatest(F.lit(half), size - F.col("p"))))
    return ranked.where(F.col("rn") <= room).select("doc_id", "toxic")


@register(
    "q07_group_split",
    """WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('123|' || source), source) - 1 AS rn, count(*) OVER () AS n FROM g),
    s AS (SELECT source, CASE WHEN rn < (n * 0.6::DOUBLE)::DOUBLE // 1 THEN 'train' WHEN rn < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)
    SELECT split, count(*) AS n_docs, count(DISTINCT d.source) AS n_groups FROM documents d JOIN s USING (source) GROUP BY split""",
)
def group_split(spark, sf_dir, seed: int = 123, ratios: tuple[float, float] = (0.6, 0.2)):
    """Splits by group, so that no group is in two of them."""
    from riskloom.functions.ranking import numbered

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    g = d.select("source").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("source"))))
    n = g.agg(F.count("*").alias("n"))
    r = numbered(g, "h", "source").crossJoin(F.broadcast(n))
    first, second = F.floor(F.col("n") * ratios[0]), F.floor(F.col("n") * ratios[0]) + F.floor(F.col("n") * ratios[1])
    s = r.select("source", F.when(F.col("rn") - 1 < first, "train").when(F.col("rn") - 1 < second, "val").otherwise("test").alias("split"))
    return d.join(s, "source").groupBy("split").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_groups"))
