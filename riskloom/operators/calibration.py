"""Calibration of predictions(conf, label, pred): confusion, Brier score and the calibration errors.

Two definitions of the expected calibration error stay apart: `label_rate_error` compares a bin's mean
confidence with its share of positive labels, `bins` and what follows from it with its accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ranking import numbered


def bin_of(conf: Column, n: int) -> Column:
    """Bins [lo, hi) of equal width over 0 to 1, the last one closed."""
    return F.least(F.floor(conf * n), F.lit(n - 1)).cast("int")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(preds: DataFrame, *by: str) -> DataFrame:
    """Counts and rates; rates are 0 where nothing is counted."""
    y, p = F.col("label") == 1, F.col("pred") == 1
    out = preds.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y).alias("positives"), F.count_if(p).alias("predicted"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"),
    )
    return out.withColumns({
        "accuracy": F.round(ratio(F.col("tp") + F.col("tn"), F.col("n")), 9), "precision": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 9),
        "recall": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 9),
    })


def brier(preds: DataFrame) -> DataFrame:
    return preds.agg(F.round(F.avg(F.pow(F.col("conf") - F.col("label"), 2)), 9).alias("brier"))


def label_rate_error(preds: DataFrame, n: int = 10) -> DataFrame:
    b = preds.groupBy(bin_of(F.col("conf"), n).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("label").alias("rate"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("rate"))) / F.sum("n"), 9).alias("ece"))


def bins(preds: DataFrame, n: int = 15, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each bin with rows: size, mean confidence, accuracy and gap (confidence - accuracy)."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf")))
    hit = (F.col("pred") == F.col("label")).cast("int")
    b = preds.groupBy(*by, bin_of(conf, n).alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("conf"), F.avg(hit).alias("accuracy"))
    return b.withColumn("gap", F.col("conf") - F.col("accuracy"))


def all_bins(preds: DataFrame, n: int = 15) -> DataFrame:
    """Every bin, the empty ones with zeros."""
    every = preds.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    out = every.join(bins(preds, n), "bin", "left").na.fill(0)
    return out.select("bin", F.round(F.col("bin") / n, 9).alias("lo"), F.round((F.col("bin") + 1) / n, 9).alias("hi"), "n", *[F.round(c, 9).alias(c) for c in ("conf", "accuracy", "gap")])


def errors(binned: DataFrame, *by: str, over_weight: float = 2.0) -> DataFrame:
    """The errors that follow from bins: expected, largest, root mean square, over- and underconfident parts."""
    size, gap = F.sum("n"), F.abs(F.col("gap"))
    over = F.col("gap") > 0
    out = binned.groupBy(*by).agg(
        size.alias("n"), (F.sum(F.col("n") * gap) / size).alias("ece"), F.max(gap).alias("mce"), F.sqrt(F.sum(F.col("n") * gap * gap) / size).alias("l2"),
        (F.sum(F.when(over, F.col("n") * gap).otherwise(0.0)) / size).alias("over"), (F.sum(F.when(~over, F.col("n") * gap).otherwise(0.0)) / size).alias("under"),
        (F.sum(F.when(over, F.col("n")).otherwise(0)) / size).alias("over_share"), (F.sum(F.col("n") * gap * F.when(over, over_weight).otherwise(1.0)) / size).alias("security"),
    )
    return out.select(*by, "n", *[F.round(c, 9).alias(c) for c in ("ece", "mce", "l2", "over", "under", "over_share", "security")])


def adaptive_error(preds: DataFrame, *order: str, n: int = 15) -> DataFrame:
    """Chunks of max(1, rows // n) in the order of confidence; the remainder is a chunk more."""
    rows = preds.count()
    size = max(1, rows // n)
    ranked = numbered(preds, "conf", *order)
    chunk = ranked.groupBy(F.floor((F.col("rn") - 1) / size).alias("bin")).agg(F.count("*").alias("n"), (F.avg("conf") - F.avg((F.col("pred") == F.col("label")).cast("int"))).alias("gap"))
    return chunk.agg(F.count("*").alias("chunks"), F.round(F.sum(F.col("n") * F.abs("gap")) / F.sum("n"), 9).alias("ece"))
