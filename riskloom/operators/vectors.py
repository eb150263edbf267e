"""Prototypes of classes and scores against them, over vectors(id, v ARRAY, class)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector over its length, as doubles."""
    d = F.transform(v, lambda x: x.cast("double"))
    return F.transform(d, lambda x: x / F.sqrt(dot(d, d)))


def prototypes(vectors: DataFrame, width: int, cls: str = "class") -> DataFrame:
    """Per class the normalised mean of normalised vectors, the mean distance (radius), its deviation and size.

    The mean is an average per element in one aggregate: partial sums of `width` numbers per class are all
    that is shuffled.
    """
    unit = vectors.select(cls, normalised(F.col("v")).alias("u"))
    mean = unit.groupBy(cls).agg(F.array(*[F.avg(F.col("u")[i]) for i in range(width)]).alias("m"), F.count("*").alias("n"))
    centre = mean.select(cls, "n", normalised(F.col("m")).alias("centroid"))
    far = unit.join(F.broadcast(centre), cls).select(cls, (1 - dot(F.col("u"), F.col("centroid"))).alias("d"))  # classes are few by definition
    spread = far.groupBy(cls).agg(F.avg("d").alias("radius"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"))
    return centre.join(spread, cls)


def scored(vectors: DataFrame, centres: DataFrame, cls: str = "class") -> DataFrame:
    """Each vector's nearest class, its distance and its softmax share at temperature 0.07."""
    table = F.broadcast(centres.agg(F.sort_array(F.collect_list(F.struct(cls, "centroid", "radius", "sd"))).alias("centres")))
    unit = vectors.select("id", cls, normalised(F.col("v")).alias("u")).crossJoin(table)
    near = unit.select("id", cls, F.transform("centres", lambda c: F.struct(dot(F.col("u"), c["centroid"]).alias("sim"), (-c[cls]).alias("order"), c[cls].alias("near"), c["radius"].alias("radius"), c["sd"].alias("sd"))).alias("s"))
    best = F.array_max("s")
    total = F.aggregate(F.transform("s", lambda x: F.exp((x["sim"] - best["sim"]) / 0.07)), F.lit(0.0), lambda a, x: a + x)
    return near.select("id", F.col(cls).alias("own"), best["near"].alias("nearest"), (1 - best["sim"]).alias("distance"), (1 / total).alias("share"), best["radius"].alias("radius"), best["sd"].alias("sd"))
