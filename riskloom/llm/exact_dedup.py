"""Operator 6: exact duplicates by deterministic block naming.

The normalised text (white space deleted) is cut into blocks of fixed size.  The distinct blocks are
sorted into integer names, then adjacent pairs of names are named the same way, again and again,
until each document has one name.  Two documents share a name exactly when their texts are equal:
names come from sorting the blocks themselves, not from hashes.

A document whose (length, 64-bit checksum) no other has is its own class and takes no part in the
naming; equal texts always share both, so no class is lost.  Documents with one name left leave the
rounds, so the rounds halve.  Names are written to the shared folder before they are joined, so a
lost executor can't give a block another name.  A hot block's rows are counted before the shuffle
and its join is a skew join of narrow rows.

Null text is the empty text.  All empty texts are one class.  Rows that repeat an id and normalised text each
count in group_size; of them those stay that have as many code points as the keeper.
Documents with a null id_ count in their group; one stays only where the group has no other row
with as many code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import saved, table

#: Characters of a block.
BLOCK = 4096
#: Fixed: white space that is deleted.
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _named(rows: DataFrame, *value: str) -> DataFrame:
    """rows with the name of their value: its place among the sorted distinct values."""
    # Equal values fall into one range; blocks with one head (boilerplate) fall into many.
    order = [F.substring(value[0], 1, 64), F.xxhash64(value[0])] if len(value) == 1 else list(value)
    names = rows.select(*value).distinct().repartitionByRange(*order).sortWithinPartitions(*order, *value).withColumn("name", F.monotonically_increasing_id())
    return rows.join(saved(names), list(value)).drop(*value)


def identities(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, level, name) of rows(key, text): equal (level, name) exactly for equal texts.

    key must be unique.  The level is the number of pair rounds that a text of this length takes.
    """
    last = F.greatest(F.ceil(F.length("text") / F.lit(block)).cast("int") - 1, F.lit(0))
    cut = rows.select("key", "text", F.explode(F.sequence(F.lit(0), last)).alias("place"), (last + 1).alias("blocks"))
    cut = cut.select("key", "place", "blocks", F.substring("text", F.col("place") * block + 1, F.lit(block)).alias("value"))
    left = saved(_named(cut, "value"))
    done, level = left.where("blocks = 1").select("key", F.lit(0).alias("level"), "name"), 0
    left = left.where("blocks > 1")
    while not left.isEmpty():
        level += 1
        pair = left.groupBy("key", F.floor(F.col("place") / 2).cast("int").alias("at"), F.ceil(F.col("blocks") / 2).cast("int").alias("blocks")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        left = saved(_named(pair.withColumnRenamed("at", "place"), "a", "b"))
        done = done.unionAll(left.where("blocks = 1").select("key", F.lit(level).alias("level"), "name"))
        left = left.where("blocks > 1")
    return done


def exact_groups(docs: DataFrame, text: str = "text", id_: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """id_, keep_id, group_size, kept and text_sha256 of every row of docs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = normalised(F.col(text))
    rows = docs.select(
        F.col(id_).alias("id"), F.length(whole).alias("points"), F.octet_length(plain).alias("size"), F.xxhash64(plain).alias("sum"), F.sha2(plain, 256).alias("text_sha256")
    )
    rows = saved(rows)
    # One row for each (id, size, checksum): rows that repeat a document are told apart by nothing.
    shared = rows.groupBy("size", "sum").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    asked = saved(rows.join(shared, ["size", "sum"], "left_semi").groupBy("id", "size", "sum").agg(F.count("*").alias("n"), F.max("points").alias("points")))
    key = F.struct("id", "size", "sum")
    texts = docs.select(F.col(id_).alias("id"), plain.alias("text")).withColumns({"size": F.octet_length("text"), "sum": F.xxhash64("text")})
    texts = texts.join(asked.select(F.col("id").alias("i"), F.col("size").alias("s"), F.col("sum").alias("c")), F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("s")) & (F.col("sum") == F.col("c")))
    # Equal ids with equal checksums must hold equal texts, else they'd be one key for two texts.
    texts = texts.groupBy(key.alias("key"), "text").agg(F.count("*").alias("rows"))
    texts = texts.select(F.struct("key", F.xxhash64(F.lit(1), "text")).alias("key"), "text")
    named = identities(saved(texts), block)  # the candidates only: the other texts aren't moved again
    class_of = named.select(F.col("key.key.id").alias("id"), F.col("key.key.size").alias("size"), F.col("key.key.sum").alias("sum"), F.struct("level", "name").alias("class"))
    member = saved(
        class_of.alias("c").join(asked.alias("a"), F.expr("c.id <=> a.id and c.size = a.size and c.sum = a.sum")).select("a.id", "a.size", "a.sum", "a.n", "a.points", "c.class")
    )
    keeper = member.groupBy("class").agg(F.min(F.struct((-F.col("points")).alias("fewer"), F.col("id").isNull().alias("last"), F.col("id"))).alias("k"), F.sum("n").alias("group_size"))
    told = member.join(keeper, "class").select(F.col("id").alias("i"), F.col("size").alias("s"), F.col("sum").alias("c"), F.col("k.id").alias("keep"), (-F.col("k.fewer")).alias("longest"), "group_size", F.lit(True).alias("grouped"))
    out = rows.join(told, F.expr("id <=> i and size = s and sum = c"), "left")
    keep = F.when(F.col("grouped"), F.col("keep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (keep.eqNullSafe(F.col("id")) & (F.col("points") == F.coalesce("longest", "points"))).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS plain FROM d),
k AS (SELECT plain, first(doc_id ORDER BY points DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM n JOIN k USING (plain)
"""
