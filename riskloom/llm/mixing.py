"""Operator 4: mixing sources to target weights by min-cost flow.

Documents are aggregated by their membership pattern (the set of sources that they belong to).  A
network leads from each pattern to its sources and from each source to the sink: a pattern's tokens
can be used up to `most` times, the k-th use costing k a token, so the least cost repeats as little
as possible; a source takes its quota.  The flow tells how often each pattern's tokens are used.

Of a pattern with flow f and size s every document is taken floor(f / s) times; the rest goes to
documents in the order of a seeded hash, skipping those that don't fit.  The order is cut without
sorting a source: sizes are summed by hash bucket, the sums of the buckets find the bucket in which
the rest runs out, and only that bucket is sorted.  Of the documents after the one that didn't fit,
those that still fit are cut again, until none is left.  Documents are taken whole.

The driver sees sums by pattern: as many rows as there are patterns (checked against `patterns`).

Null text has size 0.  A null source is a source of its own, the last, and so is a null array of sources.  Documents of size 0 have
taken 0.  Sources of size 0 have target 0.  Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import saved, table

#: Fixed: weights of the sources in their order, repeating; uses of a document at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Hash buckets of a pattern (as many hex digits), and patterns at most.
DIGITS, PATTERNS = 4, 100_000
#: Documents of a pattern that one task goes through, at most.
FOLD = 1_000_000
SEED = "mix"


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the total by weight, none above most times its size; the excess is reshared by weight."""
    total, free = sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    out = [0.0] * len(sizes)
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
            free.remove(i)
    return out


class Network:
    """Arcs with capacities and costs; flow by successive shortest paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, tail: int, head: int, capacity: int, cost: int) -> int:
        """The arc's number; the next number is its way back."""
        for a, b, room, price in ((tail, head, capacity, cost), (head, tail, 0, -cost)):
            self.out[a].append(len(self.head))
            self.head.append(b)
            self.left.append(room)
            self.cost.append(price)
        return len(self.head) - 2

    def fill(self, source: int, sink: int) -> None:
        while True:
            far, via, queue = {source: 0}, {}, deque([source])
            waiting = {source}
            while queue:
                node = queue.popleft()
                waiting.discard(node)
                for arc in self.out[node]:
                    reach = far[node] + self.cost[arc]
                    if self.left[arc] > 0 and reach < far.get(self.head[arc], reach + 1):
                        far[self.head[arc]], via[self.head[arc]] = reach, arc
                        if self.head[arc] not in waiting:
                            waiting.add(self.head[arc])
                            queue.append(self.head[arc])
            if sink not in via:
                return
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.head[via[node] ^ 1]
            room = min(self.left[arc] for arc in path)
            for arc in path:
                self.left[arc] -= room
                self.left[arc ^ 1] += room


def least_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], most: int = MOST) -> list[int]:
    """Tokens that the quotas take of each pattern, the k-th use of a token costing k."""
    n = len(supply)
    net = Network(n + len(quota) + 2)
    source, sink = n + len(quota), n + len(quota) + 1
    uses = [[net.arc(source, p, supply[p], k) for k in range(1, most + 1)] for p in range(n)]
    for p, own in enumerate(members):
        for s in own:
            net.arc(p, n + s, most * supply[p], 0)
    for s, q in enumerate(quota):
        net.arc(n + s, sink, q, 0)
    net.fill(source, sink)
    return [sum(net.left[arc ^ 1] for arc in arcs) for arcs in uses]


def size_of(text: Column) -> Column:
    """Runs of characters other than the six kinds of white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash(seed: str, *columns: str) -> Column:
    return F.md5(F.concat(F.lit(seed), *[F.concat(F.lit("|"), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]).cast("binary"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, text: str = "text", id_: str = "doc_id", source: str = "source") -> DataFrame:
    """id_, size, source_size, target and taken of every row of docs.

    source: a column of one source or of an array of sources; of several, source_size and target are
    the sums over the document's sources.
    """
    spark = docs.sparkSession
    several = isinstance(docs.schema[source].dataType, T.ArrayType)
    # A null array is a document without any named source, as a null source is.
    pattern = F.coalesce(F.array_sort(F.array_distinct(F.col(source))), F.array(F.lit(None))) if several else F.array(F.col(source))
    rows = docs.select(F.col(id_).alias("id"), size_of(F.col(text)).alias("size"), pattern.alias("pattern"))
    rows = saved(rows.withColumn("order", _hash(seed, "id")).withColumn("bucket", F.conv(F.substring("order", 1, DIGITS), 16, 10).cast("int")))
    got = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(PATTERNS + 1).collect()
    if len(got) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    names = sorted({s for r in got for s in r["pattern"]}, key=lambda s: (s is None, 0 if s is None else s))
    place = {s: i for i, s in enumerate(names)}
    members = [[place[s] for s in r["pattern"]] for r in got]
    # A pattern's tokens count for each of its sources when the sources are weighed.
    sizes = [0] * len(names)
    for r, own in zip(got, members, strict=True):
        for s in own:
            sizes[s] += r["size"]
    share = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most) if not several else _overlapping(got, sizes, weights, most)
    flow = least_cost_flow([r["size"] for r in got], members, [round(t) for t in share], most)
    plan = spark.createDataFrame(
        [(r["pattern"], sum(sizes[s] for s in own), float(sum(share[s] for s in own)), f // r["size"] if r["size"] else 0, f % r["size"] if r["size"] else 0) for r, own, f in zip(got, members, flow, strict=True)],
        T.StructType([T.StructField("p", rows.schema["pattern"].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("times", T.LongType()), T.StructField("rest", T.LongType())]),
    )
    plan = F.broadcast(plan)  # a row for each pattern, at most PATTERNS
    out = _first_fit(rows, plan).join(plan, F.col("pattern").eqNullSafe(F.col("p")))
    taken = F.when(F.col("size") > 0, (F.col("times") + F.col("more")) * F.col("size")).otherwise(F.lit(0))
    return out.select(F.col("id").alias(id_), "size", "source_size", "target", taken.cast("long").alias("taken"))


def _overlapping(got: list, sizes: list[int], weights: tuple[float, ...], most: int) -> list[float]:
    """Targets whose sum is the corpus, not the sum of sources that share documents."""
    whole = sum(r["size"] for r in got)
    share = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    return [t * whole / sum(sizes) if sum(sizes) else 0.0 for t in share]


def _prefix(rows: DataFrame, rests: DataFrame) -> DataFrame:
    """rows with more: 1 for a pattern's documents in hash order up to its rest, before the first that doesn't fit."""
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sums.withColumn("upto", F.sum("size").over(before)).join(F.broadcast(rests), F.col("pattern").eqNullSafe(F.col("p")))
    # A bucket is whole if it fits; in the first that doesn't, documents are taken while they fit.
    cut = saved(cut.select("pattern", "bucket", F.when(F.col("upto") <= F.col("rest"), F.lit(-1)).when(F.col("upto") - F.col("size") < F.col("rest"), F.col("rest") - F.col("upto") + F.col("size")).alias("room")).where("room is not null"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = rows.join(F.broadcast(cut.where("room >= 0").withColumnsRenamed({"pattern": "p", "bucket": "b"})), F.col("pattern").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b"))).drop("p", "b")
    parted = parted.withColumn("more", (F.sum("size").over(inside) <= F.col("room")).cast("int")).drop("room")
    whole = rows.join(cut.withColumnsRenamed({"pattern": "p", "bucket": "b"}), F.col("pattern").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b")), "left")
    rest = whole.where("room is null or room < 0").select(*rows.columns, F.coalesce((F.col("room") < 0).cast("int"), F.lit(0)).alias("more"))
    return rest.unionAll(parted.select(*rest.columns))


def _fitted(rows: pa.Table) -> pa.Table:
    """A pattern's documents with more: 1 for each that fits what those before it in hash order have left of the rest."""
    rows = rows.sort_by([("order", "ascending"), ("size", "ascending")])
    rest, more = rows.column("rest")[0].as_py() if len(rows) else 0, []
    for size in rows.column("size").to_pylist():
        more.append(int(size <= rest))
        rest -= size if size <= rest else 0
    return rows.drop(["rest"]).append_column("more", pa.array(more, pa.int32()))


def _first_fit(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with more: 1 for each document that fits what the documents before it in hash order have left of the rest.

    A round takes the prefix up to a document that doesn't fit; no later document as large can fit, and
    the smaller ones are left.  Rows leave once they are decided.  As soon as no pattern has more than FOLD left,
    its rows are gone through in order by one task a pattern; until then rounds go on.
    """
    open_, rests, told = rows, plan.select("p", "rest"), []
    while True:
        cut = saved(_prefix(open_, rests))
        have = cut.where("more = 1").groupBy("pattern").agg(F.sum("size").alias("have"))
        rests = saved(rests.join(have, F.col("p").eqNullSafe(F.col("pattern")), "left").select("p", (F.col("rest") - F.coalesce("have", F.lit(0))).alias("rest")))
        fits = (F.col("more") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
        cut = saved(cut.join(F.broadcast(rests), F.col("pattern").eqNullSafe(F.col("p"))).withColumn("fits", fits).drop("p"))
        told.append(cut.where("not fits").drop("fits", "rest"))
        open_ = cut.where("fits").select(*rows.columns, "rest")
        most = open_.groupBy("pattern").count().agg(F.max("count")).first()[0] or 0
        if most <= FOLD:
            if most:
                told.append(open_.groupBy("pattern").applyInArrow(_fitted, told[0].select(*rows.columns, "more").schema).select(*told[0].columns))
            return reduce(DataFrame.unionAll, told)
        open_ = open_.drop("rest")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS gone, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
sums AS (SELECT gone, s, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY gone, s) - 1) % 3] AS w FROM d GROUP BY gone, s),
pour AS (
  SELECT 0 AS round, gone, s, source_size, w, source_size = 0 AS done, NULL::DOUBLE AS t, (SELECT sum(source_size) FROM sums)::DOUBLE AS pot FROM sums
  UNION ALL
  SELECT round + 1, gone, s, source_size, w, done OR full_now, CASE WHEN full_now THEN (3 * source_size)::DOUBLE ELSE t END, pot - sum(CASE WHEN full_now THEN 3 * source_size ELSE 0 END) OVER ()
  FROM (SELECT *, NOT done AND pot * w / sum(CASE WHEN done THEN 0 ELSE w END) OVER () > 3 * source_size AS full_now FROM pour WHERE round < 40)),
final AS (SELECT gone, s, source_size, CASE WHEN source_size = 0 THEN 0 WHEN done THEN t ELSE pot * w / sum(CASE WHEN done THEN 0 ELSE w END) OVER () END AS target FROM pour WHERE round = 40),
p AS (SELECT d.doc_id, d.gone || d.s AS s, size, h, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE round_even(target, 0)::BIGINT // source_size END AS times, CASE WHEN source_size = 0 THEN 0 ELSE round_even(target, 0)::BIGINT % source_size END AS rest FROM d JOIN final USING (gone, s)),
l AS (SELECT s, list(doc_id ORDER BY h, doc_id, size) AS ids, list(size ORDER BY h, doc_id, size) AS sizes, list_reduce(list({size: size, room: 0::BIGINT, more: []::INT[]} ORDER BY h, doc_id, size),
  lambda a, x: {size: 0::BIGINT, room: a.room - CASE WHEN x.size <= a.room THEN x.size ELSE 0 END, more: list_append(a.more, (x.size <= a.room)::INT)}, {size: 0::BIGINT, room: any_value(rest)::BIGINT, more: []::INT[]}).more AS more FROM p GROUP BY s),
m AS (SELECT s, unnest(ids) AS doc_id, unnest(sizes) AS size, unnest(more) AS more FROM l)
SELECT p.doc_id, p.size, source_size, target, CASE WHEN p.size > 0 THEN (times + more) * p.size ELSE 0 END::BIGINT AS taken FROM p JOIN m ON m.s = p.s AND m.doc_id = p.doc_id
"""
