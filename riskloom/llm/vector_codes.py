"""Operator 12: compression of vectors to codes, by Elkan's version of Lloyd's iteration.

A vector's components become integers and are cut into equal parts; each part position has a codebook, and a part is
coded as the index of its nearest entry.  The codebooks are fitted by rounds of assigning every part and
moving every entry to the floor of the mean of its parts.

Between rounds the table keeps, for every part, an upper bound of the distance to its entry and one lower bound for
each entry.  When entries have moved, the upper bound grows by its entry's way and the lower bounds shrink by
theirs; an entry is left out only if its lower bound, or half its distance from the assigned entry, is
strictly above the upper bound.  What is left is measured in integers, so ties go to the lower index, as in full search.

A lower bound is one byte: whole steps of a width that the part sets in the first round, rounded down.  Entries' ways
are added up since the first round, and a byte holds the distance plus the way so far, so it is written
anew only where its distance is measured anew.

Rows with a null vector or with null or non-finite components are dropped, and so are empty vectors and those of another
length than the kept vector with the smallest id; lengths that can't be cut and components beyond 2^26 after scaling
raise an error.  Null ids come last; rows that repeat an id are ordered by their vectors, and all of them count.
With fewer vectors than entries the codebooks are as short.  An empty table gives no rows.  Null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from riskloom.llm.common import bounded_batches, dropped, new_folder, saved, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest component after scaling: squared distances of a part then fit a long.
LARGEST = 1 << 26
#: Pairs of a part and an entry that are measured at once, steps of a bound from the mean distance down, and labels whose sums are broadcast.
PAIRS, STEPS, LABELS = 1 << 16, 8, 100_000
#: Beyond rounding errors of the bounds.
SLACK = 1 + 1e-9


class Books:
    """The codebooks, the ways of their entries in the last round and since the first, and half the distances between entries."""

    def __init__(self, entries: np.ndarray, before: Books | None = None):
        self.entries = entries  # part, entry, position
        self.way = np.sqrt(((entries - before.entries) ** 2).sum(2)) * SLACK if before else np.zeros(entries.shape[:2])
        self.ways = before.ways + self.way * SLACK if before else self.way
        self.half = np.stack([np.sqrt(_squared(e, e)) / SLACK / 2 for e in entries]) if before else None

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of c."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 8 * x.shape[1] * int(largest) ** 2 < 1 << 53:  # floats hold such integers exactly
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


def _between(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from the rows of c beside them."""
    return np.concatenate([((x[i : i + PAIRS] - c[i : i + PAIRS]) ** 2).sum(1) for i in range(0, len(x), PAIRS)]) if len(x) else np.zeros(0, np.int64)


def _steps(bound: np.ndarray, step: np.ndarray) -> np.ndarray:
    """bound in whole steps, rounded down, 255 at most."""
    with np.errstate(divide="ignore", invalid="ignore"):
        n = np.where(step > 0, np.floor(bound / SLACK / step), 0)
    return np.clip(n, 0, 255).astype(np.uint8)


def first_round(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, ...]:
    """(assigned, upper, lower, step, tried) of parts x: all distances are measured."""
    squared = _squared(x, entries)
    own = squared.argmin(1)
    each = np.sqrt(squared)
    step = (each.mean(1) / STEPS).astype(np.float32)
    upper = each[np.arange(len(x)), own] * SLACK
    return own, upper, _steps(each, step[:, None].astype(np.float64)), step, np.full(len(x), len(entries))


def next_round(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: np.ndarray, books: Books, part: int) -> tuple[np.ndarray, ...]:
    """(assigned, upper, lower, tried) after the entries have moved."""
    entries, ways, half = books.entries[part], books.ways[part], books.half[part]
    upper = upper * SLACK + books.way[part][own]
    step = step.astype(np.float64)
    tried = np.zeros(len(x), np.int64)

    def open_(rows: np.ndarray) -> np.ndarray:
        most = upper[rows, None] * SLACK
        out = ~((lower[rows] * step[rows, None] / SLACK - ways > most) | (half[own[rows]] > most))
        out[np.arange(len(rows)), own[rows]] = False
        return out

    rows = np.arange(len(x))
    rows = rows[open_(rows).any(1)]
    squared = _between(x[rows], entries[own[rows]])  # the upper bound of these is measured before anything else
    tried[rows] += 1
    upper[rows] = np.sqrt(squared) * SLACK
    left = open_(rows)
    some = left.any(1)
    rows, left, squared = rows[some], left[some], squared[some]
    at, entry = np.nonzero(left)
    found = np.full(left.shape, np.iinfo(np.int64).max)
    found[at, entry] = measured = _between(x[rows[at]], entries[entry])
    found[np.arange(len(rows)), own[rows]] = squared
    tried[rows] += left.sum(1)
    lower = lower.copy()
    lower[rows[at], entry] = _steps(np.sqrt(measured) + ways[entry], step[rows[at]])
    lower[rows, own[rows]] = _steps(np.sqrt(squared) + ways[own[rows]], step[rows])
    own = own.copy()
    own[rows] = found.argmin(1)  # the first of equal ones
    upper[rows] = np.sqrt(found.min(1)) * SLACK if len(rows) else 0
    return own, upper, lower, tried


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """A column of equal binary values or lists as rows of an array."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)
    return np.asarray(column.flatten()).astype(dtype).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _pass(rows: DataFrame, books: Books, last: bool) -> DataFrame:
    """rows after one assignment: with their bounds, or after the last one with code and error."""
    parts, entries, width = books.entries.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries integers, whatever the corpus holds
    begun = "own" in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("v"), np.int64, parts * width).reshape(-1, parts, width)
            n = len(x)
            own, upper, lower, step, tried = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts, entries), np.uint8), np.zeros((n, parts), np.float32), np.zeros(n, np.int64)
            if begun:
                own[:], upper[:], step[:] = _matrix(batch.column("own"), np.uint8, parts), _matrix(batch.column("upper"), np.float64, parts), _matrix(batch.column("step"), np.float32, parts)
                lower[:], tried[:] = _matrix(batch.column("lower"), np.uint8, parts * entries).reshape(lower.shape), np.asarray(batch.column("tried"))
            for p in range(parts):
                if begun:
                    own[:, p], upper[:, p], lower[:, p], more = next_round(x[:, p], own[:, p], upper[:, p], lower[:, p], step[:, p], books, p)
                else:
                    own[:, p], upper[:, p], lower[:, p], step[:, p], more = first_round(x[:, p], books.entries[p])
                tried += more
            if last:
                error = sum(_between(x[:, p], books.entries[p][own[:, p]]) for p in range(parts))
                code = pa.array([r.tobytes().hex() for r in own.astype(np.uint8)])
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), code, pa.array(error), pa.array(tried)], names=["_id", "_label", "code", "error", "tried"])
            else:
                made = [_binary(own.astype(np.uint8)), _binary(upper), _binary(step), _binary(lower.reshape(n, -1)), pa.array(tried)]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), batch.column("v"), *made], names=["_id", "_label", "v", "own", "upper", "step", "lower", "tried"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    told = "code string, error long, tried long" if last else "v array<int>, own binary, upper binary, step binary, lower binary, tried long"
    return rows.mapInArrow(assign, f"_id {kinds['_id']}, _label {kinds['_label']}, {told}")


def _moved(state: DataFrame, books: Books) -> Books:
    """The books after every entry has moved to the floor of the mean of its parts; the driver gets a row for each entry."""
    parts, entries, width = books.entries.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), np.int64, parts * width).reshape(-1, width)
            at = (_matrix(batch.column("own"), np.uint8, parts).astype(np.int64) + np.arange(parts) * entries).ravel()
            count += np.bincount(at, minlength=parts * entries)
            np.add.at(sums, at, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    each = state.select("v", "own").mapInArrow(summed, "entry long, n long, sums array<long>")
    total = each.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = books.entries.reshape(-1, width).copy()
    for r in total.collect():
        out[r["entry"]] = [s // r["n"] for s in r["sums"]]
    return Books(out.reshape(books.entries.shape), books)


def _kept(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", id_: str = "vec_id", label: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(id_, code, error, label_error, codebooks_sha256, tried) of every kept row of vectors, and the codebooks.

    tried: distances that were measured for the row over all rounds, of (rounds + 1) * parts * entries.
    entries: 256 at most, so that an index is a byte.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits: from 1 to 256 entries")
    floor = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(_kept(F.col(vector))).select(F.col(id_).alias("_id"), F.col(label).alias("_label"), floor.alias("v"))
    wide = F.exists("v", lambda x: (x > LARGEST) | (x < -LARGEST))
    rows = rows.withColumn("v", F.when(wide, F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).otherwise(F.col("v").cast("array<int>")))
    order = [F.col("_id").asc_nulls_last(), F.col("v")]
    head = rows.orderBy(*order).limit(1).collect()
    size = len(head[0]["v"]) if head else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == size)
    first = np.array([r["v"] for r in rows.orderBy(*order).limit(entries).collect()], np.int64).reshape(-1, parts, size // parts)
    books = Books(np.ascontiguousarray(first.transpose(1, 0, 2)))
    state, folder = rows, None
    for _ in range(rounds if len(first) else 0):
        to = new_folder(spark, "bounds")
        _pass(state, books, False).write.option("compression", "zstd").parquet(to)
        if folder:
            dropped(spark, folder)
        folder = to
        state = spark.read.parquet(folder)
        books = _moved(state, books)
    out = saved(_pass(state, books, True)) if len(first) else rows.select("_id", "_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("tried"))
    if folder:
        dropped(spark, folder)
    sums = out.groupBy(F.col("_label").alias("l")).agg(F.sum("error").alias("label_error"))
    if sums.limit(LABELS + 1).count() <= LABELS:
        sums = F.broadcast(sums)
    told = out.join(sums, F.col("_label").eqNullSafe(F.col("l")))
    columns = F.col("_id").alias(id_), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), "tried"
    return told.select(*columns), books.entries


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))[0].drop("tried")


def _op12_sql() -> str:
    """The same by full search: one query for the first codebooks, then two for each round."""
    nearest = "SELECT rn, part, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (SELECT rn, part, e, sum((x - c) * (x - c))::BIGINT AS d FROM p JOIN c{0} USING (part, i) GROUP BY rn, part, e) GROUP BY rn, part"
    moved = "SELECT part, e, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{0} LEFT JOIN (SELECT part, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM p JOIN a{0} USING (rn, part) GROUP BY part, e, i) USING (part, e, i)"
    steps = [f"a{k} AS MATERIALIZED ({nearest.format(k)}),\nc{k + 1} AS MATERIALIZED ({moved.format(k)})" for k in range(ROUNDS)]
    return rf"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rn FROM k),
u AS (SELECT rn, unnest(v) AS x, unnest(range(len(v))) AS pos, len(v) // {PARTS} AS w FROM r),
p AS MATERIALIZED (SELECT rn, pos // w AS part, pos % w AS i, x FROM u),
c0 AS MATERIALIZED (SELECT part, rn - 1 AS e, i, x AS c FROM p WHERE rn <= {ENTRIES}),
{",\n".join(steps)},
f AS MATERIALIZED ({nearest.format(ROUNDS)}),
b AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM c{ROUNDS}),
g AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY rn)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN g USING (rn) CROSS JOIN b
"""


OP12_SQL = _op12_sql()
