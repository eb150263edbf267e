"""Operator 5: language-model scores by stupid backoff over n-gram count tables.

A word's score is count(context, word) / count(context) of the longest context, of order - 1 words at most
and within the document, if that n-gram occurs at least `cutoff` times in the corpus; else `alpha` * the
score by the context without its first word; without context it is count(word) / words.  The score of a
document is the sum of the natural logarithms.

1. Texts are dealt into slices of about SLICE bytes and stay there: all passes read one checkpoint that is dealt and sorted by slice.
2. Each slice counts the n-grams of all orders by their 64-bit hash, and sends them in order, a row for each bucket of the hash, as the
   steps from one to the next and their counts.  A hot n-gram comes once from each slice that holds it.
3. A bucket of the count table sums the counts of its n-grams over all slices, and answers each slice with the totals
   by their places among the slice's own in order.  If the corpus is the documents themselves, an n-gram that no other slice holds needs
   no answer: its total is what the slice counts itself.
4. The answers go to their slices, where words are scored and summed by document.

Steps 2 and 3 are done for one range of buckets after the other, and written to the shared folder, so that no more
than a range of the n-grams is on disk at a time; Spark drops the shuffle files of a range once it is written.
Slices come from a hash of the row, so a task that is run again makes the same rows.

Null, empty and wordless texts have score 0 and no words.  Repeated rows are scored each on its own, and
count each in the corpus.  Of another corpus than the documents, a word that it lacks counts as one that
occurs once, so that its score is finite; of an empty corpus every word does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, Spans, bounded_batches, chunks, dropped, joined, mix, new_folder, saved, setting, shuffles_dropped, table, word_spans

ORDER, ALPHA, CUTOFF = 3, 0.4, 1
#: Bytes of text in a slice, and n-grams of slices in a bucket, about; ranges of the buckets.
SLICE, BUCKET, RANGES = 6 << 20, 1 << 19, 4
SENT = "bucket int not null, slice long not null, grams binary not null, times binary not null"
TOLD = "slice long not null, bucket int not null, totals binary not null"


def words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, and the place of each word's text."""
    found, text, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for chunk in column.chunks:
        for part in chunks(pa.RecordBatch.from_arrays([chunk], names=["text"]), "text"):
            data, offsets = joined(part.column("text"))
            data = LOWER[data]
            start, end = word_spans(data)
            found.append(Spans(data).hash(start, end))
            text.append(np.searchsorted(offsets, start, "right") - 1 + n)
            n += len(part)
    return np.concatenate(found), np.concatenate(text)


def grams(word: np.ndarray, text: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: the places at which an n-gram of one text ends, and its hash."""
    at, value, out = np.arange(len(word)), mix(word + np.uint64(1)), []
    for n in range(1, order + 1):
        if n > 1:
            keep = at >= n - 1
            keep[keep] = text[at[keep]] == text[at[keep] - n + 1]
            at, value = at[keep], value[keep]
            value = mix(value * np.uint64(3) + word[at - n + 1] + np.uint64(n))  # one word more in front
        out.append((at, value))
    return out


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _least(bucket: int, buckets: int) -> np.uint64:
    """The least hash of a bucket."""
    return np.uint64(-(-(bucket << 32) // buckets) << 32)


def packed(value: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes as the largest needs: all lowest bytes, then all second ones, and so on."""
    width = max(1, -(-int(value.max()).bit_length() // 8))
    return value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def exploded(texts: DataFrame, order: int, buckets: int, range_: int, counts: bool = True, asks: bool = True) -> DataFrame:
    """SENT of texts(slice, text): the n-grams of a range of the buckets, those of a bucket of a slice in a row.

    counts: whether they count in the corpus.  A slice that asks no totals is sent as -1 - slice.
    """
    first, end = (np.searchsorted(np.arange(buckets) * RANGES // buckets, r) for r in (range_, range_ + 1))

    def count(rows: pa.Table) -> pa.Table:
        least, found = _least(int(first), buckets), []
        for _, value in grams(*words(rows.column("text")), order):
            mine = value >= least
            if end < buckets:
                mine &= value < _least(int(end), buckets)
            found.append(value[mine])
        gram, times = np.unique(np.concatenate(found), return_counts=True)
        times = times.astype(np.uint64) if counts else np.zeros(len(gram), np.uint64)
        slice_ = rows.column("slice")[0].as_py()
        bucket = _bucket(gram, buckets)
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), bool), bucket[1:] != bucket[:-1])))
        cuts = list(zip(bucket[begin].tolist(), begin.tolist(), np.append(begin, len(gram))[1:].tolist(), strict=True))
        return pa.table({
            "bucket": pa.array([b for b, _, _ in cuts], pa.int32()), "slice": np.full(len(cuts), slice_ if asks else -1 - slice_, np.int64),
            "grams": pa.array([n.to_bytes(4, "little") + packed(np.diff(gram[s:e], prepend=_least(b, buckets))) for b, s, e in cuts for n in (e - s,)], pa.binary()),
            "times": pa.array([packed(times[s:e]) for _, s, e in cuts], pa.binary()),
        })

    return texts.groupBy("slice").applyInArrow(count, SENT)


def counted(sent: DataFrame, buckets: int, own: bool) -> DataFrame:
    """TOLD of sent rows: how often each n-gram that a slice asks for occurs in the corpus.

    own: an n-gram that no other slice holds is told as 0.
    """

    def count(rows: pa.Table) -> pa.Table:
        least = _least(rows.column("bucket")[0].as_py(), buckets)
        slices, blobs = rows.column("slice").to_pylist(), rows.column("grams").to_pylist()
        size = [int.from_bytes(g[:4], "little") for g in blobs]
        gram = np.concatenate([np.cumsum(unpacked(g[4:], n), dtype=np.uint64) + least for g, n in zip(blobs, size, strict=True)])
        times = np.concatenate([unpacked(t, n) for t, n in zip(rows.column("times").to_pylist(), size, strict=True)])
        by = np.argsort(gram, kind="stable")
        gram = gram[by]
        begin = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        total = np.empty(len(gram), np.uint64)
        total[by] = np.repeat(np.add.reduceat(times[by], begin), np.diff(np.append(begin, len(gram))))
        if own:
            total[total == times] = 0
        parts = zip(slices, np.split(total, np.cumsum(size)[:-1]), strict=True)
        told = [(s, packed(t)) for s, t in parts if s >= 0 and t.any()]
        return pa.table({"slice": pa.array([s for s, _ in told], pa.int64()), "bucket": pa.array([rows.column("bucket")[0].as_py()] * len(told), pa.int32()), "totals": pa.array([t for _, t in told], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(count, TOLD)


def _sliced(docs: DataFrame, text: str, id_: str) -> tuple[DataFrame, int]:
    """(id, text, slice), dealt and sorted by slice, and bytes of text: rows with equal texts fall into different slices, if their ids differ."""
    spark = docs.sparkSession
    size = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    slices = max(spark.sparkContext.defaultParallelism, size // SLICE + 1)
    rows = docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(slices)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices // 16)
    # A plan that doesn't adapt tells how its checkpoint is dealt and sorted, so that later groupings by slice don't move it.
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        return saved(rows.repartition(parts, "slice").sortWithinPartitions("slice")), size


def score(docs: DataFrame, corpus: DataFrame | None = None, alpha: float = ALPHA, cutoff: int = CUTOFF, order: int = ORDER, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, n_words, score and mean (the score by word; 0 without words) of every row of docs.

    corpus: the rows whose texts are counted; None for docs.  order: words of the longest n-grams.
    cutoff: least count of an n-gram of two words or more to be used.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = corpus is None
    folder = new_folder(spark, "ngrams")

    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"id": pa.nulls(0, rows.schema.field("id").type), "n_words": np.zeros(0, np.int64), "value": np.zeros(0), "bare": np.zeros(0, np.int64)})
        word, place = words(rows.column("text"))
        ends, values = zip(*grams(word, place, order), strict=True)
        gram, which, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        n = times.astype(np.int64) if own else np.zeros(len(gram), np.int64)
        bounds = np.searchsorted(_bucket(gram, buckets), np.arange(buckets + 1))
        for bucket, totals in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            first, end = bounds[bucket : bucket + 2]
            told = unpacked(totals, end - first).astype(np.int64)
            n[first:end] = np.where(told > 0, told, n[first:end])
        total, at = [], 0  # of each order: counts of the n-grams that end at the words, 0 where there is none
        for end in ends:
            full = np.zeros(len(word), np.int64)
            full[end] = n[which[at : at + len(end)]]
            total.append(full)
            at += len(end)
        value, bare = np.log(np.maximum(total[0], 1)), np.ones(len(word))  # each bare word is still to be divided by all words
        for k in range(1, order):
            seen = total[k] >= max(cutoff, 1)
            before = np.concatenate((np.ones(min(1, len(word)), np.int64), total[k - 1][:-1]))  # the context's count
            depth = np.zeros(len(word), bool)
            depth[k:] = place[k:] == place[: max(len(place) - k, 0)]
            value = np.where(seen, np.log(np.maximum(total[k], 1)) - np.log(np.maximum(before, 1)), value + np.where(depth, np.log(alpha), 0.0))
            bare = np.where(seen, 0.0, bare)
        count = len(rows)
        return pa.table({
            "id": rows.column("id"), "n_words": np.bincount(place, minlength=count).astype(np.int64),
            "value": np.bincount(place, value, count).astype(np.float64), "bare": np.bincount(place, bare, count).astype(np.int64),
        })

    with shuffles_dropped(spark):
        texts, size = _sliced(docs, text, id_)
        counted_in, more = (None, 0) if own else _sliced(corpus, text, id_)
        # A slice has about an n-gram for four bytes of text, of all orders up to three.
        buckets = RANGES * max(spark.sparkContext.defaultParallelism, (size + more) * order // 12 // BUCKET // RANGES + 1)
        for r in range(RANGES):
            sent = exploded(texts, order, buckets, r, counts=own)
            if not own:
                sent = sent.unionByName(exploded(counted_in, order, buckets, r, asks=False))
            counted(sent, buckets, own).write.option("compression", "zstd").mode("append").parquet(folder)
        both = texts.groupBy("slice").cogroup(spark.read.schema(TOLD).parquet(folder).groupBy("slice"))
        kind = docs.schema[id_].dataType.simpleString()
        sums = saved(both.applyInArrow(scored, f"id {kind}, n_words long, value double, bare long"))
    dropped(spark, folder)
    if own:
        all_ = sums.agg(F.sum("n_words").alias("words"))
    else:
        all_ = corpus.agg(F.sum(F.regexp_count(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("words"))
    total = all_.first()["words"] or 1
    out = sums.select(F.col("id").alias(id_), "n_words", (F.col("value") - F.col("bare") * F.lit(float(np.log(total)))).alias("score"))
    return out.withColumn("mean", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).otherwise(0.0))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 6).alias("score"), F.round("mean", 9).alias("mean"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, unnest(w) AS w3, unnest(range(len(w))) AS i FROM d),
q AS (SELECT *, lag(w3) OVER (PARTITION BY rid ORDER BY i) AS w2, lag(w3, 2) OVER (PARTITION BY rid ORDER BY i) AS w1 FROM p),
u AS (SELECT w3 AS w, count(*) AS c FROM q GROUP BY w3),
b AS (SELECT w2 AS v, w3 AS w, count(*) AS c FROM q WHERE w2 IS NOT NULL GROUP BY w2, w3),
t AS (SELECT w1, w2, w3, count(*) AS c FROM q WHERE w1 IS NOT NULL GROUP BY w1, w2, w3),
n AS (SELECT count(*) AS total FROM q),
s AS (SELECT rid, sum(ln(CASE WHEN q.w2 IS NULL THEN u1.c / total::DOUBLE WHEN q.w1 IS NULL THEN b1.c / u2.c::DOUBLE ELSE t.c / b2.c::DOUBLE END)) AS score
  FROM q JOIN u u1 ON u1.w = q.w3 LEFT JOIN u u2 ON u2.w = q.w2 LEFT JOIN b b1 ON b1.v = q.w2 AND b1.w = q.w3 LEFT JOIN b b2 ON b2.v = q.w1 AND b2.w = q.w2 LEFT JOIN t ON t.w1 = q.w1 AND t.w2 = q.w2 AND t.w3 = q.w3 CROSS JOIN n GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0), 6) AS score, round(CASE WHEN len(w) > 0 THEN score / len(w) ELSE 0 END, 9) AS mean FROM d LEFT JOIN s USING (rid)
"""
