"""Operator 3: removal of long repeated substrings by run-length indexes.

Every window of `length` bytes belongs to the shard of its minimizer, the least hash among its short
substrings, so equal windows always meet in one shard, whatever their documents.  Consecutive
windows with one minimizer form a piece; a document is a sequence of pieces, and each window start
is in exactly one.

Pieces that are equal as a whole are repeated as a whole, and only their numbers travel.  Where one
minimizer has several different pieces, one copy of each piece goes to its shard.  The shards' texts
are indexed (see rindex): the run-compressed transform and its sampled run ends give the longest
match of every place with another place, and the windows that match for `length` are marked.

A minimizer with more than `hot` different pieces isn't put into one task: its pieces are cut again
by minimizers of another hash, and at the last level each window is a piece of its own, for which
being equal is all there is to know.  Nothing is dropped or capped on the way.

Null text is the empty text.  Texts shorter than `length` keep all bytes.  Rows that repeat a text
are copies of each other, so all of them lose what they share (if as long as `length`); rows that
repeat id and text are two rows.  Bytes are removed wherever they are, also within a character, so
what is kept is bytes, not a string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches, chunks, joined, mix, runs, saved, table
from riskloom.llm.rindex import RunLengthIndex

LENGTH, SHORT = 400, 32
#: Windows of a piece at most; different pieces of a minimizer in a task at most; levels of cutting.
PIECE, HOT, LEVELS = 2048, 2048, 3
#: Bytes of text in an index, about, and that a kernel hashes at once.
INDEX, CHUNK = 1 << 20, 256 << 10


def minimizers(data: np.ndarray, length: int, short: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the short substrings of a buffer, and for every place the least in the window that starts there."""
    salt = mix(np.arange(1, 300, dtype=np.uint64) + np.uint64(1000 * seed))
    value, size = salt[data], 1
    while size < short:
        value = value[: len(value) - size] * (salt[256 + size.bit_length()] | np.uint64(1)) + value[size:]
        size *= 2
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    each, width, size = value, length - short + 1, 1
    while 2 * size <= width:
        value = np.minimum(value[: len(value) - size], value[size:])
        size *= 2
    return each, np.minimum(value[: len(value) - (width - size)], value[width - size :]) if width > size else value


def pieces(column: pa.Array, length: int, seed: int, piece: int, short: int = SHORT) -> tuple[np.ndarray, ...]:
    """(text, start in it, windows, key, content hash, whether the minimizer stands in it twice) of all pieces."""
    data, offsets = joined(column)
    each, least = minimizers(data, length, short, seed) if len(data) >= length else (np.zeros(0, np.uint64),) * 2
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + length < offsets[text + 1]  # the newline after a text isn't its own
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])))[: len(least)]
    new |= ~inside
    at = np.arange(len(least))
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    begin = np.flatnonzero((new | (since % piece == 0)) & inside)
    stop = np.append(begin[1:], len(least))
    # Windows that reach over a text's end belong to no piece.
    stop = np.minimum(stop, offsets[text[begin] + 1] - length)
    whole, digest = memoryview(data), xxhash.xxh3_64_intdigest
    content = np.array([digest(whole[a : b + length - 1]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.uint64)
    # A window that occurs twice in one piece has its minimizer there twice.
    width, found = length - short, np.count_nonzero
    twice = [b - a > 1 and found(each[a : b + width] == v) > 1 for a, b, v in zip(begin.tolist(), stop.tolist(), least[begin], strict=True)]
    return text[begin], begin - offsets[text[begin]], stop - begin, mix(least[begin]), content, np.array(twice, bool)


def _cut(texts: DataFrame, length: int, seed: int, piece: int) -> DataFrame:
    """(a, b, start, n, key, content, twice) of texts(a, b, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                text, start, n, key, content, twice = pieces(part.column("text"), length, seed, piece)
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(own), part.column("b").take(own), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(twice)],
                    names=["a", "b", "start", "n", "key", "content", "twice"],
                )

    kind = texts.schema["a"].dataType.simpleString()
    return texts.mapInArrow(cut, f"a {kind}, b long, start int, n int, key long, content long, twice boolean")


def _indexed(shards: DataFrame, length: int) -> DataFrame:
    """(key, content, s, e): runs of window starts that match elsewhere in shards(key, content, text), sorted by key."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def index() -> pa.RecordBatch:
            data = np.frombuffer(b"\xff".join(t for _, _, t in held) + b"\xff", np.uint8)  # no byte of UTF-8
            matched = RunLengthIndex(data).matches(data) >= length
            out, at = [], 0
            for key, content, text in held:
                for s, e in zip(*runs(matched[at : at + len(text) - length + 1]), strict=True):
                    out.append((key, content, int(s), int(e)))
                at += len(text) + 1
            key, content, s, e = zip(*out, strict=True) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(content, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["key", "content", "s", "e"])

        for batch in batches:
            for key, content, text in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if size >= INDEX and key != held[-1][0]:
                    yield index()
                    held, size = [], 0
                held.append((key, content, text))
                size += len(text)
        if held:
            yield index()

    return shards.mapInArrow(marked, "key long, content long, s int, e int")


def _sliced(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, content, different, text) of wanted(a, b, start, n, key, content, different): the bytes of pieces."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                data = text if isinstance(text, bytes) else text.encode()
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p[c] for p in part], pa.int64()) for c in ("key", "content", "different")] + [pa.array([data[p["start"] : p["start"] + p["size"]] for p in part], pa.binary())],
                        names=["key", "content", "different", "text"],
                    )

    by_text = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("start", "size", "key", "content", "different")).alias("own"))
    by_text = by_text.withColumnsRenamed({"a": "x", "b": "y"})
    both = texts.join(by_text, F.col("a").eqNullSafe(F.col("x")) & (F.col("b") == F.col("y")))
    return both.select("text", "own").mapInArrow(sliced, "key long, content long, different long, text binary")


def repeated_windows(texts: DataFrame, length: int = LENGTH, hot: int = HOT, levels: int = LEVELS, level: int = 1) -> DataFrame:
    """(a, b, s, e): runs of window starts, in bytes, whose window occurs elsewhere in texts(a, b, text).

    b must tell texts with one a apart.
    """
    spark = texts.sparkSession
    own = _cut(texts, length, level, 1 if level == levels else PIECE)
    if level == levels:  # equal single windows have equal contents too, so a minimizer's windows needn't stay together
        own = own.withColumn("key", F.xxhash64("key", "content"))
    own = saved(own)
    first = F.min(F.struct("a", "b", "start", "n")).alias("first")
    distinct = own.groupBy("key", "content").agg(F.count("*").alias("rows"), F.max("twice").alias("twice"), first)
    several = distinct.groupBy("key").agg(F.count("*").alias("different"), F.sum("rows").alias("all"), F.max("twice").alias("any")).where("`all` > 1 or any")
    known = saved(distinct.join(several.drop("all", "any"), "key").where("rows > 1 or different > 1 or twice"))
    whole = known.where("rows > 1").select("key", "content", F.lit(0).alias("s"), F.col("first.n").alias("e"))
    marks = whole
    if level < levels:
        wanted = known.where("different > 1 or (twice and rows = 1)").select("first.a", "first.b", "first.start", (F.col("first.n") + length - 1).alias("size"), "key", "content", "different")
        # A document told twice gives its slices twice; one of each is kept.
        slices = saved(_sliced(texts, wanted).dropDuplicates(["key", "content"]))
        size = slices.where(F.col("different") <= hot).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size:
            shards = max(spark.sparkContext.defaultParallelism, int(size // INDEX) + 1)
            spread = slices.where(F.col("different") <= hot).repartition(shards, "key").sortWithinPartitions("key", "content")
            marks = marks.unionByName(_indexed(spread.select("key", "content", "text"), length))
        crowd = slices.where(F.col("different") > hot)
        if not crowd.isEmpty():
            below = repeated_windows(crowd.select(F.col("key").alias("a"), F.col("content").alias("b"), "text"), length, hot, levels, level + 1)
            marks = marks.unionByName(below.select(F.col("a").alias("key"), F.col("b").alias("content"), "s", "e"))
    marks = saved(marks.groupBy("key", "content").agg(F.collect_list(F.struct("s", "e")).alias("runs")))
    told = own.join(marks, ["key", "content"])
    out = told.select("a", "b", "start", F.explode("runs").alias("r"))
    return out.select("a", "b", (F.col("start") + F.col("r.s")).alias("s"), (F.col("start") + F.col("r.e")).alias("e"))


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of docs."""
    bounded_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id_).alias("a"), F.xxhash64(whole).alias("b"), whole.alias("text"))
    spans = repeated_windows(texts, length).groupBy("a", "b").agg(F.collect_list(F.struct("s", "e")).alias("spans")).withColumnsRenamed({"a": "x", "b": "y"})
    rows = texts.join(spans, F.col("a").eqNullSafe(F.col("x")) & (F.col("b") == F.col("y")), "left").select("a", "text", "spans")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, own in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
                data = t.encode()
                if not own.is_valid:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data))
                    continue
                cover = np.zeros(len(data) + 1, np.int32)
                flat = own.values.flatten()
                np.add.at(cover, np.asarray(flat[0]), 1)
                np.add.at(cover, np.asarray(flat[1]) + length - 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("a"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["a", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = rows.schema["a"].dataType.simpleString()
    return rows.mapInArrow(removed, f"a {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("a", id_)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
