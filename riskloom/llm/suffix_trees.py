"""Operator 13: removal of repeated word windows by prefix-partitioned suffix trees.

The suffixes are those that start a window of `length` words; they are cut at the window, as deeper nodes of the tree
can't add to what is removed (a longer repeat is the run of its windows).

1. Prefixes.  Every slice of texts names the first `prefix` words of its suffixes by a hash and sends each name
   once, marked if the slice has it twice.  A prefix that one suffix has is a leaf under the top of the tree and is
   done.  The others split the suffixes into groups.  A group that wouldn't fit a task's memory gets a longer prefix, up to
   the whole window: then the prefix itself is a deep node if two suffixes have it.
2. Subtrees.  The suffixes of the groups go to their groups with the words after the prefix as 32-bit numbers,
   each different one of a slice once with its weight.  Small groups share a task.  There the suffixes are sorted, which is the order of
   the leaves; the words that neighbours share are the depths of the inner nodes between them.  An inner node of `length` words or more,
   and a leaf of weight two, is a repeat; its leaves are told by their places.
   The groups pass in shares, as many as keep what is sent below the texts' own size.
3. Slices mark the windows of told leaves and cut out the words that they cover.

Texts that are equal travel once, with their number, which is their suffixes' weight.  They stay in place, hashed by
content: all passes read one checkpoint that is dealt and sorted by slice, and only names, suffixes and places are shuffled.
Words are told apart by 64-bit hashes.

Null texts have no words.  Texts of fewer words than a window keep all.  Rows that repeat a text lose
all of it, if it is as long as a window; rows that repeat id and text are two rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import Spans, bounded_batches, dropped, joined, mix, new_folder, runs, saved, setting, shuffles_dropped, table

LENGTH, PREFIX = 35, 16
#: Suffixes of one prefix that a task takes; bytes of text in a slice, and suffixes in a bucket of names, about.
MEMORY, SLICE, BUCKET = 1 << 16, 4 << 20, 1 << 18
#: Bytes of a name within its bucket, and of a word after the prefix.
NAME, WORD = 5, 4
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
TOLD = "slice long not null, share int not null, bucket int not null, places binary not null, n int not null"


def _poly(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on: the places' words weighed and added one by one."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ word[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


class Slice:
    """The distinct texts of a slice: their words, and the suffixes that start a window, with the names of their prefixes."""

    def __init__(self, rows: pa.Table, length: int, prefix: int):
        self.length, self.prefix = length, prefix
        key = rows.column("key").to_pylist()
        valid = np.asarray(rows.column("text").combine_chunks().is_valid()).tolist()
        place = {k: i for i, (k, v) in enumerate(zip(key, valid, strict=True)) if v}  # a row of each text
        of = np.array([place[k] for k in key], np.int64)
        copies = np.bincount(of, np.asarray(rows.column("copies")), len(key)).astype(np.int64)
        first = np.flatnonzero(of == np.arange(len(key)))
        self.keys, self.copies = [key[i] for i in first], copies[first]
        column = rows.column("text").take(pa.array(first)).combine_chunks()
        self.data, self.offsets = joined(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks))
        self.start, self.end = runs(~WHITE[self.data])
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.offsets)  # words before each text
        self.word = Spans(self.data).hash(self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        at = np.arange(len(self.word))
        self.suffix = at[at + length <= self.first[1:][self.text]]
        self.name = _poly(self.word, self.suffix, prefix)

    def weighed(self, value: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place of a first suffix with it, suffixes with it, whether they are two or more with copies, place of its value for each suffix) of distinct values."""
        distinct, first, back, times = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
        twice = np.bincount(back, self.copies[self.text[self.suffix[which]]], len(distinct)) > 1
        return first, times, twice, back

    def names(self, buckets: int) -> tuple[np.ndarray, ...]:
        """(bucket, name within it, suffixes up to 127 and whether two or more, place among them for each suffix), in order."""
        first, times, twice, back = self.weighed(self.name, np.arange(len(self.name)))
        value = self.name[first]  # in order, so by bucket
        return _bucket(value, buckets), value & np.uint64((1 << 8 * NAME) - 1), (np.minimum(times, 127) * 2 + twice).astype(np.uint8), back

    def sent(self, classes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(class, suffixes, name, record, place of its record for each suffix) of groups in trees (1) and of longer prefixes (2).

        A record: the name, the words after the prefix, and the weight of 1 or 2, as bytes in order of the words.
        """
        for kind in (1, 2):
            which = np.flatnonzero(classes == kind)
            at = self.suffix[which]
            rest = _poly(self.word, at + self.prefix, self.length - self.prefix)
            whole = mix(self.name[which] * np.uint64(3) + rest)
            first, _, twice, back = self.weighed(whole, which)
            name = self.name[which][first] if kind == 1 else whole[first]
            parts = [name.astype(">u8").view(np.uint8).reshape(len(first), 8)]
            if kind == 1:
                words = at[first][:, None] + np.arange(self.prefix, self.length)
                parts.append((self.word[words] >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(len(first), WORD * (self.length - self.prefix)))
            parts.append(twice.astype(np.uint8)[:, None] + 1)
            yield kind, which, name, np.concatenate(parts, 1), back

    def kept(self, marked: np.ndarray, texts: bool) -> pa.Table:
        """(key, n_words, n_removed, kept_sha256, kept) of the texts, without the words that windows of marked suffixes cover."""
        cover = np.zeros(len(self.word) + 1, np.int64)
        np.add.at(cover, self.suffix[marked], 1)
        np.add.at(cover, self.suffix[marked] + self.length, -1)
        gone = np.cumsum(cover)[:-1] > 0
        stays = np.zeros(len(self.data) + 1, np.int8)
        stays[self.start[~gone]] += 1
        stays[self.end[~gone] + 1] -= 1  # with the character after it, a space from now on
        stays = np.cumsum(stays)[:-1] > 0
        letters = np.where(WHITE[self.data], 32, self.data).astype(np.uint8)[stays].tobytes()
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(stays)))[self.offsets]
        kept = [letters[a : max(b - 1, a)].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        removed = np.concatenate((np.zeros(1, np.int64), np.cumsum(gone)))[self.first]
        return pa.table({
            "key": pa.array(self.keys, pa.binary()), "n_words": np.diff(self.first).astype(np.int64), "n_removed": np.diff(removed).astype(np.int64),
            "kept_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in kept], "kept": pa.array(kept, pa.string()) if texts else pa.nulls(len(kept), pa.string()),
        })


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of equal buckets."""
    if not len(bucket):
        return
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    yield from zip(bucket[begin].tolist(), begin.tolist(), np.append(begin[1:], len(bucket)).tolist(), strict=True)


def group_classes(names: np.ndarray, told: np.ndarray, memory: int) -> np.ndarray:
    """For every slice's name: 0 if one suffix has the prefix, 1 if the group of its suffixes fits the memory, else 2."""
    _, back = np.unique(names, return_inverse=True)
    return np.where(np.bincount(back, 1 + told % 2) < 2, 0, np.where(np.bincount(back, told // 2) > memory, 2, 1))[back].astype(np.uint8)


def subtree(records: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of the groups' trees in order, and the depth in words of the lowest inner node over each leaf and the next.

    Leaves of different groups have the root in common, depth 0; what they share within the prefix doesn't matter.
    """
    whole = np.ascontiguousarray(records)
    order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
    same = whole[order[1:], :-1] == whole[order[:-1], :-1]
    group = same[:, :8].all(1)
    words = same[:, 8:].reshape(len(same), (whole.shape[1] - 9) // WORD, WORD).all(2)
    shared = np.where(words.all(1), words.shape[1], np.argmin(words, 1)) if words.shape[1] else 0
    return order, np.where(group, prefix + shared, 0)


def deep(records: np.ndarray, prefix: int, length: int) -> np.ndarray:
    """Whether each leaf has an inner node of `length` words or more above it, or stands for two."""
    if not len(records):
        return np.zeros(0, bool)
    order, depth = subtree(records, prefix)
    out = np.zeros(len(records), bool)
    out[order[1:]] = depth >= length
    out[order[:-1]] |= depth >= length
    return out | (records[:, -1] > 1)


def _texts(docs: DataFrame, slice_: int) -> tuple[DataFrame, int]:
    """(slice, key, copies, text) of docs(key, text), a row for each text of a task, dealt and sorted by slice; bytes of text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(spark.sparkContext.defaultParallelism, int(size // slice_) + 1)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: dict[bytes, int] = {}
        for batch in batches:
            new = []
            for i, k in enumerate(batch.column("key").to_pylist()):
                if k not in more:
                    new.append(i)
                more[k] = more.get(k, -1) + 1
            own = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("key"), pa.array(np.ones(len(own), np.int64)), own.column("text")], names=["key", "copies", "text"])
        again = {k: n for k, n in more.items() if n}
        if again:
            yield pa.RecordBatch.from_arrays([pa.array([*again], pa.binary()), pa.array([*again.values()], pa.int64()), pa.nulls(len(again), pa.string())], names=["key", "copies", "text"])

    rows = docs.select("key", "text").mapInArrow(once, "key binary not null, copies long not null, text string")
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(slices)).alias("slice"), "key", "copies", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices // 16)
    # A plan that doesn't adapt tells how its checkpoint is dealt and sorted, so that later groupings by slice don't move it.
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        return saved(rows.repartition(parts, "slice").sortWithinPartitions("slice")), size


def repeated(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, memory: int = MEMORY, slice_: int = SLICE, bucket: int = BUCKET, texts_: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept) of every different text of docs(key, text); equal texts have equal keys.

    texts_: whether kept has what stays; else it is null, which spares a copy of the texts on disk.
    """
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        texts, size = _texts(docs, slice_)
        by_slice = texts.groupBy("slice")
        buckets = max(1, int(size // 6 // bucket))
        folder = new_folder(spark, "prefixes")

        def named(rows: pa.Table) -> pa.Table:
            own = Slice(rows, length, prefix)
            where, name, suffixes, _ = own.names(buckets)
            cut = [(b, name[s:e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME].tobytes(), suffixes[s:e].tobytes()) for b, s, e in _cuts(where)]
            b, n, t = zip(*cut, strict=True) if cut else ((), (), ())
            return pa.table({"bucket": pa.array(b, pa.int32()), "slice": pa.array([rows.column("slice")[0].as_py()] * len(cut), pa.int64()), "names": pa.array(n, pa.binary()), "suffixes": pa.array(t, pa.binary())})

        def grouped(rows: pa.Table) -> pa.Table:
            blobs = rows.column("names").to_pylist()
            size = np.array([len(b) // NAME for b in blobs])
            names = np.zeros((size.sum(), 8), np.uint8)
            names[:, :NAME] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, NAME)
            suffixes = np.frombuffer(b"".join(rows.column("suffixes").to_pylist()), np.uint8)
            classes = np.split(group_classes(names.view("<u8").ravel(), suffixes, memory), np.cumsum(size)[:-1])
            some = [i for i, c in enumerate(classes) if c.any()]
            out = rows.take(pa.array(some, pa.int64()))
            return pa.table({"slice": out.column("slice"), "share": pa.array(np.full(len(some), -1, np.int32)), "bucket": out.column("bucket"), "places": pa.array([classes[i].tobytes() for i in some], pa.binary()), "n": pa.array([np.count_nonzero(classes[i]) for i in some], pa.int32())})

        names = by_slice.applyInArrow(named, "bucket int not null, slice long not null, names binary not null, suffixes binary not null")
        names.groupBy("bucket").applyInArrow(grouped, TOLD).write.option("compression", "zstd").mode("append").parquet(folder)
        told = spark.read.schema(TOLD).parquet(folder)
        groups = told.where("share = -1")
        # What will be sent, about: a record for each name of a group.
        sent_ = (groups.agg(F.sum("n")).first()[0] or 0) * (9 + WORD * (length - prefix))
        shares = 1 + int(sent_ // max(size, 1 << 20))

        def classes(own: Slice, rows: pa.Table) -> np.ndarray:
            """The class of every suffix of the slice."""
            where, _, _, back = own.names(buckets)
            out = np.zeros(len(where), np.uint8)
            begin = np.searchsorted(where, np.asarray(rows.column("bucket")))
            for b, p in zip(begin.tolist(), rows.column("places").to_pylist(), strict=True):
                out[b : b + len(p)] = np.frombuffer(p, np.uint8)
            return out[back]

        def of_share(own: Slice, rows: pa.Table, share: int) -> Iterator[tuple]:
            """(kind, bucket, records, place of its record for each suffix, suffixes) of a share, by bucket."""
            for kind, which, name, record, back in own.sent(classes(own, rows)):
                # Records stand in order of their names; names of one share in order of their buckets.
                order = np.argsort(name, kind="stable")
                where = _bucket(name[order], buckets)
                mine = where % shares == share
                place = np.full(len(name), -1)
                place[order[mine]] = np.arange(mine.sum())
                yield kind, where[mine], record[order[mine]], place[back], which

        def sending(share: int):
            def send(rows: pa.Table, told: pa.Table) -> pa.Table:
                if not len(rows):
                    return pa.table({"bucket": pa.array([], pa.int32()), "slice": pa.array([], pa.int64()), "records": pa.array([], pa.binary())})
                cut = []
                for kind, where, record, _, _ in of_share(Slice(rows, length, prefix), told, share):
                    # An odd bucket holds longer prefixes.
                    cut += [(2 * b + (kind == 2), record[s:e].tobytes()) for b, s, e in _cuts(where)]
                b, r = zip(*cut, strict=True) if cut else ((), ())
                return pa.table({"bucket": pa.array(b, pa.int32()), "slice": pa.array([rows.column("slice")[0].as_py()] * len(cut), pa.int64()), "records": pa.array(r, pa.binary())})

            return send

        def treed(share: int):
            def tree(rows: pa.Table) -> pa.Table:
                blobs = rows.column("records").to_pylist()
                whole = rows.column("bucket")[0].as_py() % 2  # the prefix is the window
                width = 9 if whole else 9 + WORD * (length - prefix)
                records = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
                found = np.split(deep(records, length if whole else prefix, length), np.cumsum([len(b) // width for b in blobs])[:-1])
                some = [i for i, f in enumerate(found) if f.any()]
                out = rows.take(pa.array(some, pa.int64()))
                return pa.table({"slice": out.column("slice"), "share": pa.array(np.full(len(some), share, np.int32)), "bucket": out.column("bucket"), "places": pa.array([found[i].tobytes() for i in some], pa.binary()), "n": pa.array([np.count_nonzero(found[i]) for i in some], pa.int32())})

            return tree

        for share in range(shares):
            sent = by_slice.cogroup(groups.groupBy("slice")).applyInArrow(sending(share), "bucket int not null, slice long not null, records binary not null")
            sent.groupBy("bucket").applyInArrow(treed(share), TOLD).write.option("compression", "zstd").mode("append").parquet(folder)

        def cut_out(rows: pa.Table, told: pa.Table) -> pa.Table:
            if not len(rows):
                return pa.table({"key": pa.array([], pa.binary()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept": pa.array([], pa.string())})
            own = Slice(rows, length, prefix)
            marked = np.zeros(len(own.suffix), bool)
            share_of = np.asarray(told.column("share"))
            answers = {(s, b): p for s, b, p in zip(share_of.tolist(), told.column("bucket").to_pylist(), told.column("places").to_pylist(), strict=True) if s >= 0}
            groups_ = told.take(pa.array(np.flatnonzero(share_of < 0)))
            for share in range(shares):
                for kind, where, record, back, which in of_share(own, groups_, share):
                    found = np.zeros(len(record) + 1, bool)  # the last place is that of records of other shares
                    for b, s, e in _cuts(where):
                        if p := answers.get((share, 2 * b + (kind == 2))):
                            found[s:e] = np.frombuffer(p, bool)
                    marked[which] |= found[back]
            return own.kept(marked, texts_)

        result = by_slice.cogroup(spark.read.schema(TOLD).parquet(folder).groupBy("slice")).applyInArrow(cut_out, "key binary, n_words long, n_removed long, kept_sha256 string, kept string")
        out = saved(result)
    dropped(spark, folder)
    return out


def without_passages(docs: DataFrame, length: int = LENGTH, text: str = "text", id_: str = "doc_id", **options) -> DataFrame:
    """id_, n_words, n_removed, kept_sha256 and kept (the words that stay, one space between them) of every row of docs.

    options: of repeated: prefix (words of the shortest prefixes; half a window if it isn't longer), memory (suffixes of a group in a task), slice_, bucket, texts_.
    """
    bounded_batches(docs.sparkSession)
    if options.get("prefix", PREFIX) >= length:
        options["prefix"] = max(1, length // 2)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_).alias("_id"), F.unhex(F.sha2(whole, 256)).alias("key"), whole.alias("text"))
    found = repeated(rows, length, **options)
    told = rows.select("_id", F.col("key").alias("own")).join(found, F.col("own") == F.col("key"))
    return told.select(F.col("_id").alias(id_), "n_words", "n_removed", "kept_sha256", "kept")


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(table(spark, sf_dir, "documents"), texts_=False).drop("kept")
