"""Operator 11: alignment of two tokenizers' tokens over the same texts.

A whole Arrow batch of texts, each with a space in front, is one run of bytes with document offsets.  The ends of A's
and of B's tokens are counted by one bincount each; a byte at which both end cuts the batch into groups.
A cut is a link of the A token and the B token that end there.  Running sums over the batch, read at the
documents' offsets, give tokens, groups and links by document; an array of strings, one for each token in
the order of the groups, gives the text that is hashed.

Counts of linked pairs are summed in each task, then by Spark.  How often each pair is linked goes back to the documents'
own pairs as a broadcast of PAIRS pairs at most; of more pairs, one share by hash passes after the other, each adding to
the rows' sums.  Pairs can't exceed the product of the vocabularies.

Tokens come from the libraries, segment by segment: a segment begins at a space after a character that isn't white.
Neither tokenizer has tokens across such a place (A splits there before it merges; no piece of B has a space after
another character, which is checked, and else B takes whole texts), so a worker asks once for each different segment.

Null and empty texts and those that the tokens don't give back have no tokens: zeros and ''.  Repeated rows are aligned
each on its own, and count each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches, chunks, dropped, joined, new_folder, saved, table
from riskloom.llm.token_counts import PATTERN, PLAIN, _byte_letters

#: Pairs whose counts are broadcast at once (17 bytes each).
PAIRS = 2_000_000
#: Bytes of text that are aligned at once; segments that a worker remembers, and bytes of the longest of them.
CHUNK, REMEMBERED, LONG = 1 << 20, 300_000, 64
SPACE = "▁"


def gathered(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of ragged rows, one after the other; row i ends before ends[i + 1]."""
    size = ends[rows + 1] - ends[rows]
    end = np.cumsum(size)
    return values[np.repeat(ends[rows + 1] - end, size) + np.arange(end[-1] if len(end) else 0)]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and the offsets of the lists."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1])), ends


class Pool:
    """Ragged rows of token ids in one growing array; a view on it must be gone before it grows."""

    def __init__(self, tokens: list[bytes]):
        self.ids, self.ends, self.tokens = array("i"), array("q", [0]), tokens
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        self.bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in tokens])))

    def add(self, lists: list[list[int]], pieces: list[bytes]) -> np.ndarray:
        """Adds rows; whether each one's tokens are the bytes of its piece."""
        flat, ends = flattened(lists)
        self.ends.frombytes((ends[1:] + len(self.ids)).tobytes())
        self.ids.frombytes(flat.tobytes())
        sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum((self.bounds[1:] - self.bounds[:-1])[flat])))
        own = np.fromiter(map(len, pieces), np.int64, len(pieces))
        good = sizes[ends[1:]] - sizes[ends[:-1]] == own
        if not good.all():  # only what has the right length can be compared at once
            return np.array([b"".join([self.tokens[k] for k in ids]) == p for ids, p in zip(lists, pieces, strict=True)], bool)
        differ = gathered(self.letters, self.bounds, flat) != np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(own)))
        wrong = np.concatenate((np.zeros(1, np.int64), np.cumsum(differ)))
        return wrong[begin[1:]] == wrong[begin[:-1]]

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, one after the other."""
        return gathered(np.frombuffer(self.ids, np.int32), np.frombuffer(self.ends, np.int64), rows)


def segments(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the segments of texts that begin at first: spaces after a character that isn't white."""
    at = np.flatnonzero(data == 32)
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    white = (one <= 32) | (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide = three.astype(np.int32) << 16 | two.astype(np.int32) << 8 | one
    white |= (wide >= 0xE28080) & (wide <= 0xE2808A) | np.isin(wide, [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
    mark = np.zeros(len(data), bool)
    mark[at[~white]] = True
    mark[first] = True
    return np.flatnonzero(mark)


class Pair:
    """Two tokenizers: ids of segments, and the bytes of every id."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letter = {c: i for i, c in enumerate(_byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        own = {i: bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t, i in vocabulary.items()}
        self.bytes_a = [own.get(i, b"") for i in range(max(own) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Pieces without an inner space, and spaces that are kept, let B take a segment at a time.
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and self.b.encode("a  b ", out_type=str) == [*self.b.encode("a", out_type=str), *self.b.encode(" b", out_type=str), SPACE]
        self.blank = self.b.piece_to_id(SPACE)
        n = len(self.bytes_a)
        self.text = pa.array([f"{i}{c}" for i in range(n) for c in ",|"] + [f"{i}{c}" for i in range(len(pieces)) for c in ",;"], pa.large_string())
        self.known: dict[bytes, int] = {}
        self._clear()
        self._ranked(spec)

    def _clear(self) -> None:
        self.known.clear()
        self.rows_a, self.rows_b, self.good = Pool(self.bytes_a), Pool(self.bytes_b), bytearray()

    def _ranked(self, spec: str) -> None:
        """The faster engine of the same merges, for texts on which character tables agree; none unless bytes and merges number the ids in order."""
        import tiktoken

        self.plain, self.quick = re.compile(PLAIN), None
        model = json.loads(spec)["model"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"].get(m, -1) for m in merges]
        single = [i for t, i in model["vocab"].items() if len(t) == 1]
        if len(single) == 256 and [*range(256, 256 + len(order))] == order and max(single) == 255:
            ranks = {self.bytes_a[i]: i for i in range(256 + len(order))}
            self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        out: list = [None if self.plain.search(t) else self.quick(t) for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.a.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def rows(self, pieces: list[bytes]) -> np.ndarray:
        """Places of the segments' ids in the pools."""
        if len(self.good) > REMEMBERED:
            self._clear()
        out = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        asked = [pieces[i] for i in new.tolist()]
        texts = [p.decode() for p in asked]
        of_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        if self.cut and " " in texts:
            of_b[texts.index(" ")] = [self.blank]
        first = len(self.good)
        self.good += (self.rows_a.add(self.ids_a(texts), asked) & self.rows_b.add(of_b, asked)).astype(np.uint8).tobytes()
        out[new] = np.arange(first, len(self.good))
        self.known.update((p, i) for i, p in enumerate(asked, first) if len(p) <= LONG)
        return out

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """For every text its numbers of tokens, groups and links, the hash of its groups, and its linked pairs with their numbers."""
        n = len(texts)
        data, offsets = joined(texts)
        # The newline after a text makes room for the space in front of the next.
        data = np.concatenate((np.array([32], np.uint8), data[:-1])) if len(data) else data
        spaced = data.copy()
        spaced[offsets[1:-1]] = 32
        first = segments(spaced, offsets[:-1]) if self.cut else offsets[:-1]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(spaced)).astype(np.int64)), pa.py_buffer(spaced)])
        coded = column.dictionary_encode()
        row = self.rows(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        doc = np.searchsorted(offsets, first, "right") - 1
        size = np.diff(offsets)
        bad = np.zeros(n, bool)
        bad[doc[np.frombuffer(self.good, np.uint8)[row] == 0]] = True
        for i in np.flatnonzero(bad).tolist():  # pieces may differ and the whole be the same
            own, whole = row[doc == i], spaced[offsets[i] : offsets[i + 1]].tobytes()
            bad[i] = any(b"".join([told[k] for k in pool.take(own).tolist()]) != whole for pool, told in ((self.rows_a, self.bytes_a), (self.rows_b, self.bytes_b)))
        bad |= size <= 1
        row, size = row[~bad[doc]], np.where(bad, 0, size)
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))  # offsets of the documents that have tokens
        a, b = self.rows_a.take(row), self.rows_b.take(row)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends_a, ends_b = np.bincount(end_a, minlength=at[-1] + 1), np.bincount(end_b, minlength=at[-1] + 1)
        cut = (ends_a > 0) & (ends_b > 0)
        cut[0] = False
        so_far_a, so_far_b, groups = np.cumsum(ends_a), np.cumsum(ends_b), np.cumsum(cut)
        out: dict = {"n_a": np.diff(so_far_a[at]), "n_b": np.diff(so_far_b[at]), "n_groups": np.diff(groups[at])}
        # In the order of the groups: A's tokens of a group after B's of all groups before, B's after A's of their own.
        place = np.flatnonzero(cut)
        before_b = np.concatenate((np.zeros(1, np.int64), so_far_b[place]))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[groups[end_a - 1]]] = a.astype(np.int64) * 2 + cut[end_a]
        order[np.arange(len(b)) + so_far_a[place][groups[end_b - 1]]] = 2 * len(self.bytes_a) + b.astype(np.int64) * 2 + cut[end_b]
        told = self.text.take(pa.array(order))
        _, where, letters = told.buffers()
        where = np.frombuffer(where, np.int64, len(told) + 1)[so_far_a[at] + so_far_b[at]]
        view = memoryview(letters) if letters is not None else memoryview(b"")
        out["groups_sha256"] = [hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
        pair = a[cut[end_a]].astype(np.int64) * len(self.bytes_b) + b[cut[end_b]]
        width = len(self.bytes_a) * len(self.bytes_b)
        pair, times = np.unique(np.repeat(np.arange(n), out["n_groups"]) * width + pair, return_counts=True)
        out["pairs"], out["times"] = _ragged(pair % width, np.searchsorted(pair, np.arange(n + 1) * width)), _ragged(times, np.searchsorted(pair, np.arange(n + 1) * width))
        return out


@lru_cache(maxsize=1)
def _pair(spec: str, model: bytes) -> Pair:
    """The pair that a worker keeps from task to task."""
    return Pair(spec, model)


def _ragged(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as binary values."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(values.astype(np.uint32))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What _ragged made: the numbers, and the row of each."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32), np.repeat(np.arange(len(rows)), [len(r) // 4 for r in rows])


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many links hold a pair, in all rows(pairs, times)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more, times = _numbers(batch.column("pairs"))[0], _numbers(batch.column("times"))[0]
            both, at = np.unique(np.concatenate((pair, more.astype(np.int64))), return_inverse=True)
            n = np.bincount(at, np.concatenate((n, times)), len(both)).astype(np.int64)
            pair = both
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return rows.select("pairs", "times").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _added(rows: DataFrame, share: DataFrame) -> DataFrame:
    """rows with n_best and count_sum raised by the pairs of share(pair, n, best), which fits a broadcast."""
    told = share.select("pair", "n", "best").toArrow().sort_by("pair")
    sent = rows.sparkSession.sparkContext.broadcast((np.asarray(told.column("pair")).astype(np.uint32), np.asarray(told.column("n")), np.asarray(told.column("best").cast(pa.int8())).astype(bool)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            (pair, row), (times, _) = _numbers(batch.column("pairs")), _numbers(batch.column("times"))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            mine = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            row, times, at = row[mine], times[mine].astype(np.int64), at[mine]
            more = np.zeros((2, len(batch)), np.int64)
            np.add.at(more[0], row, times * best[at])
            np.add.at(more[1], row, times * n[at])
            done = [pa.array(np.asarray(batch.column(c)) + m) for c, m in zip(("n_best", "count_sum"), more, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) if c not in ("n_best", "count_sum") else done[c == "count_sum"] for c in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(add, rows.schema)


def alignment(docs: DataFrame, byte_level: str, pieces: str, limit: int = PAIRS, text: str = "text", id_: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id_, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs, and (a, b, n, best) of every linked pair of ids.

    byte_level, pieces: paths of a byte-level BPE file and of a piece model; the driver reads them and broadcasts their bytes.
    limit: pairs that are broadcast at once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        spec = spark.sparkContext.broadcast((f.read(), g.read()))
    own = _pair(*spec.value)
    n_b = len(own.bytes_b)
    if len(own.bytes_a) * n_b >= 1 << 32:
        raise ValueError("a pair of ids must fit 32 bits")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(*spec.value)
        for batch in batches:
            for part in chunks(batch, "_text", CHUNK):
                x = both.align(part.column("_text"))
                zero = pa.array(np.zeros(len(part), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(x["n_a"]), pa.array(x["n_b"]), pa.array(x["n_groups"]), zero, zero, pa.array(x["groups_sha256"], pa.string()), x["pairs"], x["times"]],
                    names=["_id", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256", "pairs", "times"],
                )

    rows = docs.select(F.col(id_).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    folder = new_folder(spark, "aligned")
    rows.mapInArrow(aligned, f"_id {kind}, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string, pairs binary, times binary").write.option("compression", "zstd").parquet(folder)
    state = spark.read.parquet(folder)
    # A B id has A's vocabulary of partners at most.
    same_b = Window.partitionBy("b")
    counts = _pair_counts(state).withColumn("b", F.col("pair") % n_b)
    counts = saved(counts.withColumn("best", F.col("n") == F.max("n").over(same_b)))
    shares = max(1, -(-counts.count() // max(limit, 1)))
    for k in range(shares):
        state = _added(state, counts.where(F.pmod(F.xxhash64("pair"), F.lit(shares)) == k))
        if k < shares - 1:
            state = saved(state)
    out = saved(state.select(F.col("_id").alias(id_), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"))
    dropped(spark, folder)
    return out, counts.select(F.floor(F.col("pair") / n_b).alias("a"), "b", "n", "best")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
