"""Operator 9: SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  Three errors over three segments
leave at least two segments with at most one error each, so two linked fingerprints agree, up to
one bit, in both segments of one of the three pairs of segments.

The binary Golay code (23, 12) is perfect: every 23-bit word is within 3 bits of one codeword.  A
fingerprint is filed under its segments' nearest codewords, and looked up under those and, for a
word 3 bits away from its codeword, under the codewords 4 bits away too (five of them).  Words that
differ in one bit then meet: if u is filed under c and c isn't v's nearest, v is 4 bits from c and
3 from its own codeword.  So no link is lost; the distance of what meets is verified.

Rows of copies collapse to distinct fingerprints first.  Within a key the verified links are
thinned to a spanning forest, so a group of n near copies gives fewer than n links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches, saved, table
from riskloom.llm.components import components

#: Fixed: the generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Bits of the segments, from the highest bit of a fingerprint down.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Shingles whose bits are counted at once, and fingerprints of a key that are compared without another cut.
BLOCK, CROWD = 1 << 14, 256


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words by the generator."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


@cache
def golay() -> np.ndarray:
    """For each syndrome six error words, the nearest codeword's first; -1 where there are fewer."""
    out, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    bits = 1 << np.arange(23, dtype=np.int64)
    words = np.zeros(1, np.int64)
    for weight in range(5):
        syndrome = _syndromes(words)
        if weight < 4:
            out[syndrome, 0], filled[syndrome] = words, 1
            last = syndrome
        else:
            only = np.zeros(2048, bool)
            only[last] = True  # syndromes whose nearest codeword is 3 bits away
            for w, s in zip(words[only[syndrome]].tolist(), syndrome[only[syndrome]].tolist(), strict=True):
                out[s, filled[s]] = w
                filled[s] += 1
        top = np.where(words, np.floor(np.log2(np.maximum(words, 1))), -1).astype(np.int64)
        words = np.concatenate([words[top < i] | bits[i] for i in range(23)])
    return out


def segment_keys(segment: np.ndarray) -> np.ndarray:
    """n x 6 codeword numbers of 23-bit words, the nearest first; -1 for none."""
    errors = golay()[_syndromes(segment)]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of its fingerprint, whether it is filed there) of all keys."""
    part = [segment_keys((fingerprints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)) for low, width in SEGMENTS]
    out = []
    for number, (a, b) in enumerate(PAIRS):
        both = np.where((part[a][:, :, None] < 0) | (part[b][:, None, :] < 0), -1, number << 24 | part[a][:, :, None] << 12 | part[b][:, None, :])
        both = both.reshape(len(fingerprints), 36)
        row, column = np.nonzero(both >= 0)
        out.append((both[row, column], row, column == 0))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fingerprint(text: str) -> int:
    """The fingerprint of a text: bits set in more than half of its 3-word shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line, at, place = b" ".join(words), 0, []
    for w in words:
        place.append(at)
        at += len(w) + 1
    n = len(words) - 2
    ends = [*place[3:], at]
    votes = np.zeros(64, np.int64)
    for low in range(0, n, BLOCK):
        hashed = b"".join([digest(line[a : b - 1], 42) for a, b in zip(place[low : low + BLOCK], ends[low : low + BLOCK], strict=False)][: n - low])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64)
        votes += bits.sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


_LOWER = bytes(range(256)).lower()


def fingerprints(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id_, fp): the 64 bits as a signed long.  A null text has no words."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or "") for t in batch.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fp.view(np.int64))], names=["_id", "fp"])

    rows = docs.select(F.col(id_).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(hashed, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_)


def _forest(fp: np.ndarray, filed: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one key's fingerprints: filed ones against all.

    A crowded key is cut again: fingerprints that differ in no more bits than `distance` agree in one of distance + 1
    equal parts, so only those that share a part are compared.
    """
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    groups = [np.arange(len(fp))]
    if len(fp) > CROWD:
        groups, width = [], 64 // (distance + 1)
        for k in range(distance + 1):
            part = fp >> np.uint64(k * width) & np.uint64((1 << width) - 1)
            order = np.argsort(part, kind="stable")
            groups += [g for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(g) > 1]
    links = []
    for group in groups:
        own = fp[group]
        for i in group[filed[group]].tolist():
            for j in group[np.bitwise_count(own ^ fp[i]) <= distance].tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((i, j))
    return links


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect what fingerprints at the distance connect; distinct(fp) has each once."""
    bounded_batches(distinct.sparkSession)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                key, place, first = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[place].view(np.int64)), pa.array(first)], names=["key", "fp", "filed"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def linked(key: np.ndarray, fp: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begin, len(key)))
            some = np.add.reduceat(first.astype(np.int64), begin) > 0
            a, b = [], []
            # Most keys have two fingerprints: those are verified together.
            two = begin[some & (size == 2)]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            a.append(fp[near])
            b.append(fp[near + 1])
            for at, n in zip(begin[some & (size > 2)].tolist(), size[some & (size > 2)].tolist(), strict=True):
                own = fp[at : at + n]
                if found := _forest(own, first[at : at + n], distance):
                    pair = np.array(found)
                    a.append(own[pair[:, 0]])
                    b.append(own[pair[:, 1]])
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            now = [np.asarray(batch.column("key")), np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("filed").cast(pa.int8())).astype(bool)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            rest = [x[cut:] for x in now]
            if cut:
                yield linked(*(x[:cut] for x in now))
        if rest is not None and len(rest[0]):
            yield linked(*rest)

    rows = distinct.mapInArrow(filed, "key int, fp long, filed boolean")
    met_by_key = rows.repartition("key").sortWithinPartitions("key")
    return met_by_key.mapInArrow(met, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, fingerprint and component_id (the smallest id_ reachable) of every row of docs.

    Texts without words (null, empty) have fingerprint zero and link like others.  Rows with equal
    fingerprints are one node.  A null id_ keeps its row and is the smallest of a component only
    where no other id_ is in it.
    """
    marked = saved(fingerprints(docs, text, id_))
    nodes = saved(marked.groupBy("fp").agg(F.min(id_).alias("least")))
    reached = components(links(nodes.select("fp"), distance))
    root = nodes.join(reached, nodes.fp == reached.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only what is linked is gathered by root; a fingerprint alone keeps its own smallest id.
    linked = root.where("root <> fp").select("root").distinct()
    moved = root.join(linked, "root", "left_semi")
    least = moved.groupBy("root").agg(F.min("least").alias("lower"))
    ids = root.join(least, "root", "left").select("fp", F.coalesce("lower", "least").alias("component_id"))
    return marked.join(ids, "fp").select(id_, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
