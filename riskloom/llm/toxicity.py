"""Operator 10: toxicity as multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability from a logistic model over its
hashed words and word beginnings; a document's is their noisy-or, 1 - prod(1 - p).  Only document
labels are known: their likelihood under the noisy-or trains the sentence model, which then locates
the offending sentences.

The model is fitted on the driver over a bounded sample of labelled rows: at most `per_class` rows of
each label, each of at most `longest` bytes, the first by a seeded hash of the id.  Held-out rows
are never in it.  Scoring reads whole texts of all rows.

Null and empty texts, and texts without words, score 0.  Ids without a label, labels that are null
and labels of unknown ids don't count; an id with several labels counts as toxic if any says so.  A
null id is not held out and has no label.  If the sample lacks a class, the model is the share of
toxic rows in the sample (0 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, Spans, bounded_batches, chunks, free_name, joined, mix, table, word_spans

#: Hashed features, as a power of 2; bytes of the word beginnings beside whole words.
BITS = 18
BEGINNINGS = (4, 5)
#: Rows of the sample at most, clean and toxic; bytes of a row of the sample at most.
PER_CLASS, LONGEST, SEED = (4000, 2000), 20_000, 42
#: Strength of the quadratic penalty, the association from which a feature counts, and the part of a feature's
#: own log ratio to which the penalty draws its weight; chosen by cross-validation on rows that aren't held out.
RIDGE, LEAST, SHARE = 1e-5, 12.0, 0.5
THRESHOLD = 0.3
_END = np.zeros(256, bool)
_END[[0x0A, 0x21, 0x2E, 0x3F]] = True  # newline ! . ?


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, its word) of a buffer, and the first words of its sentences."""
    start, end = word_spans(data)
    spans, parts, words = Spans(LOWER[data]), [], []
    for kind, size in enumerate((None, *BEGINNINGS)):
        word = np.arange(len(start)) if size is None else np.flatnonzero(end - start > size)
        hashed = spans.hash(start[word], end[word] if size is None else start[word] + size)
        parts.append((mix(hashed + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int32))
        words.append(word)
    sentence = np.cumsum(_END[data])[start]
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1]))) if len(start) else np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(words), first


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Model:
    """Weights of a sentence's logistic model."""

    def __init__(self, weights: np.ndarray, bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant

    def sentences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first byte, log odds) of every sentence with words."""
        feature, word, first = features(data)
        if not len(first):
            return first, np.zeros(0)
        start, _ = word_spans(data)
        each = np.bincount(word, self.weights[feature], len(start))
        return start[first], np.add.reduceat(each, first) + self.bias

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the score, the number of offending sentences, the place of the worst and its probability."""
        data, offsets = joined(column)
        n = len(offsets) - 1
        place, odds = self.sentences(data)
        text = np.searchsorted(offsets, place, "right") - 1
        clean = np.bincount(text, _soft(odds), n) if len(text) else np.zeros(n)
        score = np.where(np.bincount(text, minlength=n) > 0, -np.expm1(-clean) if self.constant is None else self.constant, 0.0)
        worst, chance = np.full(n, -1, np.int64), np.zeros(n)
        order = np.lexsort((-place, odds))
        worst[text[order]] = place[order] - offsets[text[order]]
        chance[text[order]] = np.exp(-_soft(-odds[order]))
        return score, np.bincount(text[odds > 0], minlength=n), worst, chance


def _minimum(value_and_slope, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """A local minimum by limited-memory quasi-Newton steps with backtracking."""
    f, g = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for dx, dg, r in reversed(past):
            kept.append(r * (dx @ d))
            d = d - kept[-1] * dg
        if past:
            dx, dg, r = past[-1]
            d = d / (r * (dg @ dg))
        else:
            d = d / max(1.0, float(np.sqrt(g @ g)))
        for (dx, dg, r), a in zip(past, reversed(kept), strict=True):
            d = d + (a - r * (dg @ d)) * dx
        down = float(g @ d)
        if down >= 0:
            d, down, past = -g, -float(g @ g), []
        step = 1.0
        while True:
            moved = x + step * d
            now, slope = value_and_slope(moved)
            if now <= f + 1e-4 * step * down:
                break
            step *= 0.5
            if step < 1e-8:
                return x
        dx, dg = moved - x, slope - g
        if (curve := float(dx @ dg)) > 1e-12:
            past = [*past[1 - memory :], (dx, dg, 1 / curve)]
        done = f - now < 1e-7 * abs(f)
        x, f, g = moved, now, slope
        if done:
            break
    return x


def _without_copies(bags: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """One bag of each group of near copies, so that their chance words don't count many times."""
    salts = mix(np.arange(1, 9, dtype=np.uint64))
    kept, seen = [], {}
    for bag in bags:
        least = np.array([mix(np.unique(bag[0]).astype(np.uint64) ^ s).min() for s in salts])
        bands = [(i, bag[2], int(least[i]), int(least[i + 1])) for i in range(0, 8, 2)]
        if any((least == seen[k]).sum() >= 5 for k in bands if k in seen):
            continue
        kept.append(bag)
        for k in bands:
            seen.setdefault(k, least)
    return kept


def _association(bags: list[tuple[np.ndarray, np.ndarray, int]], clean_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Of every feature, twice the log likelihood ratio of its share among toxic documents (0 unless it is above
    the mean), and the logarithm of how much oftener a toxic document has it than a clean one."""
    count = np.zeros((2, 1 << BITS))
    for f, _, y in bags:
        count[int(y), np.unique(f)] += 1.0 if y else clean_weight
    toxic = sum(1.0 for b in bags if b[2])
    mean = toxic / (toxic + clean_weight * (len(bags) - toxic))
    total = count.sum(0)
    share = np.divide(count[1], total, out=np.zeros_like(total), where=total > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(count[1] > 0, count[1] * np.log(share / mean), 0) + np.where(count[0] > 0, count[0] * np.log((1 - share) / (1 - mean)), 0)
    clean = clean_weight * (len(bags) - toxic)
    oftener = np.log((count[1] + 0.5) / (toxic + 1)) - np.log((count[0] + 0.5 * clean_weight) / (clean + clean_weight))
    return np.where(share > mean, 2 * ratio, 0), oftener


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], clean_weight: float = 1.0, rounds: int = 200, ridge: float = RIDGE, least: float = LEAST) -> Model:
    """bags: (features, places where sentences begin, label) of the sample's documents.

    clean_weight: what a clean document of the sample stands for, a toxic one being 1.  Features whose
    association with toxic documents is below `least` stay 0.
    """
    labels = np.array([b[2] for b in bags], bool)
    if not len(bags) or labels.all() or not labels.any():
        return Model(np.zeros(1 << BITS), 0.0, float(labels.mean()) if len(bags) else 0.0)
    bags = _without_copies(bags)
    labels = np.array([b[2] for b in bags], bool)
    strength, oftener = _association(bags, clean_weight)
    known = np.flatnonzero(strength >= least)
    prior = SHARE * oftener[known]
    number = np.full(1 << BITS, -1, np.int32)
    number[known] = np.arange(len(known))
    feature, sentence, bag, n, bare = [], [], [], 0, np.zeros(len(bags))
    for at, (f, begin, _) in enumerate(bags):
        own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(f))))
        keep = number[f] >= 0
        told, place = np.unique(own[keep], return_inverse=True)
        bare[at] = len(begin) - len(told)  # sentences without any known feature
        feature.append(number[f[keep]])
        sentence.append(place + n)
        bag.append(np.full(len(told), at))
        n += len(told)
    feature, sentence, bag = np.concatenate(feature), np.concatenate(sentence), np.concatenate(bag)
    weight = np.where(labels, 1.0, clean_weight)
    weight /= weight.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(sentence, x[feature], n) + x[-1]
        clean = np.bincount(bag, _soft(z), len(bags)) + bare * _soft(x[-1])
        toxic = np.maximum(-np.expm1(-clean), 1e-12)
        value = (weight * np.where(labels, -np.log(toxic), clean)).sum() + ridge / 2 * ((x[:-1] - prior) @ (x[:-1] - prior))
        pull = weight * np.where(labels, -(1 - toxic) / toxic, 1.0)  # by a sentence's -log(1 - p)
        slope = pull[bag] * np.exp(-_soft(-z))
        return value, np.append(np.bincount(feature, slope[sentence], len(known)) + ridge * (x[:-1] - prior), slope.sum() + (pull * bare).sum() * np.exp(-_soft(-x[-1])))

    x = _minimum(loss, np.append(prior, -6.0), rounds)
    weights = np.zeros(1 << BITS)
    weights[known] = x[:-1]
    return Model(weights, float(x[-1]))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, text: str, id_: str, per_class: tuple[int, int], longest: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """The features of the sample, and how many labelled rows a clean one stands for as against a toxic
    one.  The driver gets at most sum(per_class) documents of at most longest bytes."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_).isNotNull()).groupBy(id_).agg(F.max("toxic").alias("toxic")).where(~held_out(F.col(id_)))
    order = F.xxhash64(F.col(id_), F.lit(SEED))
    picked = [known.where((F.col("toxic") > 0) == F.lit(bool(y))).orderBy(order, id_).limit(per_class[y]).select(id_, F.lit(y).alias("_label")) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionAll(picked[1]))  # sum(per_class) ids at most
    texts = docs.select(F.col(id_), F.coalesce(F.col(text), F.lit("")).alias("_text")).where(F.octet_length("_text").between(1, longest))
    # One row of an id, however many repeat it.
    rows = texts.join(picked, id_).groupBy(id_, F.col("_label").alias("toxic")).agg(F.min("_text").alias("_text"))

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column("_text").to_pylist():
                feature, word, first = features(np.frombuffer(t.encode("utf-8", "replace") + b"\n", np.uint8))
                order = np.argsort(word, kind="stable")
                f, s = feature[order].tobytes(), np.searchsorted(word[order], first).astype(np.int32).tobytes()
                found.append((f, s, xxhash.xxh3_64_intdigest(f + s) >> 1))
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic")], names=["f", "s", "h", "toxic"])

    # Arrow keeps the sample in one copy; the order is by content, so that sums don't depend on the order of arrival.
    got = rows.mapInArrow(bagged, "f binary, s binary, h long, toxic int").toArrow().sort_by([("toxic", "ascending"), ("h", "ascending")]).combine_chunks()
    cells = zip(got.column("f"), got.column("s"), got.column("toxic").to_pylist(), strict=True)
    bags = [(np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.int32), y) for f, s, y in cells if s.as_buffer().size]
    there = {bool(y): n for y, n in known.groupBy((F.col("toxic") > 0).alias("y")).count().collect()}
    stands = [there.get(y, 0) / max(1, sum(b[2] == y for b in bags)) for y in (False, True)]
    return bags, stands[0] / stands[1] if stands[1] else 1.0


def toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", threshold: float = THRESHOLD, per_class: tuple[int, int] = PER_CLASS, longest: int = LONGEST, found: str = "_toxicity"
) -> DataFrame:
    """All columns of docs, and a struct `found`: held_out, score, predicted, n_offending (sentences
    likelier toxic than not), worst_at (byte of the text at which its worst sentence's first word
    begins; -1 without words) and worst (that sentence's probability)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    fitted = fit(*sample(docs, labels, text, id_, per_class, longest))
    model = spark.sparkContext.broadcast((fitted.weights.astype(np.float32), fitted.bias, fitted.constant))  # 1 MB

    @F.arrow_udf("score double, n_offending long, worst_at long, worst double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*model.value)
        names = ["score", "n_offending", "worst_at", "worst"]
        for column in texts:
            out = [own.score(part.column(0)) for part in chunks(pa.RecordBatch.from_arrays([column], names=["text"]), "text")]
            score, count, worst, chance = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0)] * 4
            yield pa.StructArray.from_arrays([pa.array(score), pa.array(count.astype(np.int64)), pa.array(worst.astype(np.int64)), pa.array(chance)], names=names)

    # Only the text goes to Python, and only the scores come back; a filter by them doesn't score twice.
    got = free_name(docs, "scored")
    out = docs.withColumn(got, scored.asNondeterministic()(F.col(text)))
    told = F.struct(
        held_out(F.col(id_)).alias("held_out"), F.col(f"{got}.score").alias("score"), (F.col(f"{got}.score") >= threshold).cast("int").alias("predicted"),
        *[F.col(f"{got}.{c}").alias(c) for c in ("n_offending", "worst_at", "worst")],
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], told.alias(found))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "_toxicity.*")
