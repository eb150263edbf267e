"""Operator 7: benchmark decontamination by suffix arrays over the training words.

Each shard (a slice of a partition's texts) gets the suffix array of its words: all suffixes, which end with
their text, sorted by their first words, as many as a window has or more.  Words are 64-bit hashes.  Every
suffix of a test item is sought in it by binary search, a word deeper each time, which leaves the range of the
training suffixes that begin with a window of it, so all its places; from each the match is followed word by
word, which gives the longest verbatim matches.

The benchmark is broadcast up to `limit` bytes; a larger one passes in parts of that size, each over the
texts once and saved, adding to what earlier parts hit.

Null texts and items have no words.  Items without words have no window.  Items that repeat an id
count as one; a null item_id counts as the id 'null'.  Rows of documents are judged one by one, so
repeated and null ids keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, Spans, bounded_batches, chunks, free_name, joined, saved, table, word_spans

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
LIMIT = 32 << 20


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's begin (n + 1 places)."""
    data, offsets = joined(column)
    data = LOWER[data]
    start, end = word_spans(data)
    return Spans(data).hash(start, end), np.searchsorted(start, offsets)


class SuffixArray:
    """The suffixes of a shard's texts, sorted by their first `depth` words or more."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, depth: int = WINDOW):
        n = len(words)
        self.end = np.repeat(begin[1:], np.diff(begin))  # where the text of each word ends
        self.order = np.argsort(words)
        ranked = words[self.order]
        new = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
        #: The distinct words, and where the suffixes that begin with each begin.
        self.known, self.first = ranked[new], np.append(new, n)
        self.word = np.empty(n, np.int64)  # words as places among the distinct ones
        self.word[self.order] = np.repeat(np.arange(len(new)), np.diff(self.first))
        name, size, open_ = self.first[self.word], 1, np.arange(n)
        while size < depth and len(open_):
            # Suffixes with one name share `size` words; what follows there has a name too.
            shared = np.bincount(name, minlength=n)
            open_ = open_[shared[name[open_]] > 1]
            after = np.where(open_ + size < self.end[open_], name[np.minimum(open_ + size, n - 1)] + 1, 0)
            key = name[open_] * (n + 1) + after
            rank = np.argsort(key)
            moved, key = open_[rank], key[rank]
            base, at = name[moved], np.arange(len(key))
            group, equal = np.flatnonzero(np.diff(base, prepend=-1)), np.flatnonzero(np.diff(key, prepend=-1))
            self.order[base + at - np.repeat(group, np.diff(group, append=len(key)))] = moved
            name = name.copy()
            name[moved] = np.repeat((base + at - np.repeat(group, np.diff(group, append=len(key))))[equal], np.diff(equal, append=len(key)))
            open_ = open_[after > 0]  # equal suffixes that end there stay together
            size *= 2

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, deep: int, beyond: bool) -> np.ndarray:
        """In each range of suffixes, the first whose word at `deep` isn't before `word`, or is beyond it."""
        low, high = low.copy(), high.copy()
        while len(at := np.flatnonzero(low < high)):
            middle = (low[at] + high[at]) >> 1
            suffix = self.order[middle]
            place = suffix + deep
            have = np.where(place < self.end[suffix], self.word[np.minimum(place, len(self.word) - 1)], -1)
            left = have <= word[at] if beyond else have < word[at]
            low[at[left]], high[at[~left]] = middle[left] + 1, middle[~left]
        return low

    def search(self, test: Test) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the shard, place in the test words, length of the match from there on) of all windows found."""
        none = np.zeros(0, np.int64)
        if not len(self.word) or not len(test.suffix):
            return none, none, none
        number = np.minimum(np.searchsorted(self.known, test.words), len(self.known) - 1)
        number = np.where(self.known[number] == test.words, number, -1)
        own = np.flatnonzero(number[test.suffix] >= 0)
        low, high = (self.first[number[test.suffix[own]] + i] for i in (0, 1))
        for deep in range(1, int(test.length.max())):
            word = number[np.minimum(test.suffix[own] + deep, len(number) - 1)]
            far = test.length[own] > deep
            stay = ~far | (word >= 0)
            own, low, high, word, far = own[stay], low[stay], high[stay], word[stay], far[stay]
            now_low, now_high = self._bound(low[far], high[far], word[far], deep, False), self._bound(low[far], high[far], word[far], deep, True)
            low[far], high[far] = now_low, now_high
            stay = low < high
            own, low, high = own[stay], low[stay], high[stay]
        many = high - low
        suffix, each = test.suffix[np.repeat(own, many)], np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = self.order[np.repeat(low, many) + each]
        size = test.length[np.repeat(own, many)].copy()
        on = np.arange(len(size))
        while len(on):
            a, b = place[on] + size[on], suffix[on] + size[on]
            inside = (a < self.end[place[on]]) & (b < test.end[suffix[on]])
            on, a, b = on[inside], a[inside], b[inside]
            on = on[self.word[a] == number[b]]
            size[on] += 1
        return place, suffix, size


class Test:
    """The words of a benchmark's items, and their suffixes that begin with a window."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        self.words, begin = _hashed(pa.array(texts, pa.large_string()))
        count = np.diff(begin)
        self.ids, self.item, self.end = ids, np.repeat(np.arange(len(ids)), count), np.repeat(begin[1:], count)
        full = np.minimum(window, count)[self.item]  # words of a window of the item
        self.suffix = np.flatnonzero(self.end - np.arange(len(self.words)) >= full)
        self.length = full[self.suffix]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as disjoint spans, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


_NAMES = ["n_words", "spans", "items", "longest"]


def _judge(column: pa.Array, test: Test) -> pa.StructArray:
    words, begin = _hashed(column)
    place, suffix, size = SuffixArray(words, begin).search(test)
    text = np.searchsorted(begin, place, "right") - 1  # a text without words begins where the next does, which is the one
    order = np.argsort(text, kind="stable")
    place, suffix, size, text = place[order], suffix[order], size[order], text[order]
    hit, first = np.unique(text, return_index=True)
    spans, items, longest = [None] * len(column), [None] * len(column), [0] * len(column)
    for t, a, b in zip(hit.tolist(), first.tolist(), np.append(first, len(text))[1:].tolist(), strict=True):
        spans[t] = np.stack(_merged(place[a:b] - begin[t], place[a:b] - begin[t] + size[a:b]), 1).ravel().tolist()
        items[t] = [test.ids[i] for i in np.unique(test.item[suffix[a:b]]).tolist()]
        longest[t] = int(size[a:b].max())
    return pa.StructArray.from_arrays([pa.array(np.diff(begin)), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())], names=_NAMES)


def _parts(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list]:
    """The items, at most about limit bytes at once."""
    size = benchmark.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    n = int(size // limit) + 1
    for i in range(2 * n if n > 1 else 1):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64(item, text), F.lit(2 * n)) == i)
        yield part.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), text).collect()


def _judged(tests: Broadcast):
    """What is found in a column of texts: a struct of _NAMES."""

    @F.arrow_udf("n_words long, spans array<int>, items array<string>, longest long")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = Test(*tests.value)
        for column in texts:
            parts = [_judge(part.column(0), test) for part in chunks(pa.RecordBatch.from_arrays([column], names=["text"]), "text")]
            yield pa.concat_arrays(parts or [_judge(column, test)])

    return judged


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", item: str = "item_id", item_text: str = "text", limit: int = LIMIT, found: str = "_found"
) -> DataFrame:
    """All columns of docs, and n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word
    places, start and end by turns), hit_items and longest_match (words) in a struct `found`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out, told = docs, None
    for rows in _parts(benchmark, item, item_text, limit):
        tests = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        # Only the text goes to Python, and only what was found comes back; a filter by it doesn't search twice.
        now = free_name(out, "now")
        out = out.withColumn(now, _judged(tests).asNondeterministic()(F.col(text)))
        if told is None:
            told = now
            continue
        a, b = F.col(told), F.col(now)
        both = F.struct(a.n_words.alias("n_words"), *[F.coalesce(F.concat(a[c], b[c]), a[c], b[c]).alias(c) for c in ("spans", "items")], F.greatest(a.longest, b.longest).alias("longest"))
        out = saved(out.withColumn(told, both).drop(now))
    got = F.col(told)
    pairs = F.array_sort(F.transform(F.filter(got.spans, lambda x, i: i % 2 == 0), lambda x, i: F.struct(x.alias("s"), F.element_at(got.spans, 2 * i + 2).alias("e"))))
    covered = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda acc, x: F.struct((acc.n + F.greatest(x.e - F.greatest(x.s, acc.e), F.lit(0))).alias("n"), F.greatest(acc.e, x.e).alias("e")),
    )
    items = F.array_sort(F.array_distinct(F.coalesce(got["items"], F.array().cast("array<string>"))))
    n_hit = F.coalesce(covered.n, F.lit(0)).cast("long")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            got.n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
            got.spans.alias("hit_spans"), items.alias("hit_items"), got.longest.alias("longest_match"),
        ).alias(found),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *[F.col(f"_found.{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")])


OP7_SQL = r"""
WITH lower_docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_docs),
lower_items AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
b AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_items),
bw AS (SELECT item_id, least(len(w), 10) AS n, j, array_to_string(w[j + 1 : j + least(len(w), 10)], ' ') AS v FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS v FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id, j FROM dw JOIN bw ON dw.v = bw.v AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id),
islands AS (SELECT doc_id, item_id, n, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM (SELECT DISTINCT doc_id, item_id, n, i, j FROM hits)),
longest AS (SELECT doc_id, max(size) AS longest_match FROM (SELECT doc_id, count(*) - 1 + max(n) AS size FROM islands GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
