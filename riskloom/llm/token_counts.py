"""Operator 1: token counts by rank-synchronous merging of ragged arrays.

Texts are split into pre-tokens; the distinct pre-tokens of a batch that a worker hasn't met become
one flat array of symbols with sequence numbers.  In each round every sequence applies its
lowest-rank pair at all its places at once; sequences without a pair left leave the array with
their number of surviving symbols.  A pair's merge makes a symbol that only later ranks use, so
the rounds give what merging one pair after another gives.

Null and empty texts have 0 tokens.  Repeated rows are counted each on its own.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_batches, chunks, runs, table

#: Fixed: the split of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed: blocks without letters or digits that newer character tables class otherwise.
SETTLED = r"[^\x00-ԯḀ-ỿ -⁯₠-₽℀-⅏←-⏺─-➿　-〩ぁ-ゖァ-ヺ一-龥가-힣！-ﾝ\U0001F300-\U0001F64F]"
#: Fixed: the same blocks below U+3100, and the white space of the split.
PLAIN = r"[^\x00-ԯḀ-ỿ -⁯₠-₽℀-⅏←-⏺─-➿　-〩ぁ-ゖァ-ヺ]"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of a pre-token from which it is merged by an index of its pairs by rank.
LONG = 2048
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 400_000
NONE = np.int64(1 << 40)
#: Slots of the table of pairs, as a power of 2.
SLOTS = 19


class Merges:
    """The merge table of a byte-level BPE file as arrays."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        bpe = model["model"]
        self.vocab = bpe["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.width = max(self.vocab.values()) + 1
        keys = left * self.width + right
        slot = self._slot(keys)
        self.key, self.rank = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, NONE, np.int64)
        self.key[slot], self.rank[slot] = keys, np.arange(len(keys))
        rest = np.flatnonzero(self.key[slot] != keys)  # another pair took the slot
        self.shared = np.zeros(1 << SLOTS, bool)
        self.shared[slot[rest]] = True
        self.rest_order = rest[np.argsort(keys[rest], kind="stable")]
        self.rest = keys[self.rest_order]
        self.byte = np.array([self.vocab[c] for c in _byte_letters()], np.int64)
        self.special = [t["content"] for t in model["added_tokens"]]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        slot = self._slot(wanted)
        out = np.where(self.key[slot] == wanted, self.rank[slot], NONE)
        if len(self.rest):
            more = np.flatnonzero(self.shared[slot] & (out == NONE))
            at = np.minimum(np.searchsorted(self.rest, wanted[more]), len(self.rest) - 1)
            out[more] = np.where(self.rest[at] == wanted[more], self.rest_order[at], NONE)
        return out


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


def count_symbols(tokens: list[bytes], merges: Merges) -> np.ndarray:
    """Symbols of each byte sequence after all merges."""
    size = np.array([len(t) for t in tokens], np.int64)
    out = np.zeros(len(tokens), np.int64)
    for i in np.flatnonzero(size > LONG):
        out[i] = _count_long(tokens[i], merges)
    short = np.flatnonzero((size <= LONG) & (size > 0))
    for at in range(0, len(short), 1 << 16):
        part = short[at : at + (1 << 16)]
        out[part] = _count_short(b"".join(tokens[i] for i in part), size[part], merges)
    return out


def _count_short(data: bytes, size: np.ndarray, merges: Merges) -> np.ndarray:
    out = np.ones(len(size), np.int64)
    symbol = merges.byte[np.frombuffer(data, np.uint8)]
    sequence = np.repeat(np.arange(len(size)), size)
    rank = np.append(merges.ranks(symbol[:-1], symbol[1:]), NONE)
    rank[:-1][sequence[:-1] != sequence[1:]] = NONE
    while len(symbol) > 1:
        first = np.flatnonzero(np.concatenate(([True], sequence[1:] != sequence[:-1])))
        lowest = np.minimum.reduceat(rank, first)
        length = np.diff(np.append(first, len(sequence)))
        done = lowest == NONE
        out[sequence[first[done]]] = length[done]
        merge = (rank == np.repeat(lowest, length)) & (rank != NONE)
        merge = _leftmost(merge)
        symbol[merge] = merges.made[rank[merge]]
        keep = np.repeat(~done, length)
        keep[1:] &= ~merge[:-1]
        symbol, sequence, rank, merge = symbol[keep], sequence[keep], rank[keep], merge[keep]
        # Only the pairs on either side of a new symbol have changed.
        stale = merge.copy()
        stale[:-1] |= merge[1:]
        stale = np.flatnonzero(stale)
        if len(stale) and stale[-1] == len(symbol) - 1:
            rank[-1], stale = NONE, stale[:-1]
        rank[stale] = np.where(sequence[stale] == sequence[stale + 1], merges.ranks(symbol[stale], symbol[stale + 1]), NONE)
    if len(symbol) == 1:
        out[sequence[0]] = 1
    return out


def _leftmost(merge: np.ndarray) -> np.ndarray:
    """Of overlapping places of one pair (as in aaa) the first, third, ... from the left."""
    clash = np.flatnonzero(merge[1:] & merge[:-1])
    if not len(clash):
        return merge
    at = np.arange(len(merge))
    start = np.maximum.accumulate(np.where(merge & ~np.concatenate(([False], merge[:-1])), at, 0))
    return merge & ((at - start) % 2 == 0)


def _count_long(token: bytes, merges: Merges) -> int:
    """The same rounds over one long sequence, with its pairs indexed by rank and its symbols linked."""
    symbol = merges.byte[np.frombuffer(token, np.uint8)].tolist()
    n = len(symbol)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank_of: dict[tuple[int, int], int] = {}
    places: dict[int, list[int]] = {}
    rounds: list[int] = []

    def add(i: int) -> None:
        j = after[i]
        if j >= n:
            return
        pair = symbol[i], symbol[j]
        if (rank := rank_of.get(pair)) is None:
            rank = rank_of[pair] = int(merges.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
        if rank != NONE:
            if rank not in places:
                places[rank] = []
                heapq.heappush(rounds, rank)
            places[rank].append(i)

    for i in range(n - 1):
        add(i)
    count = n
    while rounds:
        rank = heapq.heappop(rounds)
        made = int(merges.made[rank])
        for i in sorted(places.pop(rank)):
            j = after[i] if symbol[i] >= 0 else n
            if j >= n or rank_of.get((symbol[i], symbol[j])) != rank:
                continue
            symbol[i], symbol[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            count -= 1
            if before[i] >= 0:
                add(before[i])
            add(i)
    return count


def _class(category: str) -> str:
    """The characters of a general category below U+3100, as ranges of a character class."""
    member = np.array([unicodedata.category(chr(c))[0] == category for c in range(0x3100)])
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(*runs(member), strict=True))


def _quick_split() -> re.Pattern:
    """PATTERN for texts of settled characters below U+3100, by the faster engine."""
    letter, number, space = _class("L"), _class("N"), SPACE
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Counter:
    """Token counts of texts; remembers pre-tokens it has counted."""

    def __init__(self, spec: str):
        self.merges = Merges(spec)
        self.quick, self.plain = _quick_split(), re.compile(PLAIN)
        self.split, self.unsettled = regex.compile(PATTERN), regex.compile(SETTLED)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        self.known: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        if not self.plain.search(text):
            return self.quick.findall(text)
        if self.unsettled.search(text):
            # Characters on which character tables differ: the library's own split decides.
            from tokenizers.pre_tokenizers import ByteLevel

            own = ByteLevel(add_prefix_space=False, use_regex=True)
            return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]
        return self.split.findall(text)

    def count(self, texts: Iterable[str]) -> np.ndarray:
        words: list[str] = []
        special, ends = [], [0]
        for text in texts:
            parts = [text]
            if self.specials and any(s in text for s in self.merges.special):
                parts = self.specials.split(text)
            special.append(len(parts) - 1)
            for part in parts:
                words += self.pretokens(part)
            ends.append(len(words))
        if not words:
            return np.array(special, np.int64)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in distinct if w not in self.known]
        if new:
            self.known.update(zip(new, count_symbols([w.encode() for w in new], self.merges).tolist(), strict=True))
        each = np.array([self.known[w] for w in distinct], np.int64)[np.asarray(coded.indices)]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))[np.array(ends)]
        return np.diff(total) + np.array(special, np.int64)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, n_bytes, n_tokens and over_limit of every row of docs.

    tokenizer: path of a byte-level BPE file; the driver reads it and broadcasts its text, whose size
    is that of the file, whatever the corpus holds.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(spec.value)
        for batch in batches:
            for part in chunks(batch, "_text"):
                n = counter.count(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("n_bytes"), pa.array(n)], names=["_id", "n_bytes", "n_tokens"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_).alias("_id"), whole.alias("_text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
