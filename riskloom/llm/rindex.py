"""A run-length index of a text: the runs of its Burrows-Wheeler transform with sampled run ends.

Of a text's suffixes in sorted order, the symbols before them form the transform; in repetitive texts
it has few runs.  At each border of two runs the places of the suffixes on either side are sampled.
From one sample to the next place that is sampled, a suffix's neighbour in sorted order moves along
with it and their common length falls by one a step, so the longest match of every place with
another place streams from the samples alone.
"""

from __future__ import annotations

import numpy as np


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and of each key the place in it of the first key equal to it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    name = np.empty(len(keys), np.int64)
    name[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return order, name


class RunLengthIndex:
    def __init__(self, data: np.ndarray):
        """data: bytes; the text's end is smaller than any byte."""
        n = self.n = len(data)
        padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)))
        keys = np.zeros(n, np.uint64)
        for i in range(7):  # seven symbols of nine bits
            keys = keys << np.uint64(9) | padded[i : i + n]
        order, name = _names(keys)
        self.names = [(7, name.astype(np.int32))]  # equal names: as many first symbols are equal
        size = 7
        while n:
            # Only suffixes that share their name with another are still to be told apart.
            taken = np.bincount(name, minlength=n)
            open_ = np.flatnonzero(taken[name] > 1)
            if not len(open_):
                break
            after = np.where(open_ + size < n, name[np.minimum(open_ + size, n - 1)] + 1, 0)
            rank = np.argsort(name[open_] * (n + 1) + after, kind="stable")
            moved, key = open_[rank], (name[open_] * (n + 1) + after)[rank]
            base = name[moved]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.concatenate(([True], base[1:] != base[:-1]))
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(group, at, 0))
            order[base + at - start] = moved
            name = name.copy()
            name[moved] = base + np.maximum.accumulate(np.where(new, at, 0)) - start
            size *= 2
            self.names.append((size, name.astype(np.int32)))
        before = np.where(order > 0, data[order - 1].astype(np.int16), -1) if n else np.zeros(0, np.int16)
        head = np.flatnonzero(before[1:] != before[:-1]) + 1
        #: Symbols and lengths of the runs, and the places of the suffixes at either side of each border.
        self.symbols = before[np.concatenate(([0], head))] if n else before
        self.lengths = np.diff(np.concatenate(([0], head, [n])))
        self.begins, self.ends = order[head], order[head - 1]
        self.first, self.last = (order[0], order[-1]) if n else (0, 0)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings of suffixes a and b."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for size, name in reversed(self.names):
            for _ in range(2):
                inside = np.flatnonzero((a < self.n) & (b < self.n))
                same = inside[name[a[inside]] == name[b[inside]]]
                out[same] += size
                a[same] += size
                b[same] += size
        # Less than the first size is left.
        for _ in range(self.names[0][0]):
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = inside[self.text[a[inside]] == self.text[b[inside]]]
            if not len(same):
                break
            out[same] += 1
            a[same] += 1
            b[same] += 1
        return out

    def matches(self, data: np.ndarray) -> np.ndarray:
        """For each place of data, the indexed text itself, the longest match with another place."""
        self.text = data
        best = np.zeros(self.n, np.int64)
        if self.n < 2:
            return best
        for sample, beside, bare in ((self.begins, self.ends, self.first), (self.ends, self.begins, self.last)):
            length = self.common(sample, beside)
            place = np.append(sample, bare)
            length = np.append(length, 0)
            order = np.argsort(place)
            place, length = place[order], length[order]
            which = np.searchsorted(place, np.arange(self.n), "right") - 1
            known = which >= 0
            fall = length[which] - (np.arange(self.n) - place[which])
            best = np.maximum(best, np.where(known, fall, 0))
        return best
