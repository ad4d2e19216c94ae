"""A bounded cache of encoded text chunks, joined to whole-text id arrays by numpy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count, islice

import numpy as np

#: What an encoder returns for a list of chunks: all ids end to end, and the number of ids of each chunk.
Encoded = tuple[np.ndarray, np.ndarray]


def from_lists(ids: list[list[int]]) -> Encoded:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts


class ChunkCache:
    """Maps chunks of text to id arrays; ``encode`` fills in the chunks not seen before, many at a time.

    Beyond ``limit`` chunks only those asked for most often stay, at most half of them, so memory stays bounded
    whatever the vocabulary.
    """

    def __init__(self, encode: Callable[[list[str]], Encoded], limit: int = 500_000) -> None:
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        #: Gives a chunk not seen before the next number.
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _thin(self) -> None:
        """Forget what was asked for once, and more if that leaves over half of the limit; older requests count half."""
        n = len(self.index)
        hits, starts, counts, flat = self.hits[:n], self.start[:n], self.count[:n], self.flat
        least = max(2, int(np.partition(hits, n - self.limit // 2)[n - self.limit // 2]) + 1)
        kept = np.flatnonzero(hits >= least)
        chunks = list(self.index)
        self._clear()
        at = np.arange(int(counts[kept].sum())) + np.repeat(starts[kept] - (np.cumsum(counts[kept]) - counts[kept]), counts[kept])
        self.index.update(zip(map(chunks.__getitem__, kept.tolist()), self.index.default_factory.__self__))
        self._enter(0, flat[at], counts[kept])
        self.hits[:len(kept)] = hits[kept] // 2

    def _enter(self, n: int, new: np.ndarray, counts: np.ndarray) -> None:
        """Keep the ids of the chunks from number ``n`` on."""
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(counts) > len(self.start):
            self.start, self.count, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.hits))
        self.flat[self.used:self.used + len(new)] = new
        self.start[n:n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[n:n + len(counts)] = counts
        self.used += len(new)

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of chunks, end to end, and the number of ids of each text."""
        if len(self.index) > self.limit:
            self._thin()
        sizes, n = np.fromiter(map(len, texts), np.int64, len(texts)), len(self.index)
        rows = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if len(self.index) > n:
            self._enter(n, *self.encode(list(islice(reversed(self.index), len(self.index) - n))[::-1]))
        self.hits[:len(self.index)] += np.bincount(rows, minlength=len(self.index))
        counts = self.count[rows]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[rows] - (ends - counts), counts)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.flat[at], np.diff(bounds)
