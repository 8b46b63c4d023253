"""The best rows of many queries, kept block by block inside a task."""

from __future__ import annotations

import numpy as np


class Best:
    """The k best rows of each query so far: more are held for a while and then cut."""

    def __init__(self, queries: int, k: int):
        self.k, self.room = k, max(1 << 16, 4 * queries * k)
        self.floor = np.full(queries, -np.inf)  # what a further row must reach
        self.last = np.full(queries, np.iinfo(np.int64).max)  # and the id it must stay below if it just reaches it
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, first: int, ids: np.ndarray, score: np.ndarray) -> None:
        """score: rows by queries, these from `first` on."""
        least = self.floor[first : first + score.shape[1]]
        if len(ids) > self.k:  # ties at the edge stay, for the smaller id to win
            least = np.maximum(least, np.partition(score, len(ids) - self.k, axis=0)[len(ids) - self.k])
        floor, last = self.floor[first : first + score.shape[1]], self.last[first : first + score.shape[1]]
        row, query = np.nonzero((score >= least) & ((score > floor) | (ids[:, None] < last)))
        self.parts.append((first + query, ids[row], score[row, query]))
        self.held += len(row)
        if self.held > self.room:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *self.parts))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(begin, np.diff(begin, append=len(query)))
        last = place == self.k - 1
        self.floor[query[last]], self.last[query[last]] = score[last], ids[last]
        keep = place < self.k
        self.parts = [(query[keep], ids[keep], score[keep])]
        self.held = int(keep.sum())
        return self.parts[0]
