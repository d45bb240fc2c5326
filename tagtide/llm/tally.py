"""Counts of 64-bit keys inside a task, with bounded memory."""

from __future__ import annotations

import numpy as np

from tagtide.llm.words import KeyTable


class Tally:
    """Adds up counts by key; ``limit`` keys are a sign to hand over what there is and start afresh."""

    def __init__(self, limit: int = 2_000_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.table, self.totals = KeyTable(1 << 12), np.zeros(1 << 12, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        else:
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, counts, len(keys)).astype(np.int64)
        at = self.table.find(keys)
        self.table.add(keys[at < 0])
        if self.table.n > len(self.totals):
            self.totals = np.concatenate([self.totals, np.zeros(self.table.n, np.int64)])
        self.totals[self.table.find(keys)] += counts

    @property
    def full(self) -> bool:
        return self.table.n > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.zeros(self.table.n, np.uint64)
        used = self.table.keys != 0
        keys[self.table.numbers[used]] = self.table.keys[used]
        totals = self.totals[: self.table.n]
        self._clear()
        return keys, totals
