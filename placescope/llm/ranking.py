"""The best rows of many searches in one task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NONE, ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Best:
    """The best rows so far of numbered searches: greatest product first, then smallest id."""

    searches: int
    keep: int

    def __post_init__(self) -> None:
        self.search, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least, self.last = np.full(self.searches, NONE), np.full(self.searches, ALL)

    def improving(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a score matrix, a search a row, that may come in: better than what is kept and among a row's best."""
        least, last = self.least[search], self.last[search]
        if score.shape[1] > self.keep:
            own = np.partition(np.where(fits, score, NONE), score.shape[1] - self.keep, axis=1)[:, -self.keep]
            last = np.where(own > least, ALL, last)
            least = np.maximum(own, least)
        return np.nonzero(fits & ((score > least[:, None]) | ((score == least[:, None]) & (ids[None, :] <= last[:, None]))))

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(search):
            return
        search, score, ids = np.concatenate([self.search, search]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, search))  # ~x falls as x rises, without overflow
        search, score, ids = search[order], score[order], ids[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        kept = place < self.keep
        self.search, self.score, self.id = search[kept], score[kept], ids[kept]
        full = place == self.keep - 1
        self.least[search[full]], self.last[search[full]] = score[full], ids[full]
