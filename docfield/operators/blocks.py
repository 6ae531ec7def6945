"""The k best rows of each request, kept by one task over the blocks of rows that it sees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Scores that one step computes, and candidates held before they are thinned out.
PAIRS, HELD = 1 << 20, 1 << 20
DIGITS = 6


class TopK:
    """Candidates (request, score, keys); ties go by keys."""

    def __init__(self, requests: int, k: int):
        self.n, self.k, self.keys = requests, k, []
        self.request, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(requests, -np.inf)  # the k-th best so far

    def add(self, row: np.ndarray, code: np.ndarray, part: np.ndarray, first: np.ndarray, request: np.ndarray, w: np.ndarray, keys: list[np.ndarray]) -> None:
        """Terms of some rows (row, ascending; the term's number; its part of a score), and the requests of each term: request[first[t]:first[t + 1]] with weights w."""
        if not self.keys:
            self.keys = [x[:0] for x in keys]
        count = first[code + 1] - first[code]
        rows_at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if row.size else np.zeros(0, np.int64)
        done = np.cumsum(count)
        start = 0
        while start < rows_at.size:  # whole rows, about PAIRS scores' parts at a time
            base = done[rows_at[start] - 1] if rows_at[start] else 0
            stop = max(start + 1, int(np.searchsorted(done[np.r_[rows_at[1:], row.size] - 1], base + PAIRS, side="right")))
            a, b = rows_at[start], rows_at[stop] if stop < rows_at.size else row.size
            self._step(row[a:b], code[a:b], part[a:b], count[a:b], first, request, w, keys)
            start = stop

    def _step(self, row, code, part, count, first, request, w, keys) -> None:
        of = np.repeat(np.arange(code.size), count)
        at = first[code][of] + np.arange(of.size) - np.repeat(np.cumsum(count) - count, count)
        low = int(row[0])
        cell = (row[of] - low) * self.n + request[at]
        cells, inverse = np.unique(cell, return_inverse=True)
        score = np.round(np.bincount(inverse, weights=part[of] * w[at], minlength=cells.size), DIGITS)
        who = cells % self.n
        good = score >= self.least[who]
        which = cells[good] // self.n + low
        self.request, self.score = np.r_[self.request, who[good]], np.r_[self.score, score[good]]
        self.keys = [np.concatenate([old, new[which]]) for old, new in zip(self.keys, keys, strict=True)]
        if self.request.size > HELD:
            self._thin()

    def _thin(self) -> None:
        order = np.lexsort([*reversed(self.keys), -self.score, self.request])
        who = self.request[order]
        rank = np.arange(order.size) - np.searchsorted(who, who)
        order = order[rank < self.k]
        last = rank[rank < self.k] == self.k - 1
        self.request, self.score, self.keys = self.request[order], self.score[order], [x[order] for x in self.keys]
        self.least[self.request[last]] = self.score[last]

    def batches(self, ids: list, id_type: pa.DataType, kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
        """The k best of each request; kinds: types of the key columns, in order."""
        if not self.request.size:
            return
        self._thin()
        keys = [pa.array(x, kind) for kind, x in zip(kinds.values(), self.keys, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([ids[n] for n in self.request.tolist()], id_type), *keys, pa.array(self.score)], ["request_id", *kinds, "score"])
