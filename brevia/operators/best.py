"""The best units of many queries, kept by each task for its own rows: what is shuffled is bounded by the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores nearer than this may be equal at the nine places to which they are compared later.
NEAR = 2e-9


class Best:
    """For each of `queries`, the units that can be among the best `most` by (score to nine places, then lower unit)."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.least = np.full(queries, -np.inf)
        self.held: list = [None] * queries

    def add(self, units: np.ndarray, scores: np.ndarray, real: np.ndarray | None = None) -> None:
        """scores: a row a query, a column a unit; real: where a unit takes part, else everywhere."""
        wanted = scores >= self.least[:, None]
        if real is not None:
            wanted &= real
        for q in np.flatnonzero(wanted.any(axis=1)).tolist():
            at = np.flatnonzero(wanted[q])
            s, u = scores[q, at], units[at]
            if self.held[q] is not None:
                s, u = np.append(self.held[q][0], s), np.append(self.held[q][1], u)
            if len(s) > self.most:
                s, u = self._cut(s, u)
                self.least[q] = np.partition(s, -self.most)[-self.most] - NEAR
            self.held[q] = s, u

    def _cut(self, s: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of scores that may be equal to the last one that counts, each value keeps its lowest units."""
        last = np.partition(s, -self.most)[-self.most]
        keep = np.flatnonzero(s > last + NEAR)
        border = np.flatnonzero(np.abs(s - last) <= NEAR)
        if len(keep) + len(border) > 2 * self.most:
            value = np.round(s[border], 10)
            order = np.lexsort((u[border], value))
            new = np.append(True, value[order][1:] != value[order][:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            border = border[order[np.arange(len(order)) - begin < self.most]]
        keep = np.append(keep, border)
        return s[keep], u[keep]

    def batches(self, qids: pa.Array, kind: pa.DataType):
        """(qid, unit, score) of what is held; kind: the type of a unit."""
        for q, found in enumerate(self.held):
            if found is not None:
                s, u = found
                yield pa.RecordBatch.from_arrays([pa.array([qids[q].as_py()] * len(s), qids.type), pa.array(u.tolist(), kind), pa.array(s)], names=["qid", "unit", "score"])


def ids(column: pa.Array) -> np.ndarray:
    """Ids as an array that can be ordered; strings as Python's, whose order is that of their UTF-8."""
    return np.array(column.to_pylist(), object) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)
