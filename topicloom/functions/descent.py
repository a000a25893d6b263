"""Vectorised steps of the factorisation on the rows of one Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def as_matrix(column: pa.Array, k: int) -> np.ndarray:
    """Array column with k numbers per row -> rows × k."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def as_lists(matrix: np.ndarray) -> pa.Array:
    rows, k = matrix.shape
    offsets = np.arange(0, (rows + 1) * k, k) if k else np.zeros(rows + 1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel()))


class Rows:
    """Sparse rows: row numbers, term numbers and values of all cells."""

    def __init__(self, lengths: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        self.n = len(lengths)
        self.row = np.repeat(np.arange(self.n), lengths)
        self.term, self.value = term, value

    @classmethod
    def of_block(cls, batch: pa.RecordBatch, i: int) -> Rows:
        """Rows of one block of a batch with packed ``lengths``, ``terms`` and ``values``."""
        kinds = {"lengths": "<i4", "terms": "<i4", "values": "<f8"}
        return cls(*[np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds.items()])

    def times(self, h: np.ndarray) -> np.ndarray:
        """Rows times a term factor, one column at a time to keep memory at one number per cell."""
        columns = [
            np.bincount(self.row, self.value * np.ascontiguousarray(h[:, j])[self.term], self.n)
            for j in range(h.shape[1])
        ]
        return np.stack(columns, axis=1)

    def add_transposed(self, f: np.ndarray, into: np.ndarray) -> None:
        """Add the transposed rows times a row factor to a term factor."""
        for j in range(f.shape[1]):
            column = np.ascontiguousarray(f[:, j])
            into[:, j] += np.bincount(self.term, self.value * column[self.row], len(into))


def coordinate_pass(rows: np.ndarray, target: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Update every row in place, coordinate by coordinate; returns the projected-gradient sums."""
    violation = np.zeros(len(rows))
    for t in range(len(g)):
        slope = rows @ g[:, t] - target[:, t]
        violation += np.abs(np.where(rows[:, t] == 0, np.minimum(slope, 0), slope))
        if g[t, t] != 0:
            rows[:, t] = np.maximum(rows[:, t] - slope / g[t, t], 0)
    return violation


def solve_rows(
    target: np.ndarray, g: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-8, passes: int = 1000
) -> np.ndarray:
    """Non-negative rows that minimise ½·rows·g·rowsᵀ − target·rowsᵀ, each to its own precision.

    Without ``start`` a row begins at the positive part of its unconstrained minimum. A row is done when its
    projected gradient is at most ``tol`` of its target, so it does not matter which rows come together.
    """
    if start is None:
        ridge = 1e-12 * max(float(np.trace(g)), 1e-300) * np.eye(len(g))
        start = np.maximum(np.linalg.solve(g + ridge, target.T).T, 0)
    rows = start.copy()
    enough = tol * np.abs(target).sum(axis=1)
    active = np.arange(len(rows))
    for _ in range(passes):
        part = rows[active]
        going = coordinate_pass(part, target[active], g) > enough[active]
        rows[active] = part
        active = active[going]
        if not len(active):
            break
    return rows


def projected(rows: np.ndarray, slope: np.ndarray) -> float:
    """Sum of the projected gradient: at zero only a negative slope counts."""
    return float(np.abs(np.where(rows == 0, np.minimum(slope, 0), slope)).sum())
