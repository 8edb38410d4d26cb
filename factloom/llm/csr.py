"""Sparse 0/1 and count matrices in compressed rows, built by hand, with Gustavson's row-wise product."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Row r holds the columns ``columns[start[r]:start[r + 1]]`` with ``values`` beside them; ``width`` columns in all."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> Rows:
        """A stable counting sort by column: the rows of a column stay in order."""
        order = np.argsort(self.columns, kind="stable")
        start = np.zeros(self.width + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=start[1:])
        rows = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        return Rows(start, rows[order], self.values[order], len(self.start) - 1)

    def times(self, other: Rows) -> Rows:
        """Row i of the product gathers, for each entry (i, k), row k of ``other`` times that entry; equal columns are added up."""
        size = np.diff(other.start)[self.columns]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(other.start[:-1][self.columns] - (ends - size), size)
        row = np.repeat(np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)), size)
        key = row * np.int64(max(1, other.width)) + other.columns[at]
        value = np.repeat(self.values, size) * other.values[at]
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        values = np.add.reduceat(value, first) if len(first) else value
        row, columns = np.divmod(key[first], np.int64(max(1, other.width)))
        start = np.zeros(len(self.start), np.int64)
        np.cumsum(np.bincount(row, minlength=len(self.start) - 1), out=start[1:])
        return Rows(start, columns, values, other.width)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of each entry, row by row."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)), self.columns, self.values


def spans(ends: np.ndarray) -> Rows:
    """Incidence of consecutive pieces with the bytes they cover: piece r covers ends[r - 1] up to ends[r]."""
    start = np.r_[0, ends].astype(np.int64)
    return Rows(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))


def members(group: np.ndarray, n_groups: int) -> Rows:
    """Incidence of items with the one group that each belongs to."""
    return Rows(np.arange(len(group) + 1), group.astype(np.int64), np.ones(len(group), np.int64), n_groups)
