"""Small numpy helpers for tasks that link rows of one bucket."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def components_of(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable from every row of a symmetric boolean matrix."""
    n = len(near)
    label = np.arange(n)
    linked = near | np.eye(n, dtype=bool)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def run_starts(rows: np.ndarray, width: int) -> np.ndarray:
    """Where runs of equal leading ``width`` columns start in sorted rows."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    change = np.any(rows[1:, :width] != rows[:-1, :width], axis=1)
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def sorted_runs(batches: Iterable[pa.RecordBatch], width: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Runs of equal leading ``width`` columns in a sorted stream of long columns.

    Yields (rows, starts of the runs in them, False) for whole runs of at most ``limit`` rows, many at a time, and
    (rows, [0], True) for each consecutive part of a longer run. Never holds much more than a batch and ``limit`` rows.
    """
    one = np.zeros(1, dtype=np.int64)
    rest, begun = None, False  # begun: a part of the run at the end has been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows = new if rest is None else np.concatenate([rest, new])
        starts = run_starts(rows, width)
        if begun and len(starts) > 1:
            yield rows[:starts[1]], one, True
            rows, starts, begun = rows[starts[1]:], starts[1:] - starts[1], False
        if starts[-1]:
            yield from _whole_runs(rows[:starts[-1]], starts[:-1], limit)
        rest = rows[starts[-1]:]
        while len(rest) > limit:  # leaves at least one row
            yield rest[:limit], one, True
            rest, begun = rest[limit:], True
    if rest is not None:
        if begun:
            yield rest, one, True
        else:
            yield from _whole_runs(rest, one, limit)


def _whole_runs(rows: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    sizes = np.diff(np.append(starts, len(rows)))
    for at in np.flatnonzero(sizes > limit):
        for a in range(starts[at], starts[at] + sizes[at], limit):
            yield rows[a:min(a + limit, starts[at] + sizes[at])], np.zeros(1, dtype=np.int64), True
    fits = sizes <= limit
    if fits.any():
        short = sizes[fits]
        yield rows[np.repeat(fits, sizes)], np.cumsum(short) - short, False
