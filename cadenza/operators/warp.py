"""Dynamic time warping of pairs of sequences.

A pair's cost matrix is never stored. Its cells are filled one anti-diagonal
after the other, as each depends on the two before it alone, and only every
root-th pair of diagonals is kept (of a small pair all moves are). On the way back the diagonals between two
kept ones are filled again, now with their moves, so a pair of n by m takes
memory of the order of n times the root of n + m.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Moves into a cell: from the diagonal, from above, from the left.
DIAGONAL, DOWN, RIGHT = 0, 1, 2

#: Moves, one byte each, that are kept without being filled again.
SMALL = 1 << 20

Cost = Callable[[np.ndarray, np.ndarray], np.ndarray]


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cost of elements against elements: how far numbers are apart."""
    return np.abs(x - y)


class _Pair:
    def __init__(self, a: np.ndarray, b: np.ndarray, cost: Cost):
        self.a, self.b, self.cost = a, b, cost
        self.n, self.m = len(a), len(b)

    def next(self, k: int, two: np.ndarray, one: np.ndarray, moves: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Totals of the cells i + j = k (by i, counted from 1) from those of the two diagonals before, and with ``moves`` how each is reached."""
        i = np.arange(max(1, k - self.m), min(self.n, k - 1) + 1)
        come = np.stack([two[i - 1], one[i - 1], one[i]])
        # A diagonal step only if it is strictly the best, a step down only if it beats both others.
        strict = [(come[x] < come[[y for y in range(3) if y != x]]).all(0) for x in (DIAGONAL, DOWN)]
        move = np.where(strict[0], DIAGONAL, np.where(strict[1], DOWN, RIGHT))
        out = np.full(self.n + 1, np.inf)
        out[i] = self.cost(self.a[i - 1], self.b[k - i - 1]) + np.take_along_axis(come, move[None], 0)[0]
        if not moves:
            return out, None
        how = np.full(self.n + 1, RIGHT, dtype=np.int8)
        how[i] = move
        return out, how

    def path(self) -> np.ndarray:
        """Cells of the cheapest path from the first to the last, as rows (i, j) from 0."""
        n, m = self.n, self.m
        if not n or not m:
            return np.zeros((0, 2), dtype=np.int64)
        # A small pair's moves are kept as they come.
        small, moves = n * (n + m) <= SMALL, {}
        step = n + m + 1 if small else isqrt(n + m) + 1
        two, one = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
        two[0] = 0.0
        kept = {1: (two, one)}
        for k in range(2, n + m + 1):
            new, how = self.next(k, two, one, small)
            two, one = one, new
            if small:
                moves[k] = how
            elif k % step == 1:
                kept[k] = (two, one)
        i, j, out = n, m, []
        for k0 in sorted(kept, reverse=True):
            if i + j <= k0:
                continue
            two, one = kept[k0]
            if not small:
                moves = {}
                for k in range(k0 + 1, i + j + 1):
                    new, moves[k] = self.next(k, two, one, True)
                    two, one = one, new
            while i and j and i + j > k0:
                out.append((i - 1, j - 1))
                how = moves[i + j][i]
                i, j = i - (how != RIGHT), j - (how != DOWN)
        return np.array(out[::-1], dtype=np.int64)


def path(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest path through a matrix of costs, none if it is empty.

    A diagonal step is taken only if it is strictly the best, a step down only
    if it beats both others, else a step right.
    """
    n, m = cost.shape
    return [tuple(x) for x in _Pair(np.arange(n), np.arange(m), lambda i, j: cost[i, j]).path().tolist()]


def _paths(a: np.ndarray, b: np.ndarray, cost: Cost) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair, step, i and j of the cheapest paths of small pairs of the same lengths (one a row), filled side by side."""
    p, n, m = len(a), a.shape[1], b.shape[1]
    two, one = np.full((p, n + 1), np.inf), np.full((p, n + 1), np.inf)
    two[:, 0] = 0.0
    moves = np.full((n + m + 1, p, n + 1), RIGHT, dtype=np.int8)
    flat = lambda x: x.reshape(-1, *x.shape[2:])
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        x, y, z = two[:, i - 1], one[:, i - 1], one[:, i]
        diagonal, down = (x < y) & (x < z), (y < x) & (y < z)
        moves[k][:, i] = np.where(diagonal, DIAGONAL, np.where(down, DOWN, RIGHT))
        new = np.full((p, n + 1), np.inf)
        new[:, i] = cost(flat(a[:, i - 1]), flat(b[:, k - i - 1])).reshape(p, len(i)) + np.where(diagonal, x, np.where(down, y, z))
        two, one = one, new
    rows, i, j, cells = np.arange(p), np.full(p, n), np.full(p, m), []
    while ((i > 0) & (j > 0)).any():
        cells.append((i - 1, j - 1))
        on, how = (i > 0) & (j > 0), moves[i + j, rows, i]
        i, j = i - (on & (how != RIGHT)), j - (on & (how != DOWN))
    at = np.array(cells[::-1], dtype=np.int64).transpose(2, 0, 1)
    # A shorter path has stayed on its last cell, outside of the matrix.
    pair, place = np.nonzero((at >= 0).all(2))
    i, j = at[pair, place].T
    return pair, np.arange(len(pair)) - np.searchsorted(pair, pair), i, j


def warp(pairs: DataFrame, cost: Cost = distance) -> DataFrame:
    """``pair_id, step, i, j`` for each of ``pairs`` (``pair_id``, ``a`` and ``b``, arrays of numbers or of arrays of them).

    ``cost`` gets as many elements of ``a`` as of ``b`` and returns their costs.
    A pair whose sequence is null or empty has no path.
    """

    names = ["pair_id", "step", "i", "j"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            alike: dict[tuple[int, int], list[int]] = {}
            for row in range(batch.num_rows):
                n, m = (len(batch.column(c)[row]) if batch.column(c)[row].is_valid else 0 for c in ("a", "b"))
                if n and m:
                    alike.setdefault((n, m), []).append(row)
            for (n, m), rows in alike.items():
                # Small pairs of the same lengths are filled together, as many as 16 MB of moves allow.
                many = max(1, (1 << 24) // ((n + 1) * (n + m + 1))) if n * (n + m) <= SMALL else 1
                for at in range(0, len(rows), many):
                    some = rows[at : at + many]
                    a, b = (np.array(batch.column(c).take(pa.array(some)).to_pylist(), dtype=float) for c in ("a", "b"))
                    if n * (n + m) <= SMALL:
                        pair, step, i, j = _paths(a, b, cost)
                    else:
                        i, j = _Pair(a[0], b[0], cost).path().T
                        pair, step = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
                    number = batch.column("pair_id").take(pa.array(np.array(some)[pair])).cast(pa.int64())
                    for lo in range(0, len(pair), 1 << 16):
                        yield pa.RecordBatch.from_arrays([number[lo : lo + (1 << 16)], *(pa.array(np.ascontiguousarray(x[lo : lo + (1 << 16)])) for x in (step, i, j))], names=names)

    # A pair is much work for one row, so pairs are dealt over all tasks.
    return pairs.select("pair_id", "a", "b").repartition("pair_id").mapInArrow(run, "pair_id long, step long, i long, j long")
