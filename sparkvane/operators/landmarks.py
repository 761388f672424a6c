"""Landmark features of the Gaussian kernel by a pivoted partial Cholesky factorisation.

The features of x are those of its kernel values with some rows, the landmarks, made orthogonal; their
dot products are the kernel itself for landmarks, and what they miss of a row's own kernel value (1) is
its residual. Landmarks are the rows of largest residual, each chosen with the residuals that the ones
before it leave. A pass over the rows gives the rows of largest residual and the mean one, which is the
share of the kernel's trace that is missed; STEP landmarks at most are taken from a pass. It ends when
that share is at most `error` or there are `most` landmarks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR, MOST, STEP, CANDIDATES, CELLS, SLICE = 0.01, 256, 32, 64, 256, 8192
Map = Callable[[np.ndarray], np.ndarray]


def gaussian(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0.0))


class Factor:
    """Landmarks and the inverse of their kernel's Cholesky factor, which turns kernel values into features."""

    def __init__(self, width: int, gamma: float):
        self.gamma, self.points, self.inverse, self.missed = gamma, np.zeros((0, width)), np.zeros((0, 0)), 1.0

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return gaussian(x, self.points, self.gamma) if len(self.points) else np.zeros((len(x), 0))

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.inverse.T

    def residuals(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(1.0 - (self.features(x) ** 2).sum(axis=1), 0.0)

    def take(self, candidates: np.ndarray, n: int, least: float) -> int:
        """Add up to n of the candidates, each the one of largest residual then, while that is over `least`; how many were added."""
        for k in range(n):
            left = self.residuals(candidates)
            best = int(left.argmax())
            if left[best] <= least:
                return k
            row = self.features(candidates[best : best + 1])[0]
            grown = np.zeros((len(self.points) + 1,) * 2)
            # The factor has one more row, (row, root); of its inverse follows one more row, too.
            root = np.sqrt(left[best])
            grown[:-1, :-1] = self.inverse
            grown[-1, :-1], grown[-1, -1] = -row @ self.inverse / root, 1 / root
            self.points, self.inverse = np.concatenate([self.points, candidates[best : best + 1]]), grown
        return n


def chosen(width: int, gamma: float, one_pass: Callable[[Factor], tuple[np.ndarray, float]], error: float = ERROR, most: int = MOST) -> Factor:
    """Landmarks from passes that give the rows of largest residual, in a fixed order, and the mean residual."""
    out = Factor(width, gamma)
    while True:
        candidates, out.missed = one_pass(out)
        # Rows that miss less than half of what is still to be missed on average are left to a later pass, if any.
        if out.missed <= error or len(out.points) >= most or not len(candidates) or not out.take(candidates, min(STEP, most - len(out.points)), max(out.missed / 2, 1e-9)):
            return out


def _largest(x: np.ndarray, residual: np.ndarray, n: int) -> np.ndarray:
    """The n different rows of largest residual; by their values on ties, so that the order of rows does not matter."""
    if len(x) > 4 * n:
        # Sorting rows takes long: those that are as large as the 4n-th, if they are enough different ones.
        least = np.partition(residual, len(x) - 4 * n)[len(x) - 4 * n]
        some = np.flatnonzero(residual >= least)
        if len(some) < len(x) and len(own := _largest(x[some], residual[some], n)) == n:
            return some[own]
    found, first = np.unique(x, axis=0, return_index=True)
    order = np.lexsort((*found.T[::-1], -residual[first]))
    return first[order[:n]]


def _best(of: list[tuple[np.ndarray, np.ndarray]], gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Of several sets of rows with their residuals, in a fixed order: the CANDIDATES different rows of largest residual, and the largest of each cell.

    Rows of largest residual lie close together, and one of them taken leaves little of the others;
    those of cells of half a kernel's width lie apart, so that a pass gives many landmarks. Cells are
    filed in CELLS by a hash.
    """
    x, left = (np.concatenate(v) for v in zip(*of, strict=True))
    if not len(x):
        return x, left
    at = np.floor(x * (2 * math.sqrt(gamma))).astype(np.int64) @ (np.arange(x.shape[1], dtype=np.int64) * 2 + 1) ** 5 % CELLS
    top = np.full(CELLS, -np.inf)
    np.maximum.at(top, at, left)
    tied = np.flatnonzero(left == top[at])
    tied = tied[np.lexsort((*x[tied].T[::-1], at[tied]))]
    keep = np.union1d(_largest(x, left, CANDIDATES), tied[np.unique(at[tied], return_index=True)[1]])
    keep = keep[np.lexsort((*x[keep].T[::-1], -left[keep]))]
    return x[keep], left[keep]


def _joined(got: list[dict], width: int, gamma: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The largest of what several tasks gave, the sum of residuals and the number of rows."""
    of = [(np.frombuffer(bytes(r["rows"]), "<f8").reshape(-1, width), np.frombuffer(bytes(r["left"]), "<f8")) for r in got]
    best, left = _best([(np.zeros((0, width)), np.zeros(0)), *of], gamma)
    return best, left, float(sum(r["total"] for r in got)), sum(r["n"] for r in got)


def local_landmarks(x: np.ndarray, gamma: float, error: float = ERROR, most: int = MOST) -> Factor:
    """Landmarks of rows that are at hand."""

    def one_pass(factor: Factor) -> tuple[np.ndarray, float]:
        left = factor.residuals(x)
        return _best([(x, left)], gamma)[0], float(left.mean()) if len(x) else 0.0

    return chosen(x.shape[1], gamma, one_pass, error, most)


def landmarks(rows: DataFrame, columns: list[str], gamma: float, error: float = ERROR, most: int = MOST, count: str | None = None) -> Factor:
    """Landmarks of any number of rows (each stands for `count` ones): a task gives its rows of largest residual, of all and by cell, and the largest of all tasks go to the driver."""
    own = rows.select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)), (F.col(count) if count else F.lit(1)).cast("long").alias("_n"))
    names = own.columns[:-1]

    parts = rows.rdd.getNumPartitions()
    groups = math.ceil(math.sqrt(parts)) if parts > 16 else parts
    kinds = "g long, left binary, rows binary, total double, n long"

    def one_pass(factor: Factor) -> tuple[np.ndarray, float]:
        sent = rows.sparkSession.sparkContext.broadcast(factor)

        def made(best: np.ndarray, left: np.ndarray, total: float, n: int) -> pa.RecordBatch:
            group = TaskContext.get().partitionId() % groups
            return pa.RecordBatch.from_arrays([pa.array([group]), *(pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in (left, best)), pa.array([total], pa.float64()), pa.array([n], pa.int64())], names=["g", "left", "rows", "total", "n"])

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, left, total, n = np.zeros((0, len(names))), np.zeros(0), 0.0, 0
            for batch in batches:
                x, rows_ = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], axis=1), batch.columns[-1].to_numpy()
                for s in range(0, len(x), SLICE):
                    part = x[s : s + SLICE]
                    r = sent.value.residuals(part)
                    total, n = total + float(r @ rows_[s : s + SLICE]), n + int(rows_[s : s + SLICE].sum())
                    best, left = _best([(best, left), (part, r)], gamma)
            if n:
                yield made(best, left, total, n)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if got := [r for b in batches for r in b.to_pylist()]:
                yield made(*_joined(got, len(names), gamma))

        out = own.mapInArrow(local, kinds)
        if parts > 16:
            out = out.repartition(groups, "g").mapInArrow(merged, kinds)
        best, _, total, n = _joined([r.asDict() for r in out.collect()], len(names), gamma)
        sent.destroy()
        return best, total / n if n else 0.0

    return chosen(len(columns), gamma, one_pass, error, most)
