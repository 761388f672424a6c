"""Kernel SVMs on explicit feature maps, by Newton's method on the primal.

A fit is a few passes over the rows. A pass maps each Arrow batch to its features, so these are never
stored or sent, and sums loss, gradient and curvature for every cost C at once; the sums are added up
in groups on the executors, so the driver gets about the square root of the partitions' number of them.
The loss is the hinge, rounded off by a parabola around its corner: first as widely as the first of
SMOOTH, so that every row has curvature at the start, and last within the last of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTH, PASSES, TOLERANCE, SLICE = (1.0, 0.3, 0.1), 60, 1e-4, 4096
Map = Callable[[np.ndarray], np.ndarray]


class Mixed:
    """A map whose features are fixed sums of simpler ones, raw(x) @ mix.T: sums over rows can be taken of the raw ones and mixed at the end."""

    def __init__(self, raw: Map, mix: np.ndarray):
        self.raw, self.mix = raw, mix

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) @ self.mix.T


def _raw(features: Map) -> tuple[Map, np.ndarray]:
    """The map that is summed over rows, and what mixes its features and the offset's."""
    if not isinstance(features, Mixed):
        return features, np.eye(0)
    whole = np.eye(len(features.mix) + 1)
    whole[:-1, :-1] = features.mix
    return features.raw, whole


def sums(phi: np.ndarray, sign: np.ndarray, weights: np.ndarray, smooth: float, n: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature over rows of features (a last one of ones is the offset's) with signs -1 and 1; n: how many rows each stands for."""
    t = sign * (phi @ weights)
    corner, beyond = np.abs(1 - t) <= smooth, t < 1 - smooth
    gap = 1 + smooth - t[corner]
    n = np.ones(len(phi)) if n is None else n
    loss = float((n[corner] * gap * gap).sum() / (4 * smooth) + (n[beyond] * (1 - t[beyond])).sum())
    gradient = -(phi[corner].T @ (n[corner] * sign[corner] * gap / (2 * smooth)) + phi[beyond].T @ (n[beyond] * sign[beyond]))
    # A product with its own transpose takes half the work.
    curved = phi[corner] * np.sqrt(n[corner] / (2 * smooth))[:, None]
    return loss, gradient, curved.T @ curved


def _added(rows: Iterator[bytes]) -> np.ndarray | None:
    total = None
    for raw in rows:
        own = np.frombuffer(raw, "<f8")
        total = own.copy() if total is None else total + own
    return total


def fit(rows: DataFrame, columns: list[str], y: str, features: Map, costs: list[float], parts: int, count: str | None = None) -> list[tuple[np.ndarray, float]]:
    """Weights and offset for each cost; rows in about `parts` partitions, each of which stands for `count` ones."""
    own = rows.select(*(F.col(c).cast("double") for c in columns), F.col(y).cast("double"), (F.col(count) if count else F.lit(1)).cast("double").alias("_n"))
    groups = math.ceil(math.sqrt(parts)) if parts > 16 else parts
    width = features(np.zeros((1, len(columns)))).shape[1] + 1
    size = 1 + width + width * width
    features, mix = _raw(features)

    def mixed(total: np.ndarray) -> np.ndarray:
        curve = total[1 + width :].reshape(width, width)
        return np.concatenate([total[:1], mix @ total[1 : 1 + width], (mix @ curve @ mix.T).ravel()]) if len(mix) else total

    def one_pass(points: list[tuple[np.ndarray, float]]) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast([(mix.T @ w, smooth) for w, smooth in points] if len(mix) else points)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(sent.value), size))
            for batch in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                for s in range(0, len(x), SLICE):
                    phi = features(x[s : s + SLICE, :-2])
                    phi = np.concatenate([phi, np.ones((len(phi), 1))], axis=1)
                    for k, (w, smooth) in enumerate(sent.value):
                        loss, gradient, curve = sums(phi, 2 * x[s : s + SLICE, -2] - 1, w, smooth, x[s : s + SLICE, -1])
                        total[k] += np.concatenate([[loss], gradient, curve.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups]), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["g", "sums"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (total := _added(raw for b in batches for raw in b.column(1).to_pylist())) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["g", "sums"])

        made = own.mapInArrow(local, "g long, sums binary")
        if parts > 16:
            made = made.repartition(groups, "g").mapInArrow(merged, "g long, sums binary")
        total = _added(bytes(r.sums) for r in made.collect())
        sent.destroy()
        return np.zeros((len(points), size)) if total is None else np.stack([mixed(t) for t in total.reshape(len(points), size)])

    return solve(one_pass, width, costs)


def solve(one_pass: Callable[[list[tuple[np.ndarray, float]]], np.ndarray], width: int, costs: list[float]) -> list[tuple[np.ndarray, float]]:
    """Weights and offset for each cost; one_pass gives the rows' sums at some (weights, smoothing) for all costs that are not done yet."""
    ridge = np.append(np.ones(width - 1), 1e-6)
    at, step, low = [np.zeros(width) for _ in costs], [np.zeros(width) for _ in costs], [np.inf] * len(costs)
    trial, stage, live = [w.copy() for w in at], [0] * len(costs), set(range(len(costs)))
    for _ in range(PASSES):
        order = sorted(live)
        for k, got in zip(order, one_pass([(trial[k], SMOOTH[stage[k]]) for k in order]), strict=True):
            value, done = 0.5 * float(trial[k] @ (ridge * trial[k])) + costs[k] * got[0], False
            if value > low[k] + 1e-9 * abs(low[k]):
                # Too far: a quarter of the way, until the objective falls.
                step[k] = step[k] / 4
                done = np.abs(step[k]).max() < 1e-9
            else:
                at[k], low[k] = trial[k], value
                gradient = ridge * at[k] + costs[k] * got[1 : 1 + width]
                step[k] = -np.linalg.solve(np.diag(ridge) + costs[k] * got[1 + width :].reshape(width, width), gradient)
                done = -float(gradient @ step[k]) <= TOLERANCE * max(value, 1e-12)
            trial[k] = at[k] + step[k]
            if done and stage[k] < len(SMOOTH) - 1:
                stage[k], low[k], trial[k] = stage[k] + 1, np.inf, at[k]
            elif done:
                live.discard(k)
        if not live:
            break
    return [(w[:-1], float(w[-1])) for w in at]


def fit_local(x: np.ndarray, y: np.ndarray, features: Map, costs: list[float]) -> list[tuple[np.ndarray, float]]:
    """fit() on rows that are at hand, whose features are computed once."""
    phi = np.concatenate([features(x), np.ones((len(x), 1))], axis=1)
    sign = 2.0 * y - 1

    def one_pass(points: list[tuple[np.ndarray, float]]) -> np.ndarray:
        return np.stack([np.concatenate([[loss], gradient, curve.ravel()]) for loss, gradient, curve in (sums(phi, sign, w, smooth) for w, smooth in points)])

    return solve(one_pass, phi.shape[1], costs)


class Machine:
    """A fitted one: transform adds margin and prediction."""

    def __init__(self, columns: list[str], features: Map, weights: np.ndarray, offset: float):
        self.columns, self.features, self.weights, self.offset = columns, features, weights, offset

    def transform(self, df: DataFrame) -> DataFrame:
        features, mix = _raw(self.features)
        weights, offset = self.weights, self.offset
        if len(mix):
            weights = mix[:-1, :-1].T @ weights

        @F.pandas_udf("double")
        def margin(*cols: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float) for c in cols], axis=1)
            return pd.Series(np.concatenate([features(x[s : s + SLICE]) @ weights + offset for s in range(0, len(x), SLICE)]) if len(x) else np.zeros(0))

        return df.withColumn("margin", margin(*(F.col(c) for c in self.columns))).withColumn("prediction", (F.col("margin") > 0).cast("double"))
