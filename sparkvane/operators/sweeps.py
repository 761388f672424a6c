"""Sweeps of many bounded fits, all in one job.

The protocol fixes the rows of its samples, so the rows of a fit are few whatever the table's size, and
what costs time is the number of fits. A unit is one model on the rows of one seed (or fold) and feature
set, with all cells of its grid and all its training sizes: rows carry the units that they belong to,
a task gets the rows of a unit, fits its cells in shared steps (one forest whose first trees and levels
are the smaller ones', one chain of boosted trees whose beginning is the shorter one's, Newton steps
over features that are computed once) and gives scores of the rows to be judged. Metrics of all runs
are then counted at once by key. A task holds at most MOST rows; beyond that fit with models.FITTERS,
which take any number of rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, landmarks, svm, trees

MOST = 250_000
Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]

_OUT = pa.schema([("unit", pa.int32()), ("n_train", pa.int32()), ("grid_pos", pa.int32()), ("split", pa.string()), ("y", pa.int32()), ("score", pa.float64()), ("pred", pa.int32()), ("f1", pa.float64()), ("status", pa.string())])
_OUT_DDL = "unit int, n_train int, grid_pos int, split string, y int, score double, pred int, f1 double, status string"


def state_features(reps: int = 2) -> svm.Map:
    """The explicit map of the fidelity kernel."""
    return lambda x: kernel.explicit_map(kernel.states(x, reps))


def _probable(score: Callable[[np.ndarray], np.ndarray]) -> Scorer:
    def judged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = score(x)
        return p, (p > 0.5).astype(np.int32)

    return judged


def forests(x: np.ndarray, y: np.ndarray, keys: np.ndarray, grid: list[dict], seed: int) -> list[Scorer]:
    """The cells of a grid of trees, depth and leaf: one forest for each leaf, of which each cell is the first trees and levels."""
    edges = trees.quantile_edges(x, trees.BINS)
    bins, out = trees.binned(x, edges), {}
    for leaf in sorted({p.get("leaf", 1) for p in grid}):
        own = [(k, p) for k, p in enumerate(grid) if p.get("leaf", 1) == leaf]
        # The trees that only shallow cells want need not be grown deep.
        deep = {k: min(p["depth"] or 30, 30) for k, p in own}
        most = sorted({p["trees"] for _, p in own})
        made: list[trees.Tree] = []
        for low, high in zip([0, *most], most, strict=False):
            depth = max(deep[k] for k, p in own if p["trees"] >= high)
            made += trees.local_forest(bins, y, keys, range(low, high), depth, leaf, seed)
        for k, p in own:
            arrays = [t.arrays(deep[k]) for t in made[: p["trees"]]]
            out[k] = _probable(lambda v, arrays=arrays: trees.forest_scores(trees.binned(v, edges), arrays))
    return [out[k] for k in range(len(grid))]


def boosters(x: np.ndarray, y: np.ndarray, keys: np.ndarray, grid: list[dict], seed: int) -> list[Scorer]:
    """The cells of a grid of rounds, rate and depth: one chain for each rate and depth, whose beginning a shorter cell is."""
    edges = trees.quantile_edges(x, trees.BOOSTING_BINS)
    chains: dict[tuple, trees.Chain] = {}
    for p in grid:
        c = chains.setdefault((p["rate"], p["depth"]), trees.Chain(0, p["rate"], p["depth"]))
        c.rounds = max(c.rounds, p["rounds"])
    trees.local_boosted(trees.binned(x, edges), y, list(chains.values()))
    out = []
    for p in grid:
        c = chains[p["rate"], p["depth"]]
        arrays = [t.arrays() for t in c.trees[: p["rounds"]]]
        out.append(_probable(lambda v, c=c, arrays=arrays: trees.boosted_scores(trees.binned(v, edges), c.base, arrays)))
    return out


def _machines(x: np.ndarray, y: np.ndarray, features: svm.Map, scale: Callable[[np.ndarray], np.ndarray], costs: list[float]) -> list[Scorer]:
    def scorer(w: np.ndarray, b: float) -> Scorer:
        def judged(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            margin = np.concatenate([features(scale(v[s : s + svm.SLICE])) @ w + b for s in range(0, len(v), svm.SLICE)]) if len(v) else np.zeros(0)
            return margin, (margin > 0).astype(np.int32)

        return judged

    return [scorer(w, b) for w, b in svm.fit_local(scale(x), y, features, costs)]


def gaussian_machines(x: np.ndarray, y: np.ndarray, keys: np.ndarray, grid: list[dict], seed: int) -> list[Scorer]:
    """The cells of a grid of c and gamma on standard scores; gamma `scale` and `auto` are 1 / columns."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1.0
    width = lambda p: p["gamma"] if isinstance(p.get("gamma"), float) else 1 / x.shape[1]
    out: dict[int, Scorer] = {}
    for g in sorted({width(p) for p in grid}):
        own = [k for k, p in enumerate(grid) if width(p) == g]
        factor = landmarks.local_landmarks((x - mean) / std, g)
        out |= dict(zip(own, _machines(x, y, factor.features, lambda v: (v - mean) / std, [float(grid[k]["c"]) for k in own]), strict=True))
    return [out[k] for k in range(len(grid))]


def fidelity_machines(x: np.ndarray, y: np.ndarray, keys: np.ndarray, grid: list[dict], seed: int) -> list[Scorer]:
    """The cells of a grid of c on angles from 0 to pi."""
    low, high = x.min(axis=0), x.max(axis=0)
    span = np.where(high > low, high - low, np.inf)
    return _machines(x, y, state_features(), lambda v: ((v - low) / span * np.pi).clip(0, np.pi), [float(p["c"]) for p in grid])


CELLS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray, list[dict], int], list[Scorer]]] = {"rf": forests, "hgb": boosters, "svm": gaussian_machines, "qsvc": fidelity_machines}


def _f1(y: np.ndarray, pred: np.ndarray) -> float:
    hits = int((y * pred).sum())
    return 2 * hits / max(int(y.sum() + pred.sum()), 1)


def _fitted(unit: dict, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a unit gives: scores of the rows to be judged by (n_train, grid_pos), the cells' F1 on `tune` if one is to be chosen, and a status each."""

    def made(n: int, n_train: int, pos: int, split: str | None, y=None, score=None, pred=None, f1=None, status=None) -> pa.RecordBatch:
        empty = [None] * n
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(([unit["unit"]] * n, [n_train] * n, [pos] * n, [split] * n, empty if y is None else y, empty if score is None else score, empty if pred is None else pred, [f1] * n, [status] * n), _OUT, strict=True)], schema=_OUT)

    x, y, split = rows["x"][:, unit["columns"]], rows["y"], rows["split"]
    for n, quota in unit["sizes"]:
        try:
            train = split == "train"
            if quota is not None:
                train &= rows["place"] < np.vectorize(lambda v, q=quota: q.get(int(v), 0), otypes=[np.int64])(y)
            cells = CELLS[unit["model"]](x[train], y[train], rows["key"][train], unit["grid"], unit["seed"])
            chosen = range(len(cells))
            out = []
            if unit["choose"]:
                on = split == "tune"
                f1 = [_f1(y[on], c(x[on])[1]) for c in cells]
                out += [made(1, n, k, None, f1=v, status="cell") for k, v in enumerate(f1)]
                chosen = [int(np.argmax(f1))]
            for k, name in itertools.product(chosen, unit["judged"]):
                on = split == name
                score, pred = cells[k](x[on])
                out.append(made(int(on.sum()), n, k, name, y[on], score, pred))
            yield from out
            yield made(1, n, chosen[0] if unit["choose"] else -1, None, status="ok")
        except Exception as e:  # noqa: BLE001 - a failed run is part of the result
            yield made(1, n, -1, None, status=f"failed: {type(e).__name__}: {e}"[:300])


def run(dealt: DataFrame, units: list[dict], columns: list[str], row_id: str, y: str = "y") -> DataFrame:
    """The rows that all units give, for dealt (unit, split, place, the row's id, its label and columns)."""
    by_number = {u["unit"]: u for u in units}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        number = table.column("unit").to_numpy()
        for u in np.unique(number):
            own = table.filter(pa.array(number == u)).sort_by([("split", "ascending"), ("key", "ascending")])
            rows = {"x": np.stack([own.column(f"_x{k}").to_numpy() for k in range(len(columns))], axis=1), "y": own.column("y").to_numpy().astype(np.int64), "split": np.array(own.column("split").to_pylist(), object), "place": own.column("place").to_numpy(), "key": own.column("key").to_numpy().view(np.uint64)}
            yield from _fitted(by_number[int(u)], rows)

    own = dealt.select("unit", "split", F.col("place").cast("long").alias("place"), F.xxhash64(row_id).alias("key"), F.col(y).cast("int").alias("y"), *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_x{k}") for k, c in enumerate(columns)))
    # A partition a unit, so that no task waits with several: the units are numbered without gaps.
    return own.repartitionByRange(len(units), "unit").mapInArrow(fit, _OUT_DDL)


def by_unit(dealt: DataFrame, key: str, units: list[dict]) -> DataFrame:
    """Rows with a seed (or fold) as rows of each unit of it."""
    of: dict[int, list[int]] = {}
    for u in units:
        of.setdefault(u[key], []).append(u["unit"])
    numbers = F.create_map(*itertools.chain.from_iterable((F.lit(int(k)), F.array(*map(F.lit, v))) for k, v in of.items()))
    return dealt.withColumn("unit", F.explode(F.element_at(numbers, F.col(key))))


def check_size(rows: int) -> None:
    if rows > MOST:
        raise ValueError(f"{rows} rows are more than the {MOST} that one task may hold; fit each run with models.FITTERS")


def check_any(status: list[str]) -> None:
    """RuntimeError if every run failed, with what the first one said."""
    if status and all(s.startswith("failed") for s in status):
        raise RuntimeError(f"all {len(status)} runs failed; the first: {status[0]}")
