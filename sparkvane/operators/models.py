"""Classifiers: forests and boosted trees on histograms, kernel SVMs by explicit features, grid searches, the three-model engine."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import held
from . import calibrate, landmarks, metrics, split, svm, sweeps, trees
from .prepare import AngleScaler, Scaler
from .sweeps import state_features

# Hyper-parameter grids of cross-validation, of tuning, and what the learning curves take.
FOREST_GRID = [{"trees": t, "depth": d, "leaf": m} for t in (50, 100) for d in (10, 20) for m in (1, 2)]
SVM_GRID = [{"c": c, "gamma": g} for c in (0.5, 1.0, 5.0) for g in ("scale", "auto")]
KERNEL_GRID = [{"c": c} for c in (0.01, 0.1, 1.0, 10.0, 100.0)]
GRIDS = {
    "rf": [{"trees": 50, "depth": 10}, {"trees": 100, "depth": 10}, {"trees": 100, "depth": 15}, {"trees": 100, "depth": None}, {"trees": 200, "depth": 15}],
    "hgb": [{"rounds": 50, "rate": 0.1, "depth": 6}, {"rounds": 100, "rate": 0.1, "depth": 6}, {"rounds": 100, "rate": 0.1, "depth": 10}, {"rounds": 100, "rate": 0.05, "depth": 10}, {"rounds": 200, "rate": 0.1, "depth": 10}],
    "svm": [{"c": 0.1, "gamma": "scale"}, {"c": 1.0, "gamma": "scale"}, {"c": 10.0, "gamma": "scale"}, {"c": 10.0, "gamma": 0.1}, {"c": 100.0, "gamma": "scale"}],
    "qsvc": KERNEL_GRID,
}
CURVE_CELLS = {"rf": {"trees": 100, "depth": 10}, "svm": {"c": 100.0, "gamma": "scale"}, "qsvc": {"c": 10.0}, "hgb": {"rounds": 100, "rate": 0.1, "depth": 6}}
#: What a fit takes that says nothing else.
DEFAULTS = {"rf": {"trees": 50, "depth": 10, "leaf": 1}, "hgb": {"rounds": 20, "rate": 0.1, "depth": 3}, "svm": {"c": 1.0, "gamma": "scale"}, "qsvc": {"c": 1.0}}
#: Training rows for each partition of a fit.
ROWS_A_PARTITION = 20_000


def margin_or_probability(df: DataFrame) -> Column:
    """The score of class 1: its probability if the model has one, else its margin; ValueError for hard labels only."""
    if "margin" in df.columns:
        return F.col("margin")
    if "probability" in df.columns:
        return vector_to_array(F.col("probability"))[1]
    if "rawPrediction" in df.columns:
        return vector_to_array(F.col("rawPrediction"))[1]
    raise ValueError("the model gives labels only")


def checked_scores(df: DataFrame) -> DataFrame:
    """df, if it has rows and its scores are finite."""
    got = df.agg(F.count("*").alias("n"), F.sum(F.when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), 1).otherwise(0)).alias("bad")).first()
    if not got.n or got.bad:
        raise ValueError("no scores" if not got.n else f"{got.bad} scores are not finite")
    return df


@dataclass
class Fitted:
    """A fitted model with what comes before it; transform adds score and pred."""

    name: str
    before: Callable[[DataFrame], DataFrame]
    model: object
    params: dict
    fit_seconds: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.before(df))
        made = {"score": margin_or_probability(out), "pred": F.col("prediction").cast("int")}
        return out.withColumns(made).drop("features", "rawPrediction", "probability", "prediction", "margin")


def _as_is(df: DataFrame) -> DataFrame:
    return df


def _packed(train: DataFrame) -> tuple[DataFrame, int, int]:
    """train in few partitions, its rows and these partitions: a fit is many small jobs over the same rows."""
    n = train.count()
    parts = max(1, math.ceil(n / ROWS_A_PARTITION))
    return train.coalesce(parts), n, parts


def forests(train: DataFrame, columns: list[str], y: str, grid: list[dict], seed: int = 42) -> list[Fitted]:
    """The cells of a grid of trees, depth and leaf: one forest for each leaf, of which each cell is the first trees and levels."""
    out: dict[int, Fitted] = {}
    few, _, parts = _packed(train)
    for leaf in sorted({p.get("leaf", 1) for p in grid}):
        began = time.perf_counter()
        own = [(k, p) for k, p in enumerate(grid) if p.get("leaf", 1) == leaf]
        depth = {k: min(p["depth"] or 30, 30) for k, p in own}
        edges, made = trees.forest(few, columns, y, max(p["trees"] for _, p in own), max(depth.values()), leaf, seed, parts)
        took = time.perf_counter() - began
        for k, p in own:
            score = partial(trees.forest_scores, made=[t.arrays(depth[k]) for t in made[: p["trees"]]])
            out[k] = Fitted("rf", _as_is, trees.Model(columns, edges, score), p, took)
    return [out[k] for k in range(len(grid))]


def boosters(train: DataFrame, columns: list[str], y: str, grid: list[dict]) -> list[Fitted]:
    """The cells of a grid of rounds, rate and depth, grown side by side: one chain for each rate and depth, whose beginning a shorter cell is."""
    began = time.perf_counter()
    few, _, parts = _packed(train)
    chains: dict[tuple, trees.Chain] = {}
    for p in grid:
        c = chains.setdefault((p["rate"], p["depth"]), trees.Chain(0, p["rate"], p["depth"]))
        c.rounds = max(c.rounds, p["rounds"])
    edges = trees.boosted(few, columns, y, list(chains.values()), parts)
    took, out = time.perf_counter() - began, []
    for p in grid:
        c = chains[p["rate"], p["depth"]]
        score = partial(trees.boosted_scores, base=c.base, made=[t.arrays() for t in c.trees[: p["rounds"]]])
        out.append(Fitted("hgb", _as_is, trees.Model(columns, edges, score), p, took))
    return out


def forest(train: DataFrame, columns: list[str], y: str = "y", trees: int = 50, depth: int | None = 10, leaf: int = 1, seed: int = 42) -> Fitted:
    return forests(train, columns, y, [{"trees": trees, "depth": depth, "leaf": leaf}], seed)[0]


def boosting(train: DataFrame, columns: list[str], y: str = "y", rounds: int = 20, rate: float = 0.1, depth: int = 3) -> Fitted:
    return boosters(train, columns, y, [{"rounds": rounds, "rate": rate, "depth": depth}])[0]


def machines(name: str, scale: Callable[[DataFrame], DataFrame], features: Callable[[DataFrame], svm.Map], train: DataFrame, columns: list[str], y: str, grid: list[dict]) -> list[Fitted]:
    """A machine for each cell of a grid that differs in c alone: every pass maps the rows once for all of them. features are made from the scaled rows.

    Rows that agree in all columns and the label are one with their number (_rows), which changes no sum.
    """
    began = time.perf_counter()
    with held(scale(train.groupBy(*columns, y).agg(F.count("*").alias("_rows")))) as rows:
        parts = max(1, math.ceil(rows.count() / ROWS_A_PARTITION))
        # All passes run where these are held; by value and sorted, so that runs agree.
        few = rows.repartition(parts, *columns, y).sortWithinPartitions(*columns, y).persist()
        few.count()
    try:
        made = features(few)
        got = svm.fit(few, columns, y, made, [float(p["c"]) for p in grid], parts, "_rows")
    finally:
        few.unpersist()
    took = time.perf_counter() - began
    return [Fitted(name, scale, svm.Machine(columns, made, w, b), p, took) for p, (w, b) in zip(grid, got, strict=True)]


def rbf_svms(train: DataFrame, columns: list[str], y: str, grid: list[dict], error: float = landmarks.ERROR, most: int = landmarks.MOST) -> list[Fitted]:
    """Gaussian-kernel SVMs by landmark features, as many as miss no more than `error` of the kernel's trace (but at most `most`); the scaler is fitted on train, so gamma `scale` and `auto` are both 1 / columns."""
    scaler = Scaler(train, columns, skewed=float("inf"))
    width = lambda p: p["gamma"] if isinstance(p.get("gamma"), float) else 1 / len(columns)
    out: dict[int, Fitted] = {}

    def mapped(rows: DataFrame, g: float) -> svm.Map:
        found = landmarks.landmarks(rows, columns, g, error, most, "_rows")
        return svm.Mixed(found.kernel, found.inverse)

    for g in sorted({width(p) for p in grid}):
        own = [k for k, p in enumerate(grid) if width(p) == g]
        features = partial(mapped, g=g)
        out |= dict(zip(own, machines("svm", scaler.transform, features, train, columns, y, [grid[k] for k in own]), strict=True))
    return [out[k] for k in range(len(grid))]


def kernel_svms(train: DataFrame, columns: list[str], y: str, grid: list[dict], reps: int = 2) -> list[Fitted]:
    """Fidelity-kernel SVMs as linear ones on the explicit map: linear in rows, no matrix of all pairs."""
    return machines("qsvc", AngleScaler(train, columns).transform, lambda _: state_features(reps), train, columns, y, grid)


def rbf_svm(train: DataFrame, columns: list[str], y: str = "y", c: float = 1.0, gamma: str | float = "scale") -> Fitted:
    return rbf_svms(train, columns, y, [{"c": c, "gamma": gamma}])[0]


def kernel_svm(train: DataFrame, columns: list[str], y: str = "y", c: float = 1.0, reps: int = 2) -> Fitted:
    return kernel_svms(train, columns, y, [{"c": c}], reps)[0]


FITTERS: dict[str, Callable[..., Fitted]] = {"rf": forest, "hgb": boosting, "svm": rbf_svm, "qsvc": kernel_svm}
#: Fitters of a whole grid at once.
GRID_FITTERS: dict[str, Callable[..., list[Fitted]]] = {"rf": forests, "hgb": boosters, "svm": rbf_svms, "qsvc": kernel_svms}


def tune(name: str, train: DataFrame, held: DataFrame, columns: list[str], y: str = "y", grid: list[dict] | None = None) -> tuple[dict, list[dict]]:
    """The grid cell of the highest F1 on held, the first on ties, and all cells in grid order."""
    best, cells = _tuned(name, train, held, columns, y, grid)
    return best.params, cells


def _tuned(name: str, train: DataFrame, held: DataFrame, columns: list[str], y: str, grid: list[dict] | None) -> tuple[Fitted, list[dict]]:
    cells, grid = [], grid or GRIDS[name]
    made = GRID_FITTERS[name](train, columns, y, grid)
    for pos, (params, fitted) in enumerate(zip(grid, made, strict=True)):
        row = fitted.transform(held).agg(*metrics.cells(F.col(y), F.col("pred"))).first()
        cells.append({"grid_pos": pos, "params": params, "f1": 2 * row.tp / max(2 * row.tp + row.fp + row.fn, 1)})
    best = max(cells, key=lambda c: (c["f1"], -c["grid_pos"]))
    return made[best["grid_pos"]], cells


def tune_and_refit(name: str, train: DataFrame, held: DataFrame, columns: list[str], y: str = "y", grid: list[dict] | None = None) -> Fitted:
    """The best cell's fit on train: the one that was tuned is the one that another fit on the same rows would give."""
    return _tuned(name, train, held, columns, y, grid)[0]


def cross_validate(name: str, df: DataFrame, columns: list[str], row_id: str, y: str = "y", k: int = 3, grid: list[dict] | None = None, seed: int = 42, at_most: int = 5000) -> list[dict]:
    """Mean AUC of each grid cell over k stratified folds; above at_most rows, a stratified sample of that size. All cells and folds are fitted in one job."""
    sweeps.check_size(at_most)
    if df.count() > at_most:
        df = split.sample(df, at_most, row_id, y, seed)
    cells = list(enumerate(grid or FOREST_GRID))
    # The cells of a forest's grid that differ in leaves share nothing.
    parts = [[c for c in cells if c[1].get("leaf") == leaf] for leaf in dict.fromkeys(p.get("leaf") for _, p in cells)]
    units = [{"unit": f * len(parts) + g, "fold": f, "seed": seed, "model": name, "grid": [p for _, p in part], "cells": [pos for pos, _ in part], "columns": list(range(len(columns))), "sizes": [(0, None)], "choose": False, "judged": ["test"]} for f in range(k) for g, part in enumerate(parts)]
    every = F.explode(F.array(*(F.lit(u["unit"]) for u in units)))
    dealt = split.folds(df, k, row_id, y, seed).withColumn("unit", every)
    dealt = dealt.withColumn("split", F.when(F.floor(F.col("unit") / len(parts)) == F.col("fold"), "test").otherwise("train")).withColumn("place", F.lit(0))
    with held(sweeps.run(dealt, units, columns, row_id, y)) as got:
        sweeps.check_any([r.status for r in got.where("status is not null").select("status").collect()])
        found = {(r.unit, r.grid_pos): r.auc or 0.0 for r in metrics.auc(got.where("split = 'test'"), ["unit", "grid_pos"], "y").collect()}
    scores: dict[int, list[float]] = {}
    for u in units:
        for at, pos in enumerate(u["cells"]):
            scores.setdefault(pos, []).append(found.get((u["unit"], at), 0.0))
    return [{"grid_pos": pos, "params": json.dumps(params, sort_keys=True), "auc": sum(scores[pos]) / k} for pos, params in cells]


def evaluate_once(fitted: Fitted, test: DataFrame, y: str = "y") -> dict:
    """Metrics and seconds for each thousand rows on a test set."""
    began = time.perf_counter()
    # One key for all rows: the windows below it hold bins of scores, not rows.
    row = metrics.evaluate(fitted.transform(test).withColumn("_m", F.lit(fitted.name)), ["_m"], y).first().asDict()
    took = time.perf_counter() - began
    n = row["tn"] + row["fp"] + row["fn"] + row["tp"]
    if not n:
        raise ValueError("no rows to evaluate")
    return {**row, "n": n, "fit_seconds": fitted.fit_seconds, "inference_seconds": took, "seconds_per_1000": 1000 * took / n}


class Engine:
    """Three models with calibrated probabilities, and the vote over them."""

    def __init__(self, train: DataFrame, validation: DataFrame, columns: list[str], y: str = "y"):
        self.columns = columns
        self.fitted = {m: FITTERS[m](train, columns, y) for m in ("svm", "rf", "qsvc")}
        self.curves = {m: calibrate.Platt(f.transform(validation), y) for m, f in self.fitted.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a score, a prediction and a probability of each model, and the policy's columns."""
        from . import policy

        kept = df.columns
        out = df
        for m, f in self.fitted.items():
            raw = {f"_raw_{c}": F.col(c) for c in self.columns}
            got = f.transform(out.withColumns(raw))
            restored = {c: F.col(f"_raw_{c}") for c in self.columns}
            kept = [*kept, f"{m}_score", f"{m}_pred", f"{m}_probability"]
            out = got.withColumns(restored).withColumns({f"{m}_score": F.col("score"), f"{m}_pred": F.col("pred"), f"{m}_probability": F.round(self.curves[m].column(F.col("score")), 6)}).select(kept)
        return policy.decide(out, [f"{m}_pred" for m in self.fitted])

    def analyze(self, spark: SparkSession, flow: dict | list) -> dict:
        from .prepare import check_flow

        values = check_flow(flow, self.columns)
        return self.transform(spark.createDataFrame([tuple(values)], ", ".join(f"{c} double" for c in self.columns))).first().asDict()


def save_pipeline(stages: list, train: DataFrame, path: str) -> PipelineModel:
    model = Pipeline(stages=stages).fit(train)
    model.write().overwrite().save(path)
    return model


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def forest_stages(columns: list[str], y: str = "y", trees: int = 20, seed: int = 42) -> list:
    """Stages that can be saved as one bundle: cleaning in SQL, assembling, the forest."""
    safe = ", ".join(f"coalesce(cast({c} AS double), 0D) AS {c}_" for c in columns)
    return [SQLTransformer(statement=f"SELECT *, {safe} FROM __THIS__"), VectorAssembler(inputCols=[f"{c}_" for c in columns], outputCol="features"), RandomForestClassifier(labelCol=y, numTrees=trees, seed=seed)]
