"""The experiments: sweeps over seeds, sizes, feature sets and models, with one long result table each.

All runs of a sweep are fitted in one job and judged in one (see sweeps). A run that fails is a row with
what it said; a sweep whose runs all fail is an error.
"""

from __future__ import annotations

import importlib.metadata
import json
import platform
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import held
from . import agreement, kernel, metrics, models, projection, select, split, sweeps

# The protocol's rows of each part, its seeds, the sizes of its learning curve and of tuning.
PROTOCOL = {"train": 4000, "tune": 1000, "cal": 2000, "test": 20_000}
SEEDS = (42, 43, 44, 45, 46)
CURVE = (100, 500, 1000, 2000, 4000)
TUNING = {"train": 500, "tune": 1000}

_METRICS = ("accuracy", "precision", "recall", "f1", "fpr", "auc")


def protocol_sizes(rows: int, sizes: dict[str, int] | None = None) -> dict[str, int]:
    """The protocol's sizes, all scaled down alike where a table has fewer rows than they take."""
    sizes = sizes or PROTOCOL
    share = min(1.0, rows / sum(sizes.values()))
    return {k: int(n * share) for k, n in sizes.items()}


def _units(seeds: tuple[int, ...], sets: dict[str, list[str]], names: list[str], grids: dict[str, list[dict]], sizes: list[tuple], choose: bool, judged: list[str]) -> tuple[list[dict], list[str]]:
    """A unit for each seed, feature set and model, and the columns that they pick from."""
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    which = [(s, k, m) for m in names for s in seeds for k in sets]
    return [{"unit": u, "seed": s, "feature_set": k, "model": m, "grid": grids.get(m, [{}]), "columns": [columns.index(c) for c in sets[k]], "sizes": sizes, "choose": choose, "judged": judged} for u, (s, k, m) in enumerate(which)], columns


def _run(df: DataFrame, parts: dict[str, int], units: list[dict], columns: list[str], row_id: str, y: str, counts: dict) -> DataFrame:
    sweeps.check_size(sum(parts.values()))
    seeds = tuple(dict.fromkeys(u["seed"] for u in units))
    dealt = split.partitions_by_seed(df.select(row_id, y, *columns), parts, row_id, y, seeds, counts)
    return sweeps.run(sweeps.by_unit(dealt, "seed", units), units, columns, row_id, y)


def _statuses(got: DataFrame) -> dict[tuple, str]:
    """What became of each (unit, n_train): `ok`, or what it said when it failed."""
    found = {(r.unit, r.n_train): r.status for r in got.where("status is not null and status <> 'cell'").select("unit", "n_train", "status").collect()}
    sweeps.check_any(list(found.values()))
    return found


def learning_curves(df: DataFrame, columns: list[str] | dict[str, list[str]], names: list[str], row_id: str, y: str = "y", sizes: tuple[int, ...] = CURVE, test: int = PROTOCOL["test"], seeds: tuple[int, ...] = SEEDS, cells: dict[str, dict] | None = None) -> DataFrame:
    """A row for each seed, feature set, size and model; the training sets of one seed are nested and its test rows the same.

    columns: those of one feature set, or of several by name. cells: the parameters of each model; by
    default what tuning found.
    """
    sets = columns if isinstance(columns, dict) else {"all": columns}
    counts, parts = split.label_counts(df, y), {"train": max(sizes), "test": test}
    among = split.quotas(counts, max(sizes)) if max(sizes) <= sum(counts.values()) else counts
    grids = {m: [p] for m, p in (cells or models.CURVE_CELLS).items()}
    units, own = _units(seeds, sets, names, grids, [(n, split.quotas(among, n)) for n in sizes], False, ["test"])
    with held(_run(df, parts, units, own, row_id, y, counts)) as got:
        status = _statuses(got)
        judged = {(r.unit, r.n_train): r for r in metrics.evaluate(got.where("split = 'test'"), ["unit", "n_train"], "y").collect()}
    rows = []
    for u in units:
        for n in sizes:
            r = judged.get((u["unit"], n))
            rows.append((u["seed"], u["feature_set"], u["model"], n, status[u["unit"], n], *((r.tn + r.fp + r.fn + r.tp, *(r[k] for k in _METRICS)) if r else (0, *[None] * 6))))
    return df.sparkSession.createDataFrame(rows, "seed int, feature_set string, model string, n_train int, status string, n long, " + ", ".join(f"{k} double" for k in _METRICS))


def experiment(df: DataFrame, sets: dict[str, list[str]], names: list[str], sizes: dict[str, int], row_id: str, y: str, seeds: tuple[int, ...]) -> DataFrame:
    """(seed, feature_set, model, status, metrics) of every combination, each model with what it takes by default."""
    got = learning_curves(df, sets, names, row_id, y, (sizes["train"],), sizes["test"], seeds, models.DEFAULTS)
    return got.select("seed", "feature_set", "model", "status", "n", "accuracy", "f1", "fpr", "auc")


def tuning(df: DataFrame, columns: list[str], names: list[str], row_id: str, y: str = "y", sizes: dict[str, int] | None = None, seeds: tuple[int, ...] = SEEDS, grids: dict[str, list[dict]] | None = None) -> DataFrame:
    """Each cell of each model's grid, fitted on `train` and judged on `tune` with every seed: means and population deviations, and the model's best cell by mean F1 (the first on ties)."""
    sizes, grids = sizes or TUNING, grids or models.GRIDS
    parts = {k: sizes[k] for k in ("train", "tune")}
    units, own = _units(seeds, {"all": columns}, names, grids, [(parts["train"], None)], False, ["tune"])
    with held(_run(df, parts, units, own, row_id, y, split.label_counts(df, y))) as got:
        failed = {u: s for (u, _), s in _statuses(got).items() if s != "ok"}
        scored = metrics.evaluate(got.where("split = 'tune'"), ["unit", "grid_pos"], "y", digits=4)
        names_of = df.sparkSession.createDataFrame([(u["unit"], u["model"]) for u in units], "unit int, model string")
        measures = ("f1", "accuracy", "auc")
        means = scored.join(F.broadcast(names_of), "unit").groupBy("model", "grid_pos").agg(F.count("*").alias("seeds"), *(f(k).alias(f"{k}_{n}") for k in measures for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).collect()
    best = {m: max((r for r in means if r.model == m), key=lambda r: (round(r.f1_mean, 4), -r.grid_pos), default=None) for m in names}
    rows = [(r.model, r.grid_pos, json.dumps(grids[r.model][r.grid_pos], sort_keys=True), r.seeds, *(round(r[f"{k}_{n}"], 4) if r[f"{k}_{n}"] is not None else None for k in measures for n in ("mean", "std")), r is best[r.model]) for r in means]
    rows += [(u["model"], None, s, 0, *[None] * 6, False) for u in units if (s := failed.get(u["unit"]))]
    return df.sparkSession.createDataFrame(rows, "model string, grid_pos int, params string, seeds long, " + ", ".join(f"{k}_{n} double" for k in measures for n in ("mean", "std")) + ", best boolean")


def tuned(df: DataFrame, columns: list[str], names: list[str], row_id: str, y: str = "y", sizes: dict[str, int] | None = None, seed: int = SEEDS[0], grids: dict[str, list[dict]] | None = None) -> DataFrame:
    """A row for each model: its cell of the highest F1 on `tune` (the first on ties), fitted on `train` and judged once on `test`."""
    sizes, grids = sizes or PROTOCOL, grids or models.GRIDS
    parts = {k: sizes[k] for k in ("train", "tune", "test")}
    units, own = _units((seed,), {"all": columns}, names, grids, [(parts["train"], None)], True, ["test"])
    with held(_run(df, parts, units, own, row_id, y, split.label_counts(df, y))) as got:
        status = _statuses(got)
        judged = {r.unit: r for r in metrics.evaluate(got.where("split = 'test'"), ["unit", "grid_pos"], "y").collect()}
    rows = []
    for u in units:
        r = judged.get(u["unit"])
        kept = (json.dumps(u["grid"][r.grid_pos], sort_keys=True), r.tn + r.fp + r.fn + r.tp, *(r[k] for k in _METRICS)) if r else (None, 0, *[None] * 6)
        rows.append((u["model"], status[u["unit"], parts["train"]], *kept))
    return df.sparkSession.createDataFrame(rows, "model string, status string, params string, n long, " + ", ".join(f"{k} double" for k in _METRICS))


def benchmark(df: DataFrame, sets: dict[str, list[str]], names: list[str], row_id: str, y: str = "y", sizes: dict[str, int] | None = None, seeds: tuple[int, ...] = SEEDS, grids: dict[str, list[dict]] | None = None, targets: tuple[float, ...] = (0.01, 0.02)) -> DataFrame:
    """Tuned on `tune`, fitted on `train`, thresholds frozen on `cal`, judged on `test`: a row for each seed, feature set, model and target.

    All feature sets of a seed share their rows, which are disjoint by construction. grids: of each model; its own full grid by default.
    """
    sizes, grids = sizes or PROTOCOL, grids or models.GRIDS
    units, own = _units(seeds, sets, names, grids, [(sizes["train"], None)], True, ["cal", "test"])
    with held(_run(df, sizes, units, own, row_id, y, split.label_counts(df, y))) as got:
        status = _statuses(got)
        cells = {(r.unit, r.grid_pos): r.f1 for r in got.where("status = 'cell'").select("unit", "grid_pos", "f1").collect()}
        judged = {(r.unit, r.target_fpr): r for r in metrics.operational(got.where("split = 'cal'"), got.where("split = 'test'"), ["unit"], targets, "y").collect()}
    rows = []
    for u in units:
        f1 = [cells.get((u["unit"], k)) for k in range(len(u["grid"]))]
        said = status[u["unit"], sizes["train"]]
        pos = int(np.argmax(f1)) if said == "ok" else None
        for t in targets:
            r = judged.get((u["unit"], t))
            kept = (r.threshold, r.tn, r.fp, r.fn, r.tp, r.precision, r.recall, r.f1, r.fpr, r.auc, r.pauc) if r else (None,) * 11
            rows.append((u["seed"], u["feature_set"], u["model"], json.dumps(u["grid"][pos], sort_keys=True) if pos is not None else None, len(u["grid"]), f1[pos] if pos is not None else None, said, t, *kept))
    return df.sparkSession.createDataFrame(rows, "seed int, feature_set string, model string, params string, cells int, tune_f1 double, status string, target_fpr double, threshold double, tn long, fp long, fn long, tp long, precision double, recall double, f1 double, fpr double, auc double, pauc double")


def tune_kernel_c(train: DataFrame, tune: DataFrame, columns: list[str], y: str = "y", grid: list[dict] | None = None) -> tuple[list[dict], dict]:
    """Each C over one explicit map, which every pass computes once for all of them; the best by F1, the smallest C on ties."""
    _, cells = models.tune("qsvc", train, tune, columns, y, grid)
    cells = [{"c": c["params"]["c"], "f1": c["f1"]} for c in cells]
    return cells, max(cells, key=lambda c: (c["f1"], -c["c"]))


def restricted_kernel(df: DataFrame, columns: list[str], row_id: str, y: str = "y", seed: int = 42) -> DataFrame:
    """The kernel SVM under its hard ceilings: C tuned on validation rows over one map, then one evaluation on test rows."""
    with held(split.bounded_partitions(df, 100, 50, 100, row_id, y, seed)) as dealt:
        part = {k: dealt.where(F.col("split") == k) for k in ("train", "validation", "test")}
        cells, best = tune_kernel_c(part["train"], part["validation"], columns, y)
        got = models.evaluate_once(models.kernel_svm(part["train"], columns, y, c=best["c"]), part["test"], y)
    rows = [("tune", c["c"], c["f1"]) for c in cells] + [("test", best["c"], got["f1"])]
    return df.sparkSession.createDataFrame([(p, float(c), float(f)) for p, c, f in rows], "part string, c double, f1 double")


def kernel_scaling(df: DataFrame, columns: list[str], marks: tuple[int, ...] = (10, 25, 50, 100, 200), seed: int = 42) -> DataFrame:
    """Of so many landmarks (df holds the bounded sample): errors of the Nystrom approximation, bytes of its features and of the whole kernel."""
    x = np.array([[r[c] for c in columns] for r in df.select(*columns).collect()])
    k = kernel.fidelity(kernel.states(x))
    rows = [kernel.nystrom_errors(k, m, seed) for m in marks if m <= len(k)]
    return df.sparkSession.createDataFrame([(r["m"], len(k), r["frobenius"], r["spectral"], 8 * len(k) * r["m"], 8 * len(k) ** 2) for r in rows], "m int, n int, frobenius double, spectral double, feature_bytes long, kernel_bytes long")


def timed_kernels(df: DataFrame, columns: list[str], row_id: str, sizes: tuple[int, ...] = (50, 100, 200, 400), seed: int = 42) -> DataFrame:
    """Kernels of growing samples, timed until the stop rule skips the rest: n, skipped, projected, seconds and the invariants."""
    rows, last = [], (None, None)
    stopped = False
    for n in sizes:
        skip, ahead = projection.must_stop(*last, n)
        stopped = stopped or skip
        if stopped:
            rows.append((n, True, ahead, None, None, None))
            continue
        x = np.array([[r[c] for c in columns] for r in split.landmarks(df, n, row_id, seed).select(*columns).collect()])
        began = time.perf_counter()
        got = kernel.invariants(kernel.fidelity(kernel.states(x)))
        last = len(x), time.perf_counter() - began
        rows.append((n, False, ahead, last[1], got["diagonal"], got["least_eigenvalue"]))
    return df.sparkSession.createDataFrame(rows, "n int, skipped boolean, projected double, seconds double, diagonal double, least_eigenvalue double")


def disagreement(df: DataFrame) -> DataFrame:
    """All tables of the disagreement analysis as (section, subject, measure, value)."""
    parts = [
        ("pairs", agreement.pairs(df), F.concat_ws("-", "model_a", "model_b")),
        ("unanimity", agreement.unanimity(df), F.lit("all")),
        ("on disagreement", agreement.on_disagreement(df), F.col("model")),
        ("error cells", agreement.error_cells(df), F.concat_ws("", "svm_wrong", "rf_wrong", "qsvc_wrong")),
        ("error overlaps", agreement.error_overlaps(df), F.lit("all")),
        ("majority", agreement.majority_worth(df), F.lit("vote")),
    ]
    out = None
    for name, part, subject in parts:
        numbers = [c for c, t in part.dtypes if t in ("int", "bigint", "double")]
        long = part.select(F.lit(name).alias("section"), subject.alias("subject"), F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers))))
        out = long if out is None else out.unionByName(long)
    return out


def two_pools(df: DataFrame, pool: list[str], excluded: tuple[str, ...], y: str, row_id: str, k: int = 4, binned: bool = False) -> dict[str, dict]:
    """The selection from the whole pool and from the pool without some columns, by run name."""
    return {name: select.select_features(df, pool, y, row_id, k, exclude, binned=binned) for name, exclude in (("all_features", ()), ("excluded", excluded))}


def versions(spark: SparkSession) -> DataFrame:
    """(name, version) of what a run depends on."""
    found = [("python", platform.python_version()), ("spark", spark.version)]
    for name in ("numpy", "pandas", "pyarrow"):
        found.append((name, importlib.metadata.version(name)))
    return spark.createDataFrame(found, "name string, version string")
