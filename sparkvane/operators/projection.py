"""Cost models: memory, quadratic runtime, stop rules and what to recommend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STOP_AFTER, STOP_AHEAD = 120.0, 180.0
# From which largest completed size on which sizes of training, validation and test sample are advised, and their ceilings.
RECOMMENDED = ((200, (200, 50, 100)), (100, (100, 50, 100)), (0, (50, 25, 50)))
CEILINGS = (200, 50, 100)
# The published dry run, in rows and seconds.
DRY_RUN = {"n_train": 500, "n_test": 20000, "test_embed": 127.9301, "train_kernel": 0.0084, "test_kernel": 0.1681, "fit": 0.0063, "predict": 0.0753}


def matrix_memory(n: Column, m: Column) -> dict[str, Column]:
    """Entries and size of an n x m matrix of doubles."""
    entries = n.cast("long") * m.cast("long")
    size = entries * 8
    return {"entries": entries, "bytes": size, "kb": F.round(size / 1024.0, 4), "mb": F.round(size / 1048576.0, 4), "gb": F.round(size / 1073741824.0, 6)}


def state_memory(n: Column, qubits: Column) -> Column:
    """Bytes for n states of 2^q complex numbers, their kernel and ten MiB besides."""
    return 2 * n.cast("double") * F.pow(F.lit(2.0), qubits) * 16 + 8 * n.cast("double") * n + 10 * 1048576


def project_seconds(n: float, seconds: float, target: float) -> float:
    """The time at size target if it grows with the square; ValueError for sizes or times that make no sense."""
    if n <= 0 or target <= 0 or seconds < 0:
        raise ValueError("sizes must be positive and times not negative")
    return seconds * (target / n) ** 2


def quadratic(n: Column, seconds: Column, target: Column) -> Column:
    """project_seconds as a column; null where it would refuse."""
    return F.when((n > 0) & (target > 0) & (seconds >= 0), seconds * F.pow(target / n, F.lit(2.0)))


def must_stop(last_n: float | None, last_seconds: float | None, next_n: float) -> tuple[bool, float | None]:
    """Whether to skip the next size, and its projection."""
    if last_n is None or last_seconds is None:
        return False, None
    ahead = project_seconds(last_n, last_seconds, next_n)
    return last_seconds > STOP_AFTER or ahead > STOP_AHEAD, ahead


def stop_rules(runs: DataFrame) -> DataFrame:
    """runs (series, n, seconds) with projected and skipped: from the first size that must stop, all larger ones are skipped."""
    w = Window.partitionBy("series").orderBy("n")
    out = runs.withColumns({"last_n": F.lag("n").over(w), "last_seconds": F.lag("seconds").over(w)})
    out = out.withColumn("projected", quadratic(F.col("last_n"), F.col("last_seconds"), F.col("n")))
    stop = F.coalesce((F.col("last_seconds") > STOP_AFTER) | (F.col("projected") > STOP_AHEAD), F.lit(False)).cast("int")
    return out.withColumn("skipped", F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("last_n", "last_seconds")


def full_scale(runs: DataFrame, train: int, test: int) -> DataFrame:
    """From the largest run of each series: time and memory of the full training and test kernels."""
    last = runs.groupBy("series").agg(F.max_by("seconds", "n").alias("seconds"), F.max("n").alias("n"))
    per = F.col("seconds") / (F.col("n").cast("double") * F.col("n"))
    rows = F.array(*(F.struct(F.lit(k).alias("kernel"), F.lit(a).cast("long").alias("rows"), F.lit(b).cast("long").alias("columns")) for k, a, b in (("train", train, train), ("test", train, test))))
    out = last.withColumn("per_entry", per).select("series", "per_entry", F.inline(rows))
    entries = F.col("rows").cast("double") * F.col("columns")
    return out.select("series", "kernel", F.round(F.col("per_entry") * entries / 86400, 6).alias("days"), F.round(entries * 8 / 1073741824.0, 6).alias("gib"))


def recommend(runs: DataFrame) -> DataFrame:
    """runs (series, n, seconds), completed ones, to the sample sizes that the largest of each series allows, and whether they keep to the ceilings."""
    last = runs.groupBy("series").agg(F.max_by("seconds", "n").alias("seconds"), F.max("n").alias("largest"))
    step = F.when((F.col("largest") >= RECOMMENDED[0][0]) & (F.col("seconds") <= STOP_AFTER), 0).when(F.col("largest") >= RECOMMENDED[1][0], 1).otherwise(2)
    sizes = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("n_train", "n_validation", "n_test"), own, strict=True))) for _, own in RECOMMENDED))
    out = last.select("series", "largest", "seconds", F.get(sizes, step).alias("_s")).select("series", "largest", "seconds", "_s.*")
    return out.withColumn("within_ceilings", (F.col("n_train") <= CEILINGS[0]) & (F.col("n_validation") <= CEILINGS[1]) & (F.col("n_test") <= CEILINGS[2]))


def dry_run(sizes: DataFrame, measured: dict[str, float]) -> DataFrame:
    """sizes (n_train) with projected seconds and memory, from one measured run.

    measured holds n_train, n_test and the seconds test_embed, train_kernel, test_kernel, fit and predict
    of that run: embedding grows with the training rows at the rate of the test rows, the test kernel with
    the training rows, the training kernel and the fit with their square; prediction stays.
    """
    n, grow = F.col("n_train").cast("double"), F.col("n_train").cast("double") / F.lit(float(measured["n_train"]))
    parts = {
        "embed_s": (n * F.lit(measured["test_embed"] / measured["n_test"]), 3),
        "train_kernel_s": (F.lit(measured["train_kernel"]) * F.pow(grow, F.lit(2.0)), 4),
        "test_kernel_s": (F.lit(measured["test_kernel"]) * grow, 3),
        "fit_s": (F.lit(measured["fit"]) * F.pow(grow, F.lit(2.0)), 3),
        "predict_s": (F.lit(measured["predict"]), 3),
    }
    total = sum((c for c, _ in list(parts.values())[1:]), parts["embed_s"][0])
    return sizes.select("*", *(F.round(c, d).alias(k) for k, (c, d) in parts.items()), F.round(total, 2).alias("total_s"), F.round(n * measured["n_test"] * 8 / 1048576.0, 2).alias("test_matrix_mb"))
