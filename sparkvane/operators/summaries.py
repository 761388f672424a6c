"""Summaries over seeds, grids and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import count_if


def over_seeds(df: DataFrame, keys: list[str], value: str = "value", digits: int = 6) -> DataFrame:
    """keys, n, mean, std_sample (0 for one run) and std_pop, each named, so no one has to guess which."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), digits).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), digits).alias("std_sample"), F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), digits).alias("std_pop"))


def metrics_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    stacked = ", ".join(f"'{m}', cast({m} AS double)" for m in metrics)
    return df.selectExpr(*keys, f"stack({len(metrics)}, {stacked}) AS (metric, value)")


def best_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def best_candidate(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Highest f1, then smallest c."""
    return best_by(df, list(keys), F.desc("f1"), F.asc("c"))


def best_of_grid(df: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """Highest f1 (rounded first, if asked), the earliest grid position on ties."""
    value = F.round("f1", digits) if digits is not None else F.col("f1")
    return best_by(df.withColumn("_v", value), keys, F.desc("_v"), F.asc("grid_pos")).drop("_v")


def run_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("runs"), count_if(F.col("status") == "ok").alias("succeeded"), count_if(F.col("status") != "ok").alias("failed"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def markdown(df: DataFrame, limit: int = 500) -> str:
    """A small table as Markdown; a report shows at most `limit` rows."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
