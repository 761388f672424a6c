"""Calibration: Brier score, expected calibration error, reliability, Platt scaling."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(bins: int) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, bins + 1)]


def bin_of(p: Column, bins: int) -> Column:
    """The bin [lo, hi) that holds p, the last one closed; by comparison with the edges themselves."""
    out = F.lit(bins - 1)
    for k in range(bins - 2, -1, -1):
        out = F.when(p < F.lit(edges(bins)[k + 1]), k).otherwise(out)
    return out


def brier(df: DataFrame, keys: list[str], y: str = "y", p: str = "score", digits: int = 6) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), digits).alias("brier"))


def reliability(df: DataFrame, keys: list[str], bins: int = 10, y: str = "y", p: str = "score", empty: bool = True) -> DataFrame:
    """keys, bin, lo, hi, n, mean_predicted and fraction_positive; empty bins have nulls."""
    got = df.groupBy(*keys, bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("fraction_positive"))
    e = edges(bins)
    frame = F.array(*(F.struct(F.lit(k).alias("bin"), F.lit(e[k]).alias("lo"), F.lit(e[k + 1]).alias("hi")) for k in range(bins)))
    every = got.select(*keys).distinct().select(*keys, F.inline(frame))
    joined = every.join(got, [*keys, "bin"], "left" if empty else "inner")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


def ece(df: DataFrame, keys: list[str], bins: int = 10, y: str = "y", p: str = "score", digits: int = 6) -> DataFrame:
    r = reliability(df, keys, bins, y, p, empty=False)
    return r.groupBy(*keys).agg(F.round(F.sum(F.abs(F.col("mean_predicted") - F.col("fraction_positive")) * F.col("n")) / F.sum("n"), digits).alias("ece"))


class Platt:
    """A logistic curve from scores to probabilities, with penalty strength 1 on its slope."""

    def __init__(self, df: DataFrame, y: str = "y", score: str = "score", steps: int = 40):
        """Newton's method on two parameters; each step is one pass of sums."""
        self.slope = self.intercept = 0.0
        rows = df.select(F.col(score).cast("double").alias("x"), F.col(y).cast("double").alias("t"))
        for _ in range(steps):
            p = self.column(F.col("x"))
            w = p * (1 - p)
            x, miss = F.col("x"), p - F.col("t")
            got = rows.agg(F.sum(miss * x), F.sum(miss), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
            if got[0] is None:
                return
            gradient = np.array([got[0] + self.slope, got[1]])
            step = np.linalg.solve(np.array([[got[2] + 1, got[3]], [got[3], got[4] + 1e-12]]), gradient)
            self.slope, self.intercept = self.slope - float(step[0]), self.intercept - float(step[1])
            if np.abs(step).max() < 1e-10:
                return

    def column(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * score + F.lit(self.intercept))))


def positive(probability: str = "probability") -> Column:
    return vector_to_array(F.col(probability))[1]


def audit(validation: DataFrame, test: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(part, kind, brier, ece): raw and calibrated scores on both parts; the curve is fitted on validation."""
    curve = Platt(validation, y, score)
    parts = validation.select(F.lit("validation").alias("part"), y, score).unionByName(test.select(F.lit("test").alias("part"), y, score))
    both = parts.select("part", y, F.inline(F.array(F.struct(F.lit("raw").alias("kind"), F.col(score).alias("p")), F.struct(F.lit("calibrated").alias("kind"), curve.column(F.col(score)).alias("p")))))
    keys = ["part", "kind"]
    return brier(both, keys, y, "p").join(ece(both, keys, 10, y, "p"), keys)
