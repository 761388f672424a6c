"""Leakage-safe preparation: splitting off the target, cleaning, dedup, scaling. What is fitted sees training rows only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, not_finite

SKEWED = 1.5


def features_and_target(df: DataFrame, label: str, leaky: tuple[str, ...], category: str | None = None) -> DataFrame:
    """df without its leaky columns, the target as int `y`, the category as `category`."""
    if label not in df.columns:
        raise ValueError(f"no target column {label}")
    kept = [c for c in df.columns if c not in (*leaky, label, category)]
    return df.select(*kept, F.col(label).cast("int").alias("y"), *([clean_category(F.col(category)).alias("category")] if category else []))


def clean_category(c: Column | None) -> Column:
    """Null becomes Normal, the rest is trimmed; a missing column is Unknown."""
    return F.lit("Unknown") if c is None else F.trim(F.coalesce(c.cast("string"), F.lit("Normal")))


def dedup(df: DataFrame, id_col: str) -> DataFrame:
    """Of rows that agree in all columns but the id, the one with the smallest id. One partial aggregate, no window."""
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(*rest).agg(F.min(id_col).alias(id_col)).select(df.columns)


def dedup_report(df: DataFrame, id_col: str) -> DataFrame:
    """rows_before, removed and pct_removed."""
    rest = [c for c in df.columns if c != id_col]
    n = df.agg(F.count("*").alias("rows_before"), F.countDistinct(F.struct(*rest)).alias("kept"))
    removed = F.col("rows_before") - F.col("kept")
    return n.select("rows_before", removed.alias("removed"), F.round(F.try_divide(100.0 * removed, F.col("rows_before")), 2).alias("pct_removed"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, mean, std_pop, min, max, skew) of each column from one pass; the skewness is the bias-adjusted one."""
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.skewness(c).alias(f"skew_{c}")]
    n = lambda c: F.col(f"n_{c}").cast("double")
    rows = F.array(
        *(
            F.struct(
                F.lit(c).alias("name"), F.col(f"n_{c}").alias("n"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"),
                F.col(f"min_{c}").cast("double").alias("min"), F.col(f"max_{c}").cast("double").alias("max"),
                F.when(n(c) > 2, F.col(f"skew_{c}") * F.sqrt(n(c) * (n(c) - 1)) / (n(c) - 2)).alias("skew"),
            )
            for c in columns
        )
    )
    return df.agg(*aggs).select(F.inline(rows))


class Scaler:
    """log1p for skewed non-negative columns, then standard scores; fitted on training rows."""

    def __init__(self, train: DataFrame, columns: list[str], skewed: float = SKEWED):
        self.columns = columns
        self.heavy, self.fit = [], {}
        found = {r.name: r for r in moments(train, columns).collect()} if columns else {}
        self.heavy = sorted(c for c in columns if (found[c].skew or 0) > skewed and found[c].min >= 0)
        logged = {r.name: r for r in moments(train.select(*(F.log1p(c).alias(c) for c in self.heavy)), self.heavy).collect()} if self.heavy else {}
        for c in columns:
            r = logged.get(c, found[c])
            self.fit[c] = r.mean or 0.0, r.std or 1.0

    def order(self) -> list[str]:
        return [*self.heavy, *sorted(c for c in self.columns if c not in self.heavy)]

    def columns_out(self) -> dict[str, Column]:
        return {c: ((F.log1p(c) if c in self.heavy else F.col(c)) - m) / s for c, (m, s) in self.fit.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns_out())


def one_hot(train: DataFrame, columns: list[str], limit: int = 1000) -> dict[str, list[str]]:
    """The sorted training values of each column; values met later only get all zeros."""
    out = {}
    for c in columns:
        values = [r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().limit(limit + 1).collect()]
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} values")
        out[c] = sorted(values)
    return out


def one_hot_columns(values: dict[str, list[str]]) -> list[Column]:
    return [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}={v}") for c in sorted(values) for v in values[c]]


def prepare(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Both tables as keep, heavy-tailed block, standard block, one-hot block; everything fitted on train."""
    scaler, values = Scaler(train, numeric), one_hot(train, categorical)
    scaled = scaler.columns_out()
    made = [*keep, *(scaled[c].alias(c) for c in scaler.order()), *one_hot_columns(values)]
    return train.select(*made), test.select(*made)


class AngleScaler:
    """Training range of each column to [0, pi]; constant columns to 0; later values are clipped."""

    def __init__(self, train: DataFrame, columns: list[str]):
        if not columns:
            raise ValueError("no columns")
        check_finite(train, columns)
        got = train.agg(*(f(c).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max)))).first()
        if got["lo0"] is None:
            raise ValueError("no rows to fit on")
        self.range = {c: (float(got[f"lo{k}"]), float(got[f"hi{k}"])) for k, c in enumerate(columns)}

    def columns_out(self) -> dict[str, Column]:
        out = {}
        for c, (lo, hi) in self.range.items():
            angle = (F.col(c) - lo) / (hi - lo) * math.pi if hi > lo else F.lit(0.0)
            out[c] = F.least(F.greatest(angle, F.lit(0.0)), F.lit(math.pi))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.range if c not in df.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return df.withColumns(self.columns_out())


def offenders(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n): how many values of each column are null, NaN or infinite."""
    wide = df.agg(*(count_if(not_finite(F.col(c).cast("double"))).alias(c) for c in columns))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in columns))))


def check_finite(df: DataFrame, columns: list[str]) -> None:
    if bad := {r.name: r.n for r in offenders(df, columns).where("n > 0").collect()}:
        raise ValueError(f"not finite: {bad}")


def quarantine(df: DataFrame, columns: list[str], non_negative: bool = False) -> DataFrame:
    """df with `valid` and `reject_reason`: the first column, in order, whose value can't be scored."""
    reason = F.lit(None).cast("string")
    for c in reversed(columns):
        x = F.col(c).cast("double")
        if non_negative:
            reason = F.when(x < 0, F.lit(f"{c}: negative")).otherwise(reason)
        reason = F.when(F.col(c).isNull(), F.lit(f"{c}: missing")).when(x.isNull(), F.lit(f"{c}: not a number")).when(not_finite(x), F.lit(f"{c}: not finite")).otherwise(reason)
    return df.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())


def check_flow(flow: dict | list | tuple, columns: list[str], non_negative: bool = False) -> list[float]:
    """One flow as numbers in column order; ValueError if a value is missing, not a finite number or the width is wrong."""
    if isinstance(flow, dict):
        if missing := [c for c in columns if c not in flow]:
            raise ValueError(f"missing: {', '.join(missing)}")
        values = [flow[c] for c in columns]
    else:
        values = list(flow.tolist() if hasattr(flow, "tolist") else flow)
        if len(values) == 1 and isinstance(values[0], (list, tuple)):
            values = list(values[0])
        if len(values) != len(columns):
            raise ValueError(f"{len(values)} values for {len(columns)} columns")
    for c, v in zip(columns, values, strict=True):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
            raise ValueError(f"{c}: not a finite number")
        if non_negative and v < 0:
            raise ValueError(f"{c}: negative")
    return [float(v) for v in values]
