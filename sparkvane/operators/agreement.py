"""Agreement of three models, who errs with whom, and the majority's worth."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, ratio
from ..sources.tables import MODELS

PAIRS = list(combinations(MODELS, 2))


def _right(m: str) -> Column:
    return F.col(f"{m}_pred") == F.col("y")


def majority(*preds: Column) -> Column:
    """1 where at least two of three say 1."""
    return (sum(preds[1:], preds[0]) >= 2).cast("int")


def pairs(df: DataFrame) -> DataFrame:
    """One row for each two models: agreement, disagreement, and who is right where they differ; one pass."""
    names = ("agree", "disagree", "both_right", "both_wrong", "only_a_right", "only_b_right")
    aggs = [F.count("*").alias("n")]
    for a, b in PAIRS:
        ra, rb, same = _right(a), _right(b), F.col(f"{a}_pred") == F.col(f"{b}_pred")
        for name, c in zip(names, (same, ~same, ra & rb, ~ra & ~rb, ra & ~rb, ~ra & rb), strict=True):
            aggs.append(count_if(c).alias(f"{a}_{b}_{name}"))
    wide = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col("n"), *(F.col(f"{a}_{b}_{k}").alias(k) for k in names)) for a, b in PAIRS))
    out = wide.select(F.inline(rows))
    return out.withColumns({"agreement": F.round(ratio(F.col("agree"), F.col("n")), 6), "a_right_if_differ": F.round(ratio(F.col("only_a_right"), F.col("disagree")), 6), "b_right_if_differ": F.round(ratio(F.col("only_b_right"), F.col("disagree")), 6)})


def long_pairs(long: DataFrame) -> DataFrame:
    """(model_a, model_b, n, agree) from the long form (row_id, model, pred), by a self join on the row."""
    a, b = long.alias("a"), long.alias("b")
    met = a.join(b, (F.col("a.row_id") == F.col("b.row_id")) & (F.col("a.model") < F.col("b.model")))
    return met.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(F.count("*").alias("n"), count_if(F.col("a.pred") == F.col("b.pred")).alias("agree"))


def unanimity(df: DataFrame) -> DataFrame:
    s, r, q = (F.col(f"{m}_pred") for m in MODELS)
    same = (s == r) & (r == q)
    return df.agg(F.count("*").alias("n"), count_if(same).alias("unanimous"), count_if(same & (s == F.col("y"))).alias("unanimous_right"), count_if(same & (s != F.col("y"))).alias("unanimous_wrong"), count_if(same & (s == 0)).alias("all_0"), count_if(same & (s == 1)).alias("all_1"))


def on_disagreement(df: DataFrame) -> DataFrame:
    """(model, n, right, accuracy, place) over rows where the models differ, best first."""
    differ = ~((F.col("svm_pred") == F.col("rf_pred")) & (F.col("rf_pred") == F.col("qsvc_pred")))
    wide = df.where(differ).agg(F.count("*").alias("n"), *(count_if(_right(m)).alias(m) for m in MODELS))
    rows = wide.select(F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col("n"), F.col(m).alias("right")) for m in MODELS))))
    better = F.expr("1")
    other = rows.select(F.col("right").alias("o_right"), F.col("model").alias("o_model"))
    # Three rows by three.
    ranked = rows.join(F.broadcast(other), (F.col("o_right") > F.col("right")) | ((F.col("o_right") == F.col("right")) & (F.col("o_model") < F.col("model"))), "left")
    return ranked.groupBy("model", "n", "right").agg((F.count("o_model") + better).alias("place")).withColumn("accuracy", F.round(ratio(F.col("right"), F.col("n")), 6))


def error_cells(df: DataFrame) -> DataFrame:
    """Counts by which models err: eight cells."""
    return df.groupBy(*((~_right(m)).cast("int").alias(f"{m}_wrong") for m in MODELS)).agg(F.count("*").alias("n"))


def error_overlaps(df: DataFrame) -> DataFrame:
    """One row: errors of each model, common errors of each two, rows that exactly one has right, all wrong."""
    c = error_cells(df)
    w = {m: F.col(f"{m}_wrong") for m in MODELS}
    n = F.col("n")
    aggs = [F.sum(n * w[m]).alias(f"{m}_errors") for m in MODELS]
    aggs += [F.sum(n * w[a] * w[b]).alias(f"{a}_{b}_errors") for a, b in PAIRS]
    total = sum((w[m] for m in MODELS[1:]), w[MODELS[0]])
    aggs += [F.coalesce(F.sum(F.when(total == k, n)), F.lit(0)).alias(name) for k, name in ((0, "all_right"), (2, "exactly_one_right"), (3, "all_wrong"))]
    return c.agg(*aggs)


def majority_worth(df: DataFrame) -> DataFrame:
    """(n, majority accuracy, each model's, the best model's name by data, the difference)."""
    vote = majority(*(F.col(f"{m}_pred") for m in MODELS))
    wide = df.agg(F.count("*").alias("n"), count_if(vote == F.col("y")).alias("_v"), *(count_if(_right(m)).alias(m) for m in MODELS))
    best = F.greatest(*(F.col(m) for m in MODELS))
    name = F.lit(MODELS[-1])
    for m in reversed(MODELS[:-1]):
        name = F.when(F.col(m) == best, F.lit(m)).otherwise(name)
    n = F.col("n")
    return wide.select("n", F.round(F.try_divide("_v", n), 6).alias("majority"), *(F.round(F.try_divide(m, n), 6).alias(m) for m in MODELS), name.alias("best_model"), F.round(F.try_divide(F.col("_v") - best, n), 6).alias("majority_minus_best"))
