"""Classification metrics, curves and low-false-positive thresholds, exact at any size.

What needs ranks works on distinct scores: counts are summed by score, scores are filed in bins that
rise with them, and cumulative counts are those within a bin plus those of the bins before. So no
window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import count_if, ratio

#: Bins for each unit of the logarithm of a thousand scores.
STEPS = 256


def predict(score: Column, threshold: Column | float) -> Column:
    """1 from the threshold on, inclusive."""
    return (score >= threshold).cast("int")


def cells(y: Column, pred: Column) -> list[Column]:
    return [count_if((y == a) & (pred == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"accuracy": ratio(tp + tn, tn + fp + fn + tp), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall), "fpr": ratio(fp, fp + tn)}


def confusion(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(*cells(F.col(y), F.col(pred)))


def evaluate(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred", score: str = "score", digits: int = 6) -> DataFrame:
    """keys, the 2 x 2 counts, accuracy, precision, recall, f1, fpr and auc (null if one class is missing). The rows are read once."""
    per = counted(df, keys, y, score, *cells(F.col(y), F.col(pred)))
    counts = per.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")))
    named = counts.select(*keys, "tn", "fp", "fn", "tp", *(F.round(c, digits).alias(n) for n, c in rates().items()))
    return named.join(below(per, keys).groupBy(*keys).agg(_area(digits).alias("auc")), keys, "left")


def class_report(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, f1 and support of each class, and their macro and weighted means, in rows."""
    c = confusion(df, keys, y, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    rows = []
    for name, hit, wrong, missed in (("0", tn, fn, fp), ("1", tp, fp, fn)):
        p, r = ratio(hit, hit + wrong), ratio(hit, hit + missed)
        rows.append(F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (hit + missed).alias("support")))
    per = c.select(*keys, F.inline(F.array(*rows)))
    means = per.groupBy(*keys).agg(*(F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")), *((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    both = means.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("class"), *(F.col(f"{k}_{m}").alias(m) for m in ("precision", "recall", "f1")), F.col("support")) for k in ("macro", "weighted")))))
    return per.unionByName(both)


def bin_of(score: Column) -> Column:
    """Rising with the score and fine at every magnitude, so that bins need no look at the data first."""
    return F.floor(F.signum(score) * F.log1p(F.abs(score) * 1000) * STEPS).cast("int")


def counted(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", *more: Column) -> DataFrame:
    """keys, _bin, score, pos and neg (rows with that score) and what else is to be counted; _bin and score are null for NaN and null scores."""
    s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*keys, bin_of(s).alias("_bin"), s.alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"), *more)


def below(per: DataFrame, keys: list[str]) -> DataFrame:
    """cumulative() of what counted() gives; the rows behind it are not read again."""
    per = per.where("_bin is not null").select(*keys, "_bin", "score", "pos", "neg")
    past, none = (Window.unboundedPreceding, -1), F.lit(0)
    sums = per.groupBy(*keys, "_bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bin").rowsBetween(*past)
    sums = sums.select(*keys, "_bin", F.sum("pos").over(whole).alias("all_pos"), F.sum("neg").over(whole).alias("all_neg"), F.coalesce(F.sum("pos").over(before), none).alias("_pb"), F.coalesce(F.sum("neg").over(before), none).alias("_nb"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("score").rowsBetween(*past)
    per = per.withColumns({"_pi": F.coalesce(F.sum("pos").over(inside), none), "_ni": F.coalesce(F.sum("neg").over(inside), none)})
    out = per.join(sums, [*keys, "_bin"])
    return out.select(*keys, "score", "pos", "neg", (F.col("_pi") + F.col("_pb")).alias("pos_below"), (F.col("_ni") + F.col("_nb")).alias("neg_below"), "all_pos", "all_neg")


def cumulative(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """keys, score, pos, neg (rows with that score), pos_below, neg_below (rows with a lower one), all_pos, all_neg. NaN and null scores are left out."""
    return below(counted(df, keys, y, score), keys)


def _area(digits: int) -> Column:
    """Over the rows of cumulative(): the chance that a positive outscores a negative, ties half; null if one class is missing."""
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return F.round(area / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0)), digits)


def auc(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", digits: int = 6) -> DataFrame:
    """keys and auc; null if one class is missing."""
    return cumulative(df, keys, y, score).groupBy(*keys).agg(_area(digits).alias("auc"))


def roc(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """keys, threshold, fp, tp, fpr and tpr of each distinct score as a threshold."""
    c = cumulative(df, keys, y, score)
    fp, tp = F.col("all_neg") - F.col("neg_below"), F.col("all_pos") - F.col("pos_below")
    return c.select(*keys, F.col("score").alias("threshold"), fp.alias("fp"), tp.alias("tp"), F.try_divide(fp, F.col("all_neg")).alias("fpr"), F.try_divide(tp, F.col("all_pos")).alias("tpr"))


def _partial_area(max_fpr: float, digits: int) -> Column:
    """Over the rows of cumulative(): the standardised area under the curve up to max_fpr."""
    n, p, m = F.nullif(F.col("all_neg").cast("double"), F.lit(0.0)), F.nullif(F.col("all_pos").cast("double"), F.lit(0.0)), F.lit(max_fpr)
    x1, y1 = (F.col("all_neg") - F.col("neg_below")) / n, (F.col("all_pos") - F.col("pos_below")) / p
    x0, y0 = (F.col("all_neg") - F.col("neg_below") - F.col("neg")) / n, (F.col("all_pos") - F.col("pos_below") - F.col("pos")) / p
    cut = y0 + F.try_divide((y1 - y0) * (m - x0), x1 - x0)
    piece = F.when(x0 >= m, 0.0).when(x1 <= m, (x1 - x0) * (y0 + y1) / 2).otherwise((m - x0) * (y0 + cut) / 2)
    least, most = 0.5 * max_fpr * max_fpr, max_fpr
    area = F.when((F.max("all_pos") > 0) & (F.max("all_neg") > 0), F.sum(piece))
    return F.round(0.5 * (1 + (area - least) / (most - least)), digits)


def partial_auc(df: DataFrame, keys: list[str], max_fpr: float = 0.02, y: str = "y", score: str = "score", digits: int = 6) -> DataFrame:
    """keys and the standardised area under the curve up to max_fpr (0.5: chance, 1: perfect); null if one class is missing."""
    return cumulative(df, keys, y, score).groupBy(*keys).agg(_partial_area(max_fpr, digits).alias("pauc"))


def thresholds(df: DataFrame, keys: list[str], *targets: float, y: str = "y", score: str = "score") -> DataFrame:
    """For each of keys and targets the least score at which at most floor(target x negatives) negatives alarm, with its metadata.

    threshold is null where the budget is under one negative, or ties leave no such score. All targets
    are met from one reading of the rows.
    """
    c = cumulative(df.where(F.col(y) == 0), keys, y, score)
    c = c.select("*", F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target_fpr"))
    c = c.withColumn("k", F.floor(F.col("target_fpr") * F.col("all_neg"))).withColumn("ge", F.col("all_neg") - F.col("neg_below"))
    nominal = (F.col("neg_below") <= F.col("all_neg") - F.col("k")) & (F.col("all_neg") - F.col("k") < F.col("neg_below") + F.col("neg"))
    ok = (F.col("ge") <= F.col("k")) & (F.col("k") >= 1)
    best = F.min(F.when(ok, F.struct("score", "ge", "neg_below")))
    out = c.groupBy(*keys, "target_fpr").agg(F.max("all_neg").alias("negatives"), F.max("k").alias("budget"), best.alias("_b"), F.max(F.when(nominal, F.col("score"))).alias("nominal_threshold"))
    return out.select(
        *keys,
        "target_fpr",
        "negatives",
        "budget",
        F.col("_b.score").alias("threshold"),
        F.col("_b.ge").alias("false_positives"),
        (F.col("_b.ge") / F.col("negatives")).alias("achieved_fpr"),
        (F.col("_b.neg_below") + 1).alias("rank"),
        (F.col("negatives") - F.col("budget") + 1).alias("nominal_rank"),
        "nominal_threshold",
        (F.col("_b.score") != F.col("nominal_threshold")).alias("tie_adjusted"),
    )


def derive_threshold(df: DataFrame, target_fpr: float, y: str = "y", score: str = "score") -> dict:
    """thresholds() of one model as a dict; ValueError on labels, scores or targets that allow none."""
    if not 0 < target_fpr < 1:
        raise ValueError("the target must lie between 0 and 1")
    s = F.col(score).cast("double")
    bad = df.agg(count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1)).alias("labels"), count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("scores"), count_if(F.col(y) == 0).alias("negatives")).first()
    if bad.labels or bad.scores:
        raise ValueError(f"{bad.labels} labels are not 0 or 1, {bad.scores} scores are not finite")
    if not bad.negatives:
        raise ValueError("no negatives")
    got = thresholds(df.withColumn("_all", F.lit(1)), ["_all"], target_fpr, y=y, score=score).first()
    if got.budget < 1:
        raise ValueError(f"{got.negatives} negatives are too few for {target_fpr}")
    if got.threshold is None:
        raise ValueError("ties at the top exceed the budget")
    return {k: v for k, v in got.asDict().items() if k != "_all"}


def operational(calibration: DataFrame, test: DataFrame, keys: list[str], targets: tuple[float, ...] = (0.01, 0.02), y: str = "y", score: str = "score", digits: int = 4) -> DataFrame:
    """Metrics on test at the thresholds that calibration fixes, for each target; test rows without a score are left out.

    Both tables are read once: counts at a threshold are sums over the test's distinct scores. All counts
    are 0 where there is no threshold.
    """
    frozen = thresholds(calibration, keys, *targets, y=y, score=score).select(*keys, "target_fpr", "threshold")
    curve = cumulative(test, keys, y, score).join(frozen, keys)
    known, alarm = F.col("threshold").isNotNull(), F.col("score") >= F.col("threshold")
    made = {"tn": (~alarm, "neg"), "fp": (alarm, "neg"), "fn": (~alarm, "pos"), "tp": (alarm, "pos")}
    counts = [F.coalesce(F.sum(F.when(known & hit, F.col(c))), F.lit(0)).alias(n) for n, (hit, c) in made.items()]
    got = curve.groupBy(*keys, "target_fpr", "threshold").agg(*counts, _area(digits).alias("auc"), _partial_area(0.02, digits).alias("pauc"))
    return got.select(*keys, "target_fpr", "threshold", "tn", "fp", "fn", "tp", *(F.round(c, digits).alias(n) for n, c in rates().items()), "auc", "pauc")
