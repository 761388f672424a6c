"""Paired inference: McNemar, Holm, paired bootstrap with a region of practical equivalence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import count_if
from ..functions.digests import Tails
from ..sources.tables import MODELS
from . import metrics
from .agreement import PAIRS

#: Metrics of which more is better; of the others less is.
HIGHER_IS_BETTER = {"accuracy": True, "f1": True, "auc": True, "fpr": False}
ROPE, RESAMPLES, AUC_BINS = 0.01, 1000, 512


def mcnemar(df: DataFrame) -> DataFrame:
    """(model_a, model_b, both_right, b, c, both_wrong, statistic) of each two models, with continuity correction; 0 if they never differ."""
    aggs = []
    for x, y in PAIRS:
        rx, ry = F.col(f"{x}_pred") == F.col("y"), F.col(f"{y}_pred") == F.col("y")
        aggs += [count_if(c).alias(f"{x}_{y}_{n}") for n, c in (("both_right", rx & ry), ("b", rx & ~ry), ("c", ~rx & ry), ("both_wrong", ~rx & ~ry))]
    rows = F.array(*(F.struct(F.lit(x).alias("model_a"), F.lit(y).alias("model_b"), *(F.col(f"{x}_{y}_{n}").alias(n) for n in ("both_right", "b", "c", "both_wrong"))) for x, y in PAIRS))
    differ = F.col("b") + F.col("c")
    return df.agg(*aggs).select(F.inline(rows)).withColumn("statistic", F.round(F.when(differ == 0, 0.0).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2.0)) / differ), 6))


def chi2_tail(statistic: float) -> float:
    """The upper tail of the chi-squared distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2))


def mcnemar_tests(df: DataFrame) -> list[dict]:
    """mcnemar() with p-values and Holm's adjusted ones; as many rows as there are pairs of models."""
    rows = [r.asDict() for r in mcnemar(df).collect()]
    for r in rows:
        r["p"] = 1.0 if r["b"] + r["c"] == 0 else chi2_tail(r["statistic"])
    for r, p in zip(rows, holm_adjust([r["p"] for r in rows]), strict=True):
        r["p_holm"] = p
    return rows


def holm_adjust(p: list[float]) -> list[float]:
    out, high = [0.0] * len(p), 0.0
    for rank, k in enumerate(sorted(range(len(p)), key=lambda k: (p[k], k))):
        high = max(high, min(1.0, (len(p) - rank) * p[k]))
        out[k] = round(high, 8)
    return out


def holm(df: DataFrame, family: list[str], name: str = "name", p: str = "p") -> DataFrame:
    """df with p_holm, within each family: (m - rank) p, at most 1, never falling in the order of p."""
    order = Window.partitionBy(*family).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_holm", F.round(F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)), 8)).drop("_s")


def interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """keys, mean, se (population), lower and upper percentile bounds by linear interpolation, for groups of as few values as a task can hold."""
    a = (1 - level) / 2
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("se"), F.percentile(value, F.lit(a)).alias("lower"), F.percentile(value, F.lit(1 - a)).alias("upper"))


def large_interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """interval() where a group may hold any number of rows: the same exact values, and no group is held by a task.

    Values are filed in bins that rise with them; the bins' sizes tell which of them hold the bounds'
    ranks, and only the rows of these (four a group at most) are ordered.
    """
    a = (1 - level) / 2
    x = F.col(value).cast("double")
    # NaN is above all.
    of = F.when(F.isnan(x), F.lit(2**31 - 1)).otherwise(metrics.bin_of(F.greatest(F.least(x, F.lit(1e300)), F.lit(-1e300))))
    rows = df.select(*keys, of.alias("_bin"), x.alias("_x"))
    sizes = rows.groupBy(*keys, "_bin").agg(F.count("_x").alias("_n"), F.avg("_x").alias("_avg"), F.var_pop("_x").alias("_var"))
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_all": F.sum("_n").over(whole), "_before": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    sizes = sizes.withColumn("mean", F.sum(F.col("_avg") * F.col("_n")).over(whole) / F.nullif("_all", F.lit(0)))
    sizes = sizes.withColumn("se", F.sqrt(F.sum((F.col("_var") + F.pow(F.col("_avg") - F.col("mean"), F.lit(2.0))) * F.col("_n")).over(whole) / F.nullif("_all", F.lit(0))))
    at = {n: (F.col("_all") - 1) * F.lit(share) for n, share in (("lower", a), ("upper", 1 - a))}
    ranks = [f(c) for c in at.values() for f in (F.floor, F.ceil)]
    holds = lambda low, n: lambda r: (r >= low) & (r < low + n)
    wanted = F.col("_all") == 0  # a group of nulls keeps its row
    for r in ranks:
        wanted = wanted | holds(F.col("_before"), F.col("_n"))(r)
    own = ["_all", "_before", "mean", "se"]
    # At most four bins a group.
    few = F.broadcast(sizes.where(wanted).select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate([*keys, "_bin"])), *own))
    same = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate([*keys, "_bin"])]
    counts = rows.join(few, same).groupBy(*keys, "_bin", *own, "_x").agg(F.count("_x").alias("_n"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_low", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    value_at = lambda r: F.max(F.when(holds(F.col("_low"), F.col("_n"))(r), F.col("_x")))
    bounds = [f.alias(f"_{n}{k}") for n, c in at.items() for k, f in enumerate((value_at(F.floor(c)), value_at(F.ceil(c)), F.first(c - F.floor(c))))]
    got = counts.groupBy(*keys).agg(F.first("mean").alias("mean"), F.first("se").alias("se"), *bounds)
    return got.select(*keys, "mean", "se", *((F.col(f"_{n}0") + F.when(F.col(f"_{n}2") > 0, (F.col(f"_{n}1") - F.col(f"_{n}0")) * F.col(f"_{n}2")).otherwise(0.0)).alias(n) for n in at))


def verdict(lower: str = "lower", upper: str = "upper", better: str = "better", rope: float = ROPE):
    """In five classes, tried in this order; better: +1 if more is better, else -1."""
    lo, hi = F.least(F.col(lower) * F.col(better), F.col(upper) * F.col(better)), F.greatest(F.col(lower) * F.col(better), F.col(upper) * F.col(better))
    return F.when((lo >= -rope) & (hi <= rope), "EQUIVALENT").when(lo > rope, "SUPERIOR").when(hi < -rope, "INFERIOR").when((lo < 0) & (hi > 0), "SPANS_ZERO").otherwise("BORDERLINE")


def score_bin(score: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """One of AUC_BINS bins of equal width over [lo, hi]; the end bins take what lies beyond."""
    at = F.floor((score - F.lit(lo)) * F.lit(AUC_BINS / (hi - lo))).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(AUC_BINS - 1), at))


def score_range(df: DataFrame, models: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    """The bins' range of each model's scores: [0, 1] for probabilities, else the middle 99.8 percent of its margins."""
    aggs = [f.alias(f"{m}_{n}") for m in models for n, f in (("lo", F.min(f"{m}_score")), ("hi", F.max(f"{m}_score")), ("q", F.percentile_approx(f"{m}_score", [0.001, 0.999], 10_000)))]
    got, out = df.agg(*aggs).first(), {}
    for m in models:
        lo, hi = got[f"{m}_lo"], got[f"{m}_hi"]
        inside = lo is None or (lo >= 0 and hi <= 1)
        low, high = (0.0, 1.0) if inside else map(float, got[f"{m}_q"])
        out[m] = (low, high) if high > low else (low - 0.5, low + 0.5)
    return out


def gathered(df: DataFrame, a: str, b: str) -> np.ndarray:
    """Label, both predictions, both score bins and the number of rows of each cell that has any: at most 8 x AUC_BINS x AUC_BINS columns, whatever the number of rows."""
    ends = score_range(df, (a, b))
    at = lambda m: score_bin(F.col(f"{m}_score"), *ends[m])
    cells = df.select(F.col("y").cast("int").alias("y"), *(F.col(f"{m}_pred").cast("int").alias(f"p{k}") for k, m in enumerate((a, b))), *(at(m).alias(f"s{k}") for k, m in enumerate((a, b))))
    got = cells.groupBy(*cells.columns).agg(F.count("*").alias("n")).toArrow()
    out = np.array([got.column(c).to_numpy() for c in got.column_names], np.int64)
    # In one order, so that a seed gives one result.
    return out[:, np.lexsort(out)]


def resampled(df: DataFrame, a: str, b: str, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(resample, metric, difference of a and b) for each resample of the rows, common to both models.

    Rows only matter by their cell (label, both predictions, both scores' bins), so a draw of n rows is
    one multinomial draw over the cells, from which all metrics of both models are taken: the work is
    bounded by the cells. The AUC takes scores in AUC_BINS bins (of probabilities or margins), ties half;
    the other metrics are exact.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(gathered(df, a, b))

    def draw(batches):
        import pandas as pd

        y, *rest, sizes = sent.value
        n = int(sizes.sum())
        if not n:
            return
        share = sizes / n
        # Of each model: the place of a cell among label and prediction, and among label and score bin.
        places = [(y * 2 + rest[k], y * AUC_BINS + rest[2 + k]) for k in (0, 1)]
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                c = np.random.default_rng([seed, int(k)]).multinomial(n, share)
                got = []
                for outcome, scored in places:
                    tn, fp, fn, tp = (int(v) for v in np.bincount(outcome, c, 4))
                    neg, pos = np.bincount(scored, c, 2 * AUC_BINS).reshape(2, AUC_BINS)
                    below = np.cumsum(neg) - neg
                    area = float((pos * (below + neg / 2)).sum() / max(pos.sum() * neg.sum(), 1))
                    got.append({"accuracy": (tp + tn) / n, "f1": 2 * tp / max(2 * tp + fp + fn, 1), "fpr": fp / max(fp + tn, 1), "auc": area})
                out += [(int(k), name, got[0][name] - got[1][name]) for name in got[0]]
            yield pd.DataFrame(out, columns=["resample", "metric", "difference"])

    return spark.range(resamples).mapInPandas(draw, "resample long, metric string, difference double")


def bootstrap(df: DataFrame, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(model_a, model_b, metric, mean, se, lower, upper, verdict) of each two models."""
    out = None
    for a, b in PAIRS:
        got = interval(resampled(df, a, b, resamples, seed), ["metric"], "difference").select(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "*")
        out = got if out is None else out.unionByName(got)
    return judged(out)


def judged(intervals: DataFrame) -> DataFrame:
    """intervals (metric, lower, upper) with their verdict."""
    better = F.lit(1)
    for name, up in HIGHER_IS_BETTER.items():
        better = F.when(F.col("metric") == name, 1 if up else -1).otherwise(better)
    return intervals.withColumn("better", better).withColumn("verdict", verdict()).drop("better")


#: Up to so many rows a draw of a Poisson total is the sum of their single draws.
SINGLE_DRAWS = 8
# The chances of a Poisson number of mean 1 to be at most 0 to 6 (beyond 7 lies one of 1e-6).
_AT_MOST = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(7)]


def poisson_total(seed: str, resample: Column, cell: Column, n: Column) -> Column:
    """The number of times that the n rows of a cell are drawn: a Poisson draw of mean n by hashes of the resample and the cell, the same on every engine.

    Up to SINGLE_DRAWS rows it is the sum of single draws of mean 1, for more the quantile of a normal
    draw z with its first correction for skewness, n + z sqrt(n) + (z^2 - 1) / 6, rounded.
    """
    from ..functions.columns import uniform

    # Within a lambda a draw is made once, however often it is compared.
    draws = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(SINGLE_DRAWS)).cast("int") - 1), lambda i: uniform(seed, resample, cell, i))
    single = F.aggregate(draws, F.lit(0), lambda total, u: total + sum(((u >= F.lit(x)).cast("int") for x in _AT_MOST[1:]), (u >= F.lit(_AT_MOST[0])).cast("int")))
    normal = F.sqrt(-2.0 * F.log(1.0 - uniform(seed, resample, cell, "a"))) * F.cos(2.0 * math.pi * uniform(seed, resample, cell, "b"))
    many = F.get(F.transform(F.array(normal), lambda z: F.floor(n + z * F.sqrt(n.cast("double")) + (z * z - 1.0) / 6.0 + 0.5)), F.lit(0))
    return F.when(n <= SINGLE_DRAWS, single).otherwise(F.greatest(F.lit(0), many)).cast("long")


def poisson_weight(seed: str, resample: Column, row_id: Column) -> Column:
    """A Poisson draw of mean 1 from a hash of the row, the same on every engine; at most 7, beyond which lies a chance of 1e-6."""
    # The digits are compared as they are: those of a draw u are at least those of x just if u >= x.
    draw = F.md5(F.concat_ws(":", F.lit(seed), resample.cast("string"), row_id.cast("string")).cast("binary"))
    steps = [F.lit(f"{math.ceil(x * 2**32):08x}") for x in _AT_MOST]
    return sum(((draw >= x).cast("int") for x in steps[1:]), (draw >= steps[0]).cast("int"))


def _each_resample(resamples: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")


def poisson_counts(df: DataFrame, resamples: int, seed: str = "boot") -> DataFrame:
    """(resample, model, n, right): the accuracy's bootstrap with Poisson weights of the rows."""
    rows = df.select("row_id", *((F.col(f"{m}_pred") == F.col("y")).cast("int").alias(m) for m in MODELS), _each_resample(resamples))
    rows = rows.withColumn("w", poisson_weight(seed, F.col("resample"), F.col("row_id")))
    sums = rows.groupBy("resample").agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col(m)).alias(m) for m in MODELS))
    return sums.select("resample", "n", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("right")) for m in MODELS))))


#: Rows of a task of poisson_bootstrap(), at which sums of all resamples are sent, and those that are drawn for at once.
ROWS_A_TASK, ROWS_AT_ONCE = 250_000, 40_000


def poisson_bootstrap(df: DataFrame, resamples: int = RESAMPLES, seed: str = "boot") -> DataFrame:
    """bootstrap() with Poisson weights of the rows, common to all models; scores lie in [0, 1].

    Every row has the draw of poisson_weight() in every resample. A row's cell of a model (label,
    prediction, score bin) is one number. A task draws for its rows, one resample after the other, and
    sums weights by resample and cell; it sends, for each resample and model, both labels' weights by
    score bin and those of true and false positives, whatever its number of rows.
    """
    cells, kept = 4 * AUC_BINS, 2 * AUC_BINS + 2
    cell = lambda m: F.coalesce((F.col("y").cast("int") * 2 + F.col(f"{m}_pred").cast("int")) * AUC_BINS + score_bin(F.col(f"{m}_score")), F.lit(-1))
    tail = F.coalesce(F.concat(F.lit(":"), F.col("row_id").cast("string")), F.lit(""))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_A_TASK))
    rows = df.select(tail.alias("_tail"), *(cell(m).alias(f"_{m}") for m in MODELS)).repartition(parts, "_tail")
    steps, n_models = [math.ceil(x * 2**32) for x in _AT_MOST], len(MODELS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((resamples, n_models, cells), np.int64)
        any_row, waiting = False, []

        def add(table: pa.Table) -> None:
            # Rows without a cell of a model have one of their own, which is left out.
            at = np.concatenate([np.where((c := table.column(k + 1).to_numpy()) < 0, n_models * cells, c + k * cells) for k in range(n_models)])
            tails, before = None, -1
            for r in range(resamples):
                beginning = f"{seed}:{r}".encode()
                if len(beginning) != before:
                    before = len(beginning)
                    tails = Tails(table.column(0).combine_chunks(), before)
                draw = tails.draws(beginning)
                w = np.zeros(len(draw), np.uint8)
                for x in steps:
                    w += draw >= np.uint32(x)
                total[r] += np.bincount(at, np.tile(w, n_models), n_models * cells + 1)[:-1].astype(np.int64).reshape(n_models, cells)

        for batch in batches:
            any_row = any_row or batch.num_rows > 0
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= ROWS_AT_ONCE:
                add(pa.Table.from_batches(waiting))
                waiting = []
        if sum(b.num_rows for b in waiting):
            add(pa.Table.from_batches(waiting))
        if not any_row:
            return
        by = total.reshape(resamples, n_models, 2, 2, AUC_BINS)
        sent = np.concatenate([by.sum(axis=3).reshape(resamples, n_models, 2 * AUC_BINS), by[:, :, ::-1, 1].sum(axis=3)], axis=2)
        for r in range(0, resamples, 50):
            own = [x.astype("<i8").tobytes() for x in sent[r : r + 50]]
            yield pa.RecordBatch.from_arrays([pa.array(range(r, r + len(own)), pa.int32()), pa.array(own, pa.binary())], names=["resample", "sums"])

    def judged_models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), "<i8").reshape(n_models, kept)
                total[r] = total[r] + own if r in total else own
        out = []
        for r, sums in total.items():
            got = {k: [] for k in HIGHER_IS_BETTER}
            for neg, pos, (tp, fp) in ((x[:AUC_BINS], x[AUC_BINS:-2], x[-2:].tolist()) for x in sums):
                n, p = int(neg.sum()), int(pos.sum())
                got["accuracy"].append((tp + n - fp) / (p + n) if p + n else None)
                got["f1"].append(2 * tp / max(tp + p + fp, 1))
                got["fpr"].append(fp / max(n, 1))
                got["auc"].append(float((pos * (np.cumsum(neg) - neg + neg / 2)).sum()) / max(p * n, 1))
            out += [(r, k, *v) for k, v in got.items()]
        if out:
            kinds = [pa.int32(), pa.string(), *[pa.float64()] * n_models]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["resample", "metric", *MODELS])

    made = rows.mapInArrow(local, "resample int, sums binary").repartition("resample")
    wide = made.mapInArrow(judged_models, "resample int, metric string, " + ", ".join(f"{m} double" for m in MODELS))
    pairs = F.array(*(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (F.col(a) - F.col(b)).alias("difference")) for a, b in PAIRS))
    return judged(interval(wide.select("metric", F.inline(pairs)), ["model_a", "model_b", "metric"], "difference"))
