"""Feature selection: variance filter, mutual information, rank correlation, pruning, mRMR, fold stability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import held
from . import metrics, split
from .neighbours import complement_information, information, neighbour_information  # noqa: F401

LEAST_VARIANCE, STRICT, MAX_BROADCAST = 1e-5, 0.9, 100_000


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, variance, n_distinct, kept) of each column over its non-null values; one pass."""
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("v", F.var_samp), ("d", F.countDistinct))]
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"v_{c}").alias("variance"), F.col(f"d_{c}").alias("n_distinct")) for c in columns))
    out = df.agg(*aggs).select(F.inline(rows))
    return out.withColumn("kept", _kept())


def _kept() -> Column:
    return ~((F.col("n_distinct") <= 1) | (F.coalesce("variance", F.lit(0.0)) <= LEAST_VARIANCE))


def equal_width(x: str, lo: str, hi: str, bins: int = 16) -> Column:
    """One of `bins` bins of equal width between two columns' values."""
    x, lo, hi = F.col(x), F.col(lo), F.col(hi)
    return F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins))).otherwise(0)


def melt(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """keep, name, x: one row for each column's value."""
    return df.select(*keep, F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns)))).where("x is not null")


def binned_information(df: DataFrame, columns: list[str], y: str, bins: int = 16) -> DataFrame:
    """(name, mi): plug-in mutual information, in nats, of the label and each column in bins of equal width."""
    long = melt(df, columns, F.col(y).alias("y"))
    ends = long.groupBy("name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # One row a column.
    n = long.join(F.broadcast(ends), "name").groupBy("name", equal_width("x", "lo", "hi", bins).alias("bin"), "y").agg(F.count("*").cast("double").alias("n"))
    return _plug_in(n, ["name"])


def _plug_in(n: DataFrame, keys: list[str]) -> DataFrame:
    """keys and mi, for the numbers n of rows by keys, bin and y."""
    total = lambda *by: F.sum("n").over(Window.partitionBy(*keys, *by))
    terms = n.select(*keys, (F.col("n") / total() * F.log(F.col("n") * total() / (total("bin") * total("y")))).alias("term"))
    return terms.groupBy(*keys).agg(F.round(F.greatest(F.lit(0.0), F.sum("term")), 6).alias("mi"))


def by_information(df: DataFrame) -> DataFrame:
    """Highest first, the later name first on ties."""
    return df.orderBy(F.desc("mi"), F.desc("name"))


def value_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, x, rank): the average rank of each distinct value of each column, so no window holds all rows."""
    counts = metrics.cumulative(melt(df, columns, F.lit(0).alias("y")), ["name"], "y", "x")
    return counts.select("name", F.col("score").alias("x"), (F.col("neg_below") + (F.col("neg") + 1) / 2.0).alias("rank"))


def average_ranks(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """row_id, name, rank."""
    return melt(df, columns, row_id).join(value_ranks(df, columns), ["name", "x"]).select(row_id, "name", "rank")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) of each two columns, a < b; null for a constant column.

    A column's ranks, one row a distinct value, are joined to the rows by value; those of up to
    MAX_BROADCAST values are sent to all tasks, others are shuffled.
    """
    pairs = [(a, b) for a in sorted(columns) for b in sorted(columns) if a < b]
    spark = df.sparkSession
    with held(value_ranks(df, columns)) as found:
        sizes = {r.name: r.n for r in found.groupBy("name").agg(F.count("*").alias("n")).collect()}
        ranks = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
        for c in columns:
            own = found.where(F.col("name") == c).select(F.col("x").alias(c), F.col("rank").alias(f"r_{c}"))
            ranks = ranks.join(F.broadcast(own) if sizes.get(c, 0) <= MAX_BROADCAST else own, c, "left")
        got = _products(ranks.withColumn("_one", F.lit(1)), ["_one"], pairs).select("a", "b", "rho").collect()  # a row a pair
    return spark.createDataFrame(got, "a string, b string, rho double")


def _products(ranks: DataFrame, keys: list[str], pairs: list[tuple[str, str]], weight: Column | None = None) -> DataFrame:
    """keys, a, b and rho, for rows with the rank r_c of each column c; a row may stand for `weight` of them."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    aggs, n = [], F.sum(w)
    for a, b in pairs:
        x, y = F.col(f"r_{a}"), F.col(f"r_{b}")
        cov = n * F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y)
        var = (n * F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x)) * (n * F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y))
        aggs.append(F.when(var > 0, cov / F.sqrt(var)).alias(f"{a}|{b}"))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}|{b}"), 6).alias("rho")) for a, b in pairs))
    return ranks.groupBy(*keys).agg(*aggs).select(*keys, F.inline(rows))


def rho_table(rows: list) -> dict[tuple[str, str], float]:
    out = {}
    for r in rows:
        out[r.a, r.b] = out[r.b, r.a] = abs(r.rho or 0.0)
    return out


def prune(mi: dict[str, float], rho: dict[tuple[str, str], float], limit: float = STRICT) -> tuple[list[str], list[dict]]:
    """Names kept, most informative first, and for each dropped one the first kept name that it follows too closely."""
    kept: list[str] = []
    dropped = []
    for c in sorted(mi, key=lambda c: (mi[c], c), reverse=True):
        by = next((k for k in kept if rho.get((c, k), 0.0) > limit), None)
        if by is None:
            kept.append(c)
        else:
            dropped.append({"name": c, "kept": by, "rho": round(rho[c, by], 5), "mi": round(mi[c], 6), "kept_mi": round(mi[by], 6)})
    return kept, dropped


def mrmr(mi: dict[str, float], rho: dict[tuple[str, str], float], k: int, quotient: bool = False) -> list[str]:
    """k names: the most informative, then again and again the best of information less (or over) mean redundancy, the more informative one on ties."""
    order = sorted(mi, key=lambda c: (mi[c], c), reverse=True)
    gain, near = np.array([mi[c] for c in order]), np.array([[rho.get((c, d), 0.0) for d in order] for c in order])
    free, redundancy, picked = np.ones(len(order), bool), np.zeros(len(order)), []
    for n in range(min(k, len(order))):
        mean = redundancy / max(n, 1)
        worth = gain if not n else gain / (mean + 1e-5) if quotient else gain - mean
        best = int(np.argmax(np.where(free, worth, -np.inf)))
        free[best] = False
        redundancy += near[best]
        picked.append(order[best])
    return picked


def select_features(df: DataFrame, pool: list[str], y: str, row_id: str, k: int = 4, exclude: tuple[str, ...] = (), seed: int = 42, quotient: bool = False, binned: bool = False) -> dict:
    """Exclude, filter by spread, measure information (by neighbours or in bins), prune, pick. What comes to the driver is one row a column or pair."""
    columns = [c for c in sorted(pool) if c not in exclude]
    names, mi, rho = _told(df, columns, y, F.lit(0), [None], binned)[None]
    kept = sorted(names)
    if not kept:
        return {"selected": [], "survivors": [], "dropped": [], "mi": {}}
    mi = {c: mi[c] for c in kept if c in mi} if binned else {r.name: r.mi for r in neighbour_information(df, kept, y, row_id, seed).collect()}
    survivors, dropped = prune(mi, rho)
    return {"selected": mrmr({c: mi[c] for c in survivors}, rho, k, quotient), "survivors": survivors, "dropped": dropped, "mi": mi}


def combinations(df: DataFrame, columns: list[str], y: Column, fold: Column, n_folds: int) -> DataFrame:
    """The distinct values of columns with the label _y, and the number of their rows in each fold as _n."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns), y.alias("_y"), fold.alias("_fold"))
    sizes = rows.groupBy(*columns, "_y").agg(*(F.count(F.when(F.col("_fold") == f, 1)).alias(f"_n{f}") for f in range(n_folds)))
    return sizes.select(*columns, "_y", F.array(*(f"_n{f}" for f in range(n_folds))).alias("_n"))


def complements(df: DataFrame, columns: list[str], y: str, fold: str, n_folds: int, binned: bool) -> dict[int, tuple[list[str], dict[str, float], dict]]:
    """For the rows outside each fold: the columns that spread() keeps, their binned information (if asked for) and rank correlations."""
    return _told(df, columns, y, F.col(fold), list(range(n_folds)), binned)


def _told(df: DataFrame, columns: list[str], y: str, fold: Column, folds: list[int | None], binned: bool) -> dict[int | None, tuple[list[str], dict[str, float], dict]]:
    """complements(); those of all rows for a fold of None.

    The rows are read once, whatever the folds, and counted by combination of values, label and fold: what
    a fold leaves is the total less the fold's own. Spread, bins and ranks are functions of the counts by
    value; ranks are multiplied and summed once a combination, with its number of rows.
    """
    pairs = [(a, b) for a in sorted(columns) for b in sorted(columns) if a < b]
    total = F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x)
    outside = lambda f: F.struct(F.lit(-1 if f is None else f).alias("out"), (total if f is None else total - F.col("_n")[f]).alias("n"))
    left = F.inline(F.filter(F.array(*map(outside, folds)), lambda o: o["n"] > 0))
    found: dict[int, tuple[list[str], dict[str, float], dict]] = {-1 if f is None else f: ([], {}, {}) for f in folds}
    with held(combinations(df, columns, F.col(y) if binned else F.lit(0), fold, len(folds))) as rows:
        values = melt(rows, columns, F.col("_y").alias("y"), "_n").groupBy("name", "x", "y").agg(F.array(*(F.sum(F.col("_n")[f]) for f in range(len(folds)))).alias("_n"))
        with held(values.select("name", "x", "y", left)) as each_label:
            keys = ["out", "name"]
            each = each_label.groupBy(*keys, "x").agg(F.sum("n").alias("n")) if binned else each_label
            centre = each.groupBy(*keys).agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"), F.sum("n").alias("all"), F.count("*").alias("n_distinct"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            # A row a fold and column.
            centre = F.broadcast(centre)
            spreads = each.join(centre, keys).groupBy(*keys, "all", "n_distinct").agg((F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)) / F.nullif(F.col("all") - 1, F.lit(0))).alias("variance"))
            for r in spreads.where(_kept()).collect():
                found[r.out][0].append(r["name"])
            if binned:
                for r in _plug_in(each_label.join(centre, keys).groupBy(*keys, equal_width("x", "lo", "hi").alias("bin"), "y").agg(F.sum("n").cast("double").alias("n")), keys).collect():
                    found[r.out][1][r["name"]] = r.mi
            if pairs:
                counts = each.select(*keys, metrics.bin_of(F.col("x")).alias("_bin"), F.col("x").alias("score"), F.lit(0).cast("long").alias("pos"), F.col("n").alias("neg"))
                ranks = metrics.below(counts, keys).select(*keys, F.col("score").alias("x"), (F.col("neg_below") + (F.col("neg") + 1) / 2.0).alias("rank"))
                with held(ranks.groupBy("name", "x").agg(F.map_from_entries(F.collect_list(F.struct("out", "rank"))).alias("ranks"))) as ranks:
                    sizes = {r["name"]: r.n for r in ranks.groupBy("name").agg(F.count("*").alias("n")).collect()}
                    ranked = rows
                    for c in columns:
                        own = ranks.where(F.col("name") == c).select(F.col("x").alias(c), F.col("ranks").alias(f"m_{c}"))
                        ranked = ranked.join(F.broadcast(own) if sizes.get(c, 0) <= MAX_BROADCAST else own, c, "left")
                    ranked = ranked.select(*(f"m_{c}" for c in columns), left)
                    ranked = ranked.select("out", "n", *(F.element_at(f"m_{c}", F.col("out")).alias(f"r_{c}") for c in columns))
                    for r in _products(ranked, ["out"], pairs, F.col("n")).collect():
                        found[r.out][2][r.a, r.b] = found[r.out][2][r.b, r.a] = abs(r.rho or 0.0)
    return {f: found[-1 if f is None else f] for f in folds}


def stability(df: DataFrame, pool: list[str], y: str, row_id: str, k: int = 4, n_folds: int = 5, seed: int = 42, binned: bool = False) -> list[dict]:
    """How many folds pick each feature, most first, then by name: select_features() on the rows outside each, from sums that all folds share."""
    picks: dict[str, int] = {}
    columns = sorted(pool)
    # Ranked once: the sizes of the ranks' bins are counted over what is held.
    with held(split.in_bins(df.select(row_id, y, *columns), row_id, y, seed)) as binned_rows:
        dealt = split.dealt(binned_rows, n_folds, y)
        found = complements(dealt, columns, y, "fold", n_folds, binned)
        near = {} if binned else complement_information(dealt, columns, y, row_id, "fold", n_folds, seed)
        for f, (kept, mi, rho) in found.items():
            mi = {c: v for c, v in (mi if binned else near[f]).items() if c in kept}
            survivors, _ = prune(mi, rho)
            for c in mrmr({c: mi[c] for c in survivors}, rho, k):
                picks[c] = picks.get(c, 0) + 1
    return [{"name": c, "folds": n, "frequency": round(n / n_folds, 4)} for c, n in sorted(picks.items(), key=lambda x: (-x[1], x[0]))]


def selection_frequency(picks: DataFrame, n_folds: int) -> DataFrame:
    """picks (fold, names) as name, folds and frequency, most first."""
    one = picks.select("fold", F.explode("names").alias("name")).distinct()
    return one.groupBy("name").agg(F.count("*").alias("folds"), F.round(F.count("*") / F.lit(n_folds), 4).alias("frequency")).orderBy(F.desc("folds"), "name")
