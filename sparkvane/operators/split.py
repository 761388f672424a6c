"""Stratified, seeded, disjoint partitions by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import uniform

BINS = 1024


def hash_order(row_id: str, seed: int) -> Column:
    return uniform(str(seed), F.col(row_id))


def _placed(drawn: DataFrame, keys: list[str], row_id: str, label: str, at_most: dict | None) -> DataFrame:
    """Rows with a draw (_u) with `place`: their rank within keys in the order of the draws."""
    df = drawn.withColumn("_bin", F.floor(F.col("_u") * BINS).cast("int"))
    sizes = df.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if at_most is not None:
        wanted = F.lit(0)
        for value, k in at_most.items():
            wanted = F.when(F.col(label) == value, k).otherwise(wanted)
        sizes = sizes.where(F.col("_before") < wanted)
    own = Window.partitionBy(*keys, "_bin").orderBy("_u", row_id)
    # At most BINS rows for each of the keys.
    placed = df.join(F.broadcast(sizes.drop("_n")), [*keys, "_bin"]).withColumn("place", F.row_number().over(own) - 1 + F.col("_before"))
    return placed.drop("_u", "_bin", "_before")


def ranked(df: DataFrame, row_id: str, label: str, seed: int, at_most: dict | None = None) -> DataFrame:
    """df with `place`, its 0-based rank within its label in hash order.

    Draws are filed in BINS; ranks count within a bin and add the sizes of the bins before, so that a
    label of any size is ranked by many tasks. at_most drops whole bins beyond the places wanted.
    """
    return _placed(df.withColumn("_u", hash_order(row_id, seed)), [label], row_id, label, at_most)


def quotas(counts: dict, n: int) -> dict:
    """n shared among labels in proportion to their counts, by largest remainder; ties to the smaller label."""
    total = sum(counts.values())
    if n > total:
        raise ValueError(f"{n} rows wanted of {total}")
    exact = {k: n * c / total for k, c in counts.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(counts, key=lambda k: (-(exact[k] - out[k]), k))[: n - sum(out.values())]:
        out[k] += 1
    return out


def label_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def sample(df: DataFrame, n: int, row_id: str, label: str, seed: int) -> DataFrame:
    """A stratified sample of exactly n rows."""
    want = quotas(label_counts(df, label), n)
    limit = F.lit(0)
    for value, k in want.items():
        limit = F.when(F.col(label) == value, k).otherwise(limit)
    return ranked(df, row_id, label, seed, want).where(F.col("place") < limit).drop("place")


def _ranges(counts: dict, sizes: dict[str, int], label: str) -> tuple[Column, dict]:
    """The split of a place, and the places taken of each label."""
    if sum(sizes.values()) > sum(counts.values()):
        raise ValueError(f"{sum(sizes.values())} rows wanted of {sum(counts.values())}")
    start = dict.fromkeys(counts, 0)
    split, left = F.lit(None).cast("string"), dict(counts)
    for name, n in sizes.items():
        q = quotas(left, n)
        for value, k in q.items():
            inside = (F.col(label) == value) & (F.col("place") >= start[value]) & (F.col("place") < start[value] + k)
            split = F.when(inside, F.lit(name)).otherwise(split)
            start[value] += k
            left[value] -= k
    return split, start


def partitions(df: DataFrame, sizes: dict[str, int], row_id: str, label: str, seed: int) -> DataFrame:
    """df with `split`: consecutive ranges of the hash order of each label, disjoint by construction; ValueError if df is too small."""
    split, start = _ranges(label_counts(df, label), sizes, label)
    return ranked(df, row_id, label, seed, start).withColumn("split", split).where("split is not null")


def partitions_by_seed(df: DataFrame, sizes: dict[str, int], row_id: str, label: str, seeds: tuple[int, ...], counts: dict | None = None) -> DataFrame:
    """partitions() for several seeds from the same two readings of df: with `seed`, `split` and `place`, a row for each seed that takes it."""
    split, start = _ranges(counts or label_counts(df, label), sizes, label)
    draws = F.explode(F.array(*(F.struct(F.lit(int(s)).alias("seed"), hash_order(row_id, s).alias("_u")) for s in seeds)))
    drawn = df.withColumn("_d", draws).withColumns({"seed": F.col("_d.seed"), "_u": F.col("_d._u")}).drop("_d")
    return _placed(drawn, ["seed", label], row_id, label, start).withColumn("split", split).where("split is not null")


def bounded_partitions(df: DataFrame, train: int, validation: int, test: int, row_id: str, label: str, seed: int) -> DataFrame:
    """Partitions under the hard ceilings of the restricted experiment."""
    for n, ceiling in ((train, 100), (validation, 50), (test, 100)):
        if not 0 < n <= ceiling:
            raise ValueError(f"{n} is not within 1 and {ceiling}")
    return partitions(df, {"train": train, "validation": validation, "test": test}, row_id, label, seed)


def fraction_split(df: DataFrame, fraction: float, row_id: str, label: str, seed: int) -> DataFrame:
    """df with `split`: train, or validation for a fraction of each label (rounded up)."""
    drawn = df.withColumn("_u", hash_order(row_id, seed)).withColumn("_bin", F.floor(F.col("_u") * BINS).cast("int"))
    sizes = drawn.groupBy(label, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_wanted": F.ceil(F.lit(fraction) * F.sum("_n").over(Window.partitionBy(label)))})
    begun = lambda c: F.max(F.when(F.col("_before") < F.col("_wanted"), F.col(c)))
    # Of each label the last bin that has any of the fraction, and the places before it: only rows of that bin need a rank.
    edges = sizes.groupBy(label).agg(F.coalesce(begun("_bin"), F.lit(-1)).alias("_edge"), F.coalesce(begun("_before"), F.lit(0)).alias("_before"), F.max("_wanted").alias("_wanted"))
    rows = drawn.join(F.broadcast(edges), label)
    side = lambda c: F.when(c, "validation").otherwise("train")
    clear = rows.where(F.col("_bin") != F.col("_edge")).withColumn("split", side(F.col("_bin") < F.col("_edge")))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_u", row_id)) - 1 + F.col("_before")
    ranked_ = rows.where(F.col("_bin") == F.col("_edge")).withColumn("split", side(place < F.col("_wanted")))
    return clear.unionByName(ranked_).select(*df.columns, "split")


def folds(df: DataFrame, k: int, row_id: str, label: str, seed: int) -> DataFrame:
    """df with `fold` from 0 to k - 1, stratified."""
    return ranked(df, row_id, label, seed).withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def in_bins(df: DataFrame, row_id: str, label: str, seed: int) -> DataFrame:
    """df with `_bin` and `_rank`, a row's bin of the hash order and its rank in there within its label: what dealt() goes on from, for callers that hold it."""
    drawn = df.withColumn("_u", hash_order(row_id, seed)).withColumn("_bin", F.floor(F.col("_u") * BINS).cast("int"))
    return drawn.withColumn("_rank", F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_u", row_id)) - 1).drop("_u")


def dealt(ranked_in_bins: DataFrame, k: int, label: str) -> DataFrame:
    """folds() of the rows of in_bins()."""
    sizes = ranked_in_bins.groupBy(label, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    # At most BINS rows for each label.
    sizes = F.broadcast(sizes.select(label, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return ranked_in_bins.join(sizes, [label, "_bin"]).withColumn("fold", ((F.col("_rank") + F.col("_before")) % k).cast("int")).drop("_bin", "_rank", "_before")


def remainder(df: DataFrame, taken: DataFrame, row_id: str) -> DataFrame:
    return df.join(taken.select(row_id), row_id, "left_anti")


def reprojected(df: DataFrame, assignment: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Other columns of the rows of an assignment."""
    return df.select(row_id, *columns).join(assignment.select(row_id), row_id, "left_semi")


def overlaps(assigned: DataFrame, row_id: str) -> DataFrame:
    """Rows that more than one split holds; none if the splits are disjoint."""
    return assigned.groupBy(row_id).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def check_disjoint(assigned: DataFrame, row_id: str) -> None:
    if overlaps(assigned, row_id).limit(1).count():
        raise RuntimeError("splits overlap")


def landmarks(df: DataFrame, m: int, row_id: str, seed: int) -> DataFrame:
    """The first m rows of one hash order: samples of different m are nested. m is the size of the sample, which is the feature."""
    return df.withColumn("_u", hash_order(row_id, seed)).orderBy("_u", row_id).limit(m).drop("_u")
