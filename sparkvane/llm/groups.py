"""Groups without one task for each: chunks of large groups, runs of equal keys, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def chunked(df: DataFrame, key: list[str], size: str, member: str, limit: int) -> DataFrame:
    """Deal the rows of each group into chunks of about `limit` members and pair the chunks.

    Adds chunk, i and j. A task that gets all rows of one (key, i, j) holds two chunks at most, and
    every two members of a group meet in exactly one (i, j). Groups up to `limit` stay one (0, 0).
    """
    many = F.ceil(F.col(size) / limit).cast("int")
    return (
        df.withColumn("_q", many)
        .withColumn("chunk", F.pmod(F.xxhash64(*key, member), F.col("_q")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
        .withColumn("i", F.least("chunk", "_o"))
        .withColumn("j", F.greatest("chunk", "_o"))
        .drop("_q", "_o")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """The columns of each run of rows that agree in their first `keys` (integer) columns; lists for binary columns."""
    held: list | None = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [c.to_numpy(zero_copy_only=False) if pa.types.is_primitive(c.type) else c.to_pylist() for c in batch.columns]
        if held is not None:
            cols = [h + c if isinstance(c, list) else np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        differs = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            differs |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(differs) + 1).tolist()]
        for s, e in zip(starts, starts[1:], strict=False):
            yield [c[s:e] for c in cols]
        held = [c[starts[-1] :] for c in cols]
    if held is not None:
        yield held


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """The columns of many rows at once; rows that agree in their first `keys` (integer) columns stay together."""
    held: list | None = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [c.to_numpy(zero_copy_only=False) if pa.types.is_primitive(c.type) else c.to_pylist() for c in batch.columns]
        if held is not None:
            cols = [h + c if isinstance(c, list) else np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        last = np.ones(len(cols[0]), bool)
        for c in cols[:keys]:
            last &= c == c[-1]
        e = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if e:
            yield [c[:e] for c in cols]
        held = [c[e:] for c in cols]
    if held is not None:
        yield held


class Forest:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    forest = Forest(n)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        forest.join(x, y)
    return [forest.root(x) for x in range(n)]


def splittable(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to the rows of right, of which each key has one, so that adaptive execution may deal a hot key's left rows to many tasks.

    It splits only joins whose sides were both shuffled for the join itself; by a second key, a right
    side that was aggregated by the first one is shuffled again.
    """
    hashed = F.xxhash64(key).alias("_h")
    return left.select("*", hashed).join(right.select("*", hashed), [key, "_h"], how).drop("_h")


def _hooked(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = splittable(both.where("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = splittable(large, low, "a")
    return small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id reachable. Alternating large and small stars.

    Each step is a few aggregations and joins that spread over the cluster, written to the shared
    folder; the number of steps grows with the logarithm of the longest chain. No edges: no rows.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = sign(edges)
    while before[0]:
        edges = cut(_hooked(edges), name)
        now = sign(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
