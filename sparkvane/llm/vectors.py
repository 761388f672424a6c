"""Near-duplicate vectors by Euclidean p-stable hashing, then exact cosines.

Unit vectors are projected on Gaussian directions, shifted and quantised; some cells together
are a bucket of one table, and the tables find a pair at the threshold with the probability
`recall_at`. The projections grow with the logarithm of the number of vectors, so that a vector meets
about STRANGERS unrelated ones in a table, and the tables follow from RECALL (`plan_for`): the work
grows as n to the power 1.24. Vectors that share a bucket (and, if asked, a label) are compared exactly; a pair that
meets in several tables counts in the first only. Equal vectors are compared as one with a count.
Large buckets are dealt in chunks, so a bucket of any size is compared whole and in bounded memory.

A vector that is null, zero, of another length than `dim`, or holds null or non-finite components
links with nothing, and so does one whose label is null when labels must agree. Rows that repeat a
vec_id are kept, each with the same result; a null vec_id gets its row back with no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import chunked, components, roots, whole_runs
from .shared import cut, mix64, read

THRESHOLD, RECALL, STRANGERS, WIDTH, SEED, CHUNK, SMALL = 0.93, 0.994, 1.0, 1.5, 20240, 2000, 32


def cell_shared(cosine: float, width: float = WIDTH) -> float:
    """The probability that two unit vectors of this cosine share a cell of one projection."""
    c = math.sqrt(max(0.0, 2 - 2 * cosine)) or 1e-9
    r = width / c
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def recall_at(cosine: float, projections: int, tables: int, width: float = WIDTH) -> float:
    """The probability that two unit vectors of this cosine share a bucket of some table."""
    return 1 - (1 - cell_shared(cosine, width) ** projections) ** tables


def plan_for(n: int, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL, strangers: float = STRANGERS) -> tuple[int, int]:
    """The projections and tables for n vectors."""
    projections = max(4, math.ceil(math.log(max(n, 2) / strangers) / -math.log(cell_shared(0.0, width))))
    return projections, math.ceil(math.log(1 - recall) / math.log1p(-(cell_shared(threshold, width) ** projections)))


class Hasher:
    def __init__(self, dim: int, projections: int, tables: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)
        self.width, self.shape = width, (tables, projections)
        self.mult = mix64(np.arange(1, tables * projections + 1, dtype=np.uint64) + np.uint64(seed)).reshape(self.shape) | np.uint64(1)

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """Bucket numbers, vector x table."""
        cells = np.floor((unit @ self.a + self.b) / self.width).astype(np.int64).view(np.uint64).reshape(len(unit), *self.shape)
        return mix64((cells * self.mult).sum(axis=2, dtype=np.uint64)).view(np.int64)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, same_label: bool = True, width: float = WIDTH, seed: int = SEED, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding[, label])."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    label = F.col("label") if same_label else F.lit(0)
    rows = vectors.select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("v"), "embedding").where(good & F.col("label").isNotNull())
    # Equal vectors under one label are one class, named by its smallest vec_id; the vector itself is the key.
    kept = cut(rows.groupBy("label", F.transform("v", lambda x: x + 0.0).alias("v")).agg(F.countDistinct("vec_id").alias("n"), F.min("vec_id").alias("cls")), "vectors")
    projections, tables = plan_for(kept.count(), threshold, width, recall)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            vs = [np.array(v) for v in batch.column(1).to_pylist()]
            for dim in {len(v) for v in vs}:
                at = [k for k, v in enumerate(vs) if len(v) == dim]
                h = hashers.setdefault(dim, Hasher(dim, projections, tables, width, seed))
                x = np.stack([vs[k] for k in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                ids, step = batch.column(0).to_numpy()[at], max(1, 2_000_000 // (tables * projections))
                for s in range(0, len(x), step):
                    cls = np.repeat(ids[s : s + step], tables)
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(cls) // tables)), pa.array(h(x[s : s + step]).ravel()), pa.array(np.full(len(cls), dim, np.int32))], names=["cls", "t", "bucket", "dim"])

    placed = kept.select("cls", "v", "label").mapInArrow(buckets, "cls long, t int, bucket long, dim int").join(kept.select("cls", "label"), "cls")
    placed = cut(placed.select("cls", "t", F.xxhash64("label", "dim", "t", "bucket").alias("bucket")), "buckets")
    shared = placed.groupBy("t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = chunked(placed.join(shared, ["t", "bucket"]), ["bucket"], "size", "cls", CHUNK)
    met = met.join(kept.select("cls", "n", "v", "label"), "cls").select("t", "bucket", "i", "j", "chunk", "cls", "n", F.xxhash64("label").alias("label"), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}

        def linked(x: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray, cls: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> list[tuple]:
            """Link counts and roots of the pairs a, b (of a bucket each, by number) that meet in no table before t."""
            hasher = hashers.setdefault(x.shape[1], Hasher(x.shape[1], projections, tables, width, seed))
            step = max(1, 2_000_000 // (tables * projections))
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = np.concatenate([hasher(x[used[s : s + step]]) for s in range(0, len(used), step)])
            left, right, fresh = at[: len(a)], at[len(a) :], np.ones(len(a), bool)
            for s in range(0, len(a), step):
                fresh[s : s + step] = ~((keys[left[s : s + step]] == keys[right[s : s + step]]) & (np.arange(tables) < t[s : s + step, None])).any(axis=1)
            a, b = a[fresh], b[fresh]
            links = np.bincount(a, n[b], len(cls)) + np.bincount(b, n[a], len(cls))
            own = np.unique(np.concatenate([a, b]))
            top = roots(len(own), np.searchsorted(own, a), np.searchsorted(own, b))
            # The root of a tree within one bucket; buckets may share vectors but not rows.
            return [(int(cls[k]), int(links[k]), int(cls[own[r]])) for k, r in zip(own.tolist(), top, strict=True)]

        for t, bucket, i, j, chunk, cls, n, lab, v in whole_runs(batches, 4):
            dims = np.array([len(x) for x in v])
            group = np.cumsum(np.concatenate([[True], (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) - 1
            out: list[tuple] = []
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.stack([v[k] for k in own]).astype(float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                g, c, m, w, q, k, across = group[own], cls[own], n[own], lab[own], chunk[own], t[own], (i != j)[own]
                order = np.lexsort((c, g))
                x, g, c, m, w, q, k, across = x[order], g[order], c[order], m[order], w[order], q[order], k[order], across[order]
                starts = np.flatnonzero(np.diff(g, prepend=-1))
                sizes = np.diff(np.append(starts, len(g)))
                pairs = []
                # Small buckets side by side: every row with the one after it, the one after that, and so on.
                few = np.repeat(sizes <= SMALL, sizes)
                for off in range(1, min(SMALL, int(sizes.max()))):
                    a = np.flatnonzero((g[:-off] == g[off:]) & few[:-off] & (w[:-off] == w[off:])) if off < len(g) else np.zeros(0, int)
                    a = a[~across[a] | (q[a] != q[a + off])]
                    a = a[np.einsum("ij,ij->i", x[a], x[a + off]) >= threshold]
                    pairs.append((a, a + off))
                if pairs and (a := np.concatenate([p[0] for p in pairs])).size:
                    out += linked(x, a, np.concatenate([p[1] for p in pairs]), k[a], c, m, g)
                for s0, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                    if size <= SMALL:
                        continue
                    y = x[s0 : s0 + size]
                    for s in range(0, size, 512):
                        a, b = np.nonzero(y[s : s + 512] @ y.T >= threshold)
                        a, b = a + s + s0, b + s0
                        ok = (a < b) & (w[a] == w[b]) & (~across[a] | (q[a] != q[b]))
                        a, b = a[ok], b[ok]
                        for e in range(0, len(a), 200_000):
                            out += linked(x, a[e : e + 200_000], b[e : e + 200_000], k[a[e : e + 200_000]], c, m, g)
            yield _batch(out)

    met = met.repartition(*(F.col(c) for c in ("t", "bucket", "i", "j"))).sortWithinPartitions("t", "bucket", "i", "j")
    found = cut(met.mapInArrow(compare, "cls long, n long, root long"), "links")
    linked = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "vector-components")
    links = found.groupBy("cls").agg(F.sum("n").alias("other"))
    per_class = kept.join(links, "cls", "left").join(linked.withColumnRenamed("id", "cls"), "cls", "left")
    per_class = per_class.select("label", "v", F.coalesce("other", F.lit(0)).alias("other"), "n", F.coalesce("component", "cls").alias("component_id"))
    ids = rows.select("vec_id", "label", F.transform("v", lambda x: x + 0.0).alias("v")).distinct().join(per_class, ["label", "v"]).groupBy("vec_id").agg(F.sum(F.col("other") + F.col("n") - 1).alias("n_links"), F.min("component_id").alias("component_id"))
    done = vectors.select("vec_id").join(ids, "vec_id", "left")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"), (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cls", "n", "root"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
