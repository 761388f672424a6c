"""N-gram Jaccard join by chosen paths, verified exactly.

A document is the set of its five-word shingles (words: lower-cased runs of letters and digits; a
text of one to four words is one shingle; a text without words is an empty set and links with
nothing). Equal sets are one class and are never compared with each other.

Candidates: every class has COORDINATES min-wise sampled shingles. In each of RUNS runs the classes
are split by the values of sampled coordinates, and large nodes are split again by freshly sampled
coordinates down to DEPTH; small nodes are compared all with all by their sampled shingles. A pair
at the threshold survives a run with probability `run_recall`, and RUNS meets TARGET_RECALL. Nodes
that stay large are dealt in chunks and compared whole.

Verification: candidates that hang together are compared all with all by their whole shingle sets,
in chunks, so links among them are exact; tasks return link counts and spanning trees, not pairs.

Rows with a null doc_id come back with no links. Rows that repeat a doc_id share one result.
Null texts are empty sets. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import chunked, components, roots, runs
from .shared import WORD, cut, mix64, read, sliced, small_batches

N, THRESHOLD, COORDINATES, DEPTH, LEAF, CHUNK, SEED = 5, 0.8, 64, 3, 256, 512, 7
TARGET_RECALL, MARGIN = 0.999, 0.2


def run_recall(threshold: float = THRESHOLD, depth: int = DEPTH) -> float:
    """The least probability that a pair at the threshold shares a node at this depth of one run: a node samples one coordinate, and a second one time in four."""
    survive = 1.0
    for _ in range(depth):
        one = threshold * survive
        survive = 0.75 * one + 0.25 * (1 - (1 - one) ** 2)
    return survive


def runs_for(target: float = TARGET_RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - run_recall(threshold, depth)))


def shingle_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The shingles of each text as sorted distinct 64-bit numbers."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(f) for f in found])
    flat = [w for f in found for w in f]
    if not flat:
        return [np.zeros(0, np.uint64)] * len(texts)
    codes, names = pd.factorize(np.array(flat, dtype=object))
    word = pd.util.hash_array(np.asarray(names, dtype=object), categorize=False)[codes]
    ends = np.cumsum(sizes)
    rolled = np.zeros(len(word), np.uint64)
    for k in range(min(n, len(word))):
        part = mix64(word + np.uint64(k + 1))
        rolled[: len(word) - k] += part[k:] * np.uint64(2 * k + 1)
    out = []
    for e, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        if size >= n:
            out.append(np.unique(rolled[e - size : e - n + 1]))
        elif size:
            out.append(mix64(np.array([sum(int(x) * (2 * k + 1) << k for k, x in enumerate(word[e - size : e])) + size & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_MULT = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sampled shingle of each coordinate, 32 bits of it, set x coordinate; the sets are not empty."""
    flat = mix64(np.concatenate(sets))
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((flat * _MULT[k]) >> np.uint64(32), starts)
    return out


def children(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: one sampled coordinate of each node, and for a quarter of the nodes two."""
    a = mix64(node)
    first = (a % np.uint64(COORDINATES)).astype(int)
    second = ((first + 1 + (a >> np.uint64(32)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)).astype(int)
    two = np.flatnonzero((a >> np.uint64(20)) % np.uint64(4) == 0)
    row = np.concatenate([np.arange(len(node)), two])
    at = np.concatenate([first, second[two]])
    return row, mix64(node[row] * np.uint64(0x9E3779B97F4A7C15) + mix64((at.astype(np.uint64) << np.uint64(32)) | sketch[row, at].astype(np.uint64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for part, texts in sliced(batches, 1):
        sets = shingle_sets(texts)
        some = [s for s in sets if len(s)]
        sk = iter(sketches(some)) if some else iter(())
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array([next(sk).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "key", "sketch"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, node, sketch) to (cls, child)."""
    for batch in batches:
        sk = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
        row, child = children(batch.column(1).to_numpy().view(np.uint64), sk)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), pa.array(child.view(np.int64))], names=["cls", "node"])


def _near(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Spanning trees of the pairs of each node that agree in `least` coordinates or more."""
    a_out: list[int] = []
    b_out: list[int] = []
    for _, i, j, chunk, cls, sk in runs(batches, 3):
        x = np.frombuffer(b"".join(sk), np.uint32).reshape(len(cls), COORDINATES)
        # Equal sketches are tied first; one of each is compared.
        _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        same = same.ravel()
        own = np.flatnonzero(first[same] != np.arange(len(cls)))
        a, b = [own], [first[same[own]]]
        y = x[first]
        for s in range(0, len(y), 64):
            agree = np.zeros((len(y[s : s + 64]), len(y)), np.uint8)
            for k in range(COORDINATES):
                agree += y[s : s + 64, None, k] == y[None, :, k]
            p, q = np.nonzero(agree >= least)
            ok = p + s < q
            a.append(first[p[ok] + s])
            b.append(first[q[ok]])
        for k, r in enumerate(roots(len(cls), np.concatenate(a), np.concatenate(b))):
            if r != k:
                a_out.append(int(cls[k]))
                b_out.append(int(cls[r]))
        if len(a_out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
            a_out, b_out = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets)
    keys, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    out = np.zeros((len(sets), len(sets)), np.float32)
    useful = n[column] > 1
    row, column = row[useful], (np.cumsum(n > 1) - 1)[column[useful]]
    width = max(1, min(1 << 14, (1 << 24) // len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for s, e in zip(edges, edges[1:], strict=False):
        m = np.zeros((len(sets), width), np.float32)
        m[row[s:e], column[s:e] % width] = 1
        out += m @ m.T
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Link counts of the classes of each chunk pair, and the root of each in the links found there."""
    out: list[tuple[int, int, int]] = []
    for _, i, j, chunk, cls, n, raw in runs(batches, 3):
        sets = [np.frombuffer(r, np.uint64) for r in raw]
        sizes = np.array([len(s) for s in sets], np.float64)
        order = np.argsort(cls, kind="stable")
        sets, sizes, cls, n, chunk = [sets[k] for k in order], sizes[order], cls[order], n[order], chunk[order]
        both = shared_counts(sets)
        link = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        np.fill_diagonal(link, False)
        if i[0] != j[0]:
            link &= chunk[:, None] != chunk[None, :]
        count = (link * n[None, :]).sum(axis=1)
        top = roots(len(cls), *np.nonzero(np.triu(link)))
        out += [(int(cls[k]), int(count[k]), int(cls[top[k]])) for k in np.flatnonzero(count)]
        if len(out) > 50_000:
            yield _links(out)
            out = []
    yield _links(out)


def _links(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cls", "n", "root"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for part, texts in sliced(batches, 1):
        raw = [s.tobytes() for s in shingle_sets(texts)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "key", "shingles"])


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id (the smallest doc_id reachable by links), n_links and kept (doc_id = class_id), one row for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut(texts.where("doc_id is not null").mapInArrow(_sketch, "doc_id long, key binary, sketch binary"), "sketches")
    classes = cut(sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("cls"), F.countDistinct("doc_id").alias("n"), F.first("sketch").alias("sketch")), "classes")
    sk = classes.select("cls", "sketch")

    starts = F.transform(F.sequence(F.lit(1), F.lit(runs_for(threshold=threshold))), lambda r: F.xxhash64(r))
    level = sk.select("cls", F.explode(starts).alias("node"), "sketch").mapInArrow(_split, "cls long, node long")
    trees = []
    for depth in range(1, DEPTH + 1):
        level = cut(level, f"nodes-{depth}")
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        shared = cut(level.join(sizes, "node"), f"shared-{depth}")
        here = shared if depth == DEPTH else shared.where(F.col("size") <= leaf)
        dealt = chunked(here, ["node"], "size", "cls", max(leaf, 1024)).join(sk, "cls").select("node", "i", "j", "chunk", "cls", "sketch")
        dealt = dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
        least = math.ceil(COORDINATES * (threshold - MARGIN))
        trees.append(dealt.mapInArrow(lambda b, least=least: _near(b, least), "a long, b long"))
        if depth < DEPTH:
            level = shared.where(F.col("size") > leaf).join(sk, "cls").select("cls", "node", "sketch").mapInArrow(_split, "cls long, node long")
    edges = trees[0]
    for t in trees[1:]:
        edges = edges.unionByName(t)
    near = components(edges, "candidates")

    # The whole shingle sets of one document of each class that has candidates.
    wanted = near.join(classes.select(F.col("cls").alias("id"), "key", "n"), "id").select(F.col("id").alias("cls"), "component", "key", "n")
    sets = texts.join(wanted.select(F.col("cls").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_shingles, "doc_id long, key binary, shingles binary").dropDuplicates(["doc_id", "key"])
    sets = sets.withColumnRenamed("doc_id", "cls").join(wanted, ["cls", "key"]).drop("key")
    sizes = wanted.groupBy("component").agg(F.count("*").alias("size"))
    dealt = chunked(sets.join(sizes, "component"), ["component"], "size", "cls", chunk).select("component", "i", "j", "chunk", "cls", "n", "shingles")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = cut(dealt.mapInArrow(lambda b: _verify(b, threshold), "cls long, n long, root long"), "links")

    linked = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "classes-linked")
    other = found.groupBy("cls").agg(F.sum("n").alias("other"))
    per_class = classes.select("key", "cls", "n").join(other, "cls", "left").join(linked.withColumnRenamed("id", "cls"), "cls", "left")
    per_class = per_class.select("key", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("class_id"))
    ids = sketched.select("doc_id", "key").distinct().join(per_class, "key").groupBy("doc_id").agg(F.sum("n_links").alias("n_links"), F.min("class_id").alias("class_id"))
    done = texts.select("doc_id").join(ids, "doc_id", "left")
    return done.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("doc_id") == F.coalesce("class_id", "doc_id")).alias("kept"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of every class of near duplicates the document with the smallest doc_id stays.

    Documents without an id stand behind all others, by a hash of their text, so they go as well if
    another of their class is there; of those with the same text one is left.
    """
    nameless = docs.where("doc_id is null").dropDuplicates(["text"])
    both = docs.where("doc_id is not null").unionByName(nameless)
    key = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))
    gone = jaccard_join(both.select(key.alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return both.join(gone, key == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))
