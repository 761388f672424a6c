"""Language by rank-order profiles: the out-of-place distance of a text's most frequent n-grams.

Every label's profile is the ranking of its most frequent n-grams (one to three characters of its
words, each word between spaces), counted over all texts of that label that are not held out.
A text's own ranking is compared with each profile: an n-gram costs the difference of its ranks, or
the profile's length where the profile lacks it. The least total wins; ties go to the first label.

A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned.
Rows are kept as they are, repeated or not; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import held_out, read, sliced, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
TOP, MAX_LABELS = 300, 1000
_B = np.int64(21)


def grams(text: str) -> np.ndarray | None:
    """The n-grams of a text as numbers, one for each place; None if it has no letter."""
    found = LETTERS.findall(text)
    if not found:
        return None
    code = np.frombuffer(f" {' '.join(found).lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (code[:-1] << _B) | code[1:]
    three = (two[:-1] << _B) | code[2:]
    space = 32
    two, three = two[(code[:-1] != space) | (code[1:] != space)], three[code[1:-1] != space]
    return np.concatenate([code[code != space], two, three])


def ranking(found: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by their number."""
    keys, n = np.unique(found, return_counts=True)
    return keys[np.argsort(-n, kind="stable")[:top]]


def learn(docs: DataFrame, label: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """The profile of each label of docs (text, label). At most MAX_LABELS labels; more is an error."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        for part, some in sliced(batches, 0):
            texts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(some, part.column(1).to_pylist(), strict=True):
                if (g := grams(text)) is not None:
                    texts.setdefault(lang, []).append(g)
            for lang, gs in texts.items():
                own = have.setdefault(lang, [])
                own.append(np.unique(np.concatenate(gs), return_counts=True))
                if len(own) > 8:
                    own[:] = [fold(own)]
        for lang, parts in have.items():
            keys, n = fold(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], names=["label", "gram", "n"])

    small_batches(docs.sparkSession)
    counted = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select("text", F.col(label).cast("string").alias("label")).mapInArrow(counts, "label string, gram long, n long")
    totals = counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))
    best = totals.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= top)
    rows = best.limit(MAX_LABELS * top + 1).collect()
    if len({r.label for r in rows}) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.label, r.place)):
        found.setdefault(r.label, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in found.items()}


def distances(own: np.ndarray, known: np.ndarray, ranks: np.ndarray, top: int) -> np.ndarray:
    """Out-of-place distances of one ranking to all profiles. ranks: profile x n-gram, top where the profile lacks it."""
    if not len(known):
        return np.full(len(ranks), len(own) * top)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    hit = known[at] == own
    return np.abs(ranks[:, at[hit]] - np.flatnonzero(hit)).clip(max=top).sum(axis=1) + top * int((~hit).sum())


class Predictor:
    """The nearest profile of one text after another."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.labels, self.top = sorted(profiles), top
        self.known = np.unique(np.concatenate([profiles[k] for k in self.labels])) if self.labels else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.labels), len(self.known)), top, np.int64)
        for i, k in enumerate(self.labels):
            self.ranks[i, np.searchsorted(self.known, profiles[k])] = np.arange(len(profiles[k]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The label, and how much nearer than not at all its profile is."""
        if not self.labels or not text or (g := grams(text)) is None:
            return "und", 0.0
        d = distances(own := ranking(g, self.top), self.known, self.ranks, self.top)
        best = int(np.argmin(d))
        return self.labels[best], 1 - d[best] / (self.top * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """docs (doc_id, text) with lang_pred and score."""
    small_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Predictor(profiles, top)
        for part, texts in sliced(batches, 1):
            got = [nearest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(predict, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang)."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that have a language, with all their columns; those of `und` go."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Predictor(profiles)
        for part, texts in sliced(batches, at):
            yield part.filter(pa.array([nearest(t)[0] != "und" for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))
