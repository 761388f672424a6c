"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Texts are lower-cased, look-alike letters and digits are folded to the Latin letters they stand for,
accents are dropped and letters set apart by dots or dashes are drawn together. A lexicon entry is a
beginning of a word; it is matched where a word begins. Entries and weights (smoothed log odds) are
learned from labelled texts: nearly all texts with the entry are toxic, more of them than chance gives
to any of the candidates (a bound of the binomial tail, times their number, is under CHANCE), and it
stands in as many contexts as an entry has texts at least. Texts that are near copies count as one, so that the other
words of a toxic text with many copies stay out, however many rows there are. Phrases that hold an entry
but are found in clean texts are exceptions and mask the matches inside them (labelled texts without
such phrases give none; `score` takes any others). The score is a logistic
function of the weight sum and of the weight sum for each hundred words.

The lexicon is fitted on a bounded sample: the MAX_TOXIC and MAX_CLEAN labelled rows that come first
by the hash of doc_id; of near copies among them (SAME of the sketches' HASHES agree) one is kept.
What the sample gives is not cut further. Every text is scored whole. A null or empty text has no match and so the base
score, as has every text if there are no labels. Rows are kept as they are, repeated or not; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD, cut, held_out, mix64, read, sliced, small_batches, words

MAX_TOXIC, MAX_CLEAN = 8000, 16000
#: Characters of an entry, the least share of the toxic texts that have it, the share of texts with it that are toxic (of as many of both), and the expected number of entries by chance.
SHORTEST, LONGEST, LEAST_SHARE, PRECISION, CHANCE = 4, 40, 0.003, 0.85, 0.2
#: Of sketches of word pairs, and of their bands, by which near copies meet.
HASHES, BAND, SAME = 192, 3, 0.25

# Look-alike characters and the letters they stand for.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ſ": "s", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}
#: Characters that folding changes, beyond those whose compatibility form it takes.
_ODD = re.compile(r"[^a-z\s.,;:!?'\"()*#%&_-]")
_SIGN = re.compile(r"(?<![@$])[@$](?=[a-z])")
_NEXT = re.compile(r"[\W_]+[^\W_]+")
_APART = re.compile(r"\b\w(?:[.*_-]\w)+\b")


class _Folds(dict):
    """The folding of each character, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        import unicodedata

        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        self[code] = out = "".join(LOOKALIKES.get(c, c) for c in plain) if plain else LOOKALIKES.get(chr(code), "")
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """The text as the lexicon sees it."""
    text = text.lower()
    if _ODD.search(text):
        if "@" in text or "$" in text:
            text = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", text)
        text = text.translate(_FOLDS)
    if _APART.search(text):
        text = _APART.sub(lambda m: re.sub(r"[.*_-]", "", m[0]), text)
    return text


def beginnings(folded: str) -> set[str]:
    return {w[:k] for w in set(WORD.findall(folded)) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


class Matcher:
    """The matches of a lexicon that no exception masks."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.weights = weights
        self.found = ahocorasick.Automaton()
        for w in weights:
            self.found.add_word(w, (len(w), w))
        self.masks = ahocorasick.Automaton()
        for e in exceptions:
            self.masks.add_word(e, len(e))
        if weights:
            self.found.make_automaton()
        if exceptions:
            self.masks.make_automaton()

    def __call__(self, folded: str) -> list[tuple[int, str]]:
        if not self.weights:
            return []
        hits: dict[int, str] = {}
        for end, (size, w) in self.found.iter(folded):
            start = end - size + 1
            if not (start and folded[start - 1].isalnum()) and len(hits.get(start, "")) < size:
                hits[start] = w
        if hits and len(self.masks):
            masked = [(end - size + 1, end) for end, size in self.masks.iter(folded)]
            hits = {s: w for s, w in hits.items() if not any(a <= s and s + len(w) - 1 <= b for a, b in masked)}
        return sorted(hits.items())


def around(folded: str, start: int) -> list[str]:
    """The word at start with the word before it, and with the word after it: phrases that could excuse it."""
    end, a = start, start
    while end < len(folded) and folded[end].isalnum():
        end += 1
    while a and not folded[a - 1].isalnum():
        a -= 1
    first = a
    while first and folded[first - 1].isalnum():
        first -= 1
    after = _NEXT.match(folded, end)
    return ([folded[first:end]] if first < a else []) + ([folded[start : after.end()]] if after else [])


def surprise(k: int, n: int, share: float) -> float:
    """A bound from below of -log of the chance that k or more of n are toxic when a `share` of all is (Chernoff)."""
    q = k / n
    if q <= share:
        return 0.0
    return n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


@lru_cache(maxsize=4)
def _matcher(weights: tuple, exceptions: tuple) -> Matcher:
    return Matcher(dict(weights), list(exceptions))


def measures(text: str | None, matcher: Matcher) -> tuple[float, int]:
    """The weight sum of a text and its number of words."""
    if not text:
        return 0.0, 0
    folded = fold(text)
    return sum(matcher.weights[w] for _, w in matcher(folded)), folded.count(" ") + folded.count("\n") + 1


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), np.log1p(total), np.log1p(100 * total / np.maximum(n, 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients by Newton's method; the ridge spares the constant."""
    w, pull = np.zeros(x.shape[1]), ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w).clip(-35, 35)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
    return w


_FACTORS = mix64(np.arange(1, HASHES + 1)) | np.uint64(1)


def sketch(text: str) -> np.ndarray | None:
    """The least of each of HASHES hashes over the pairs of neighbouring words; None without pairs."""
    own = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words(text)], np.uint64)
    if len(own) < 2:
        return None
    pairs = mix64(np.unique(own[:-1] << np.uint64(32) | own[1:]))
    least = [(pairs[k : k + 5000, None] * _FACTORS).min(axis=0) for k in range(0, len(pairs), 5000)]
    return (np.min(least, axis=0) >> np.uint64(32)).astype("<u4")


def copies(sketches: list[np.ndarray]) -> list[int]:
    """The places of texts that are near copies of one before them, directly or by others in between."""
    up = list(range(len(sketches)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    heads: dict[tuple[int, bytes], int] = {}
    for k, own in enumerate(sketches):
        for b in range(0, HASHES, BAND):
            a, c = root(heads.setdefault((b, own[b : b + BAND].tobytes()), k)), root(k)
            if a != c and np.mean(sketches[heads[b, own[b : b + BAND].tobytes()]] == own) >= SAME:
                up[max(a, c)] = min(a, c)
    return [k for k in range(len(up)) if root(k) != k]


def apart(rows: DataFrame) -> DataFrame:
    """rows (d, text, y) without near copies of others of the same y. The sketches, of at most MAX_TOXIC + MAX_CLEAN texts, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, 1):
            got = [None if (k := sketch(t)) is None else k.tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got, pa.binary())], names=["d", "y", "sketch"])

    made = rows.select("d", "text", "y").mapInArrow(run, "d long, y int, sketch binary").where("sketch is not null").orderBy("y", "d").collect()
    gone = []
    for y in (0, 1):
        own = [m for m in made if m.y == y]
        gone += [(own[k].d, y) for k in copies([np.frombuffer(m.sketch, "<u4") for m in own])]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(gone, "d long, y int")), ["d", "y"], "left_anti")


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """d (a hash of the text), text and y of the labelled rows that are learned from; copies and near copies count once."""
    own = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    # At most MAX_TOXIC + MAX_CLEAN rows of two numbers.
    bounded = F.broadcast(picked[0].unionByName(picked[1]))
    return apart(cut(docs.select("doc_id", "text").where("text is not null").join(bounded, "doc_id").dropDuplicates(["text", "y"]).select(F.xxhash64("text").alias("d"), "text", "y"), "labelled"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[str], list[float]]:
    """The lexicon with its weights, the exception phrases and the coefficients of the score."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels)
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    base = math.log((toxic + 0.5) / (clean + 0.5)) if toxic or clean else -20.0
    if not toxic:
        return {}, [], [base, 0.0, 0.0]

    def counted(only: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have: Counter = Counter()
            for _, texts in sliced(batches, 0):
                for text in texts:
                    own = beginnings(fold(text))
                    have.update(own if only is None else own & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())], names=["w", "n"])

        return run

    def counts(y: int, only: frozenset | None, least: int) -> dict[str, int]:
        # As many as the bounded sample holds in `least` texts or more.
        got = rows.where(F.col("y") == y).select("text").mapInArrow(counted(only), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return {r.w: r.n for r in got.collect()}

    least = max(3, math.ceil(LEAST_SHARE * toxic))
    in_toxic = counts(1, None, least)
    in_clean = counts(0, frozenset(in_toxic), 1)
    rate = {w: (k / toxic) / (k / toxic + in_clean.get(w, 0) / max(clean, 1)) for w, k in in_toxic.items()}
    share, enough = toxic / (toxic + max(clean, 1)), math.log(max(len(in_toxic), 1) / CHANCE)
    sure = frozenset(w for w, r in rate.items() if r >= PRECISION and surprise(in_toxic[w], in_toxic[w] + in_clean.get(w, 0), share) >= enough)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in sliced(batches, 0):
            out = []
            for t in texts:
                own = WORD.findall(fold(t))
                first: dict[str, str] = {}
                for before, w in zip(["", *own], own, strict=False):
                    for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                        if w[:k] in sure:
                            first.setdefault(w[:k], before)
                out += first.items()
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["w", "before"])

    # A lexicon word has many contexts. Their share of its texts falls as these grow, so it is not looked at.
    varied = rows.where("y = 1").select("text").mapInArrow(holding, "w string, before string").groupBy("w").agg(F.countDistinct("before").alias("n"))
    contexts = {r.w: r.n for r in varied.where(F.col("n") >= least).collect()}
    entries: list[str] = []
    for w in sorted(contexts, key=lambda w: (-in_toxic[w] * rate[w] ** 4, -len(w), w)):
        if not any(w.startswith(e) or e.startswith(w) for e in entries):
            entries.append(w)
    # Shares from smoothed counts; an entry that clean texts lack weighs the most.
    weights = {w: math.log((in_toxic[w] + 0.5) / (toxic + 1)) - math.log((in_clean.get(w, 0) + 0.5) / (clean + 1)) for w in entries}

    key = tuple(sorted(weights.items()))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, ())
        for part, texts in sliced(batches, 0):
            out = [(p, y) for t, y in zip(texts, part.column(1).to_pylist(), strict=True) for f in [fold(t)] for p in {p for s, _ in m(f) for p in around(f, s)}]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], names=["p", "y"])

    met = rows.select("text", "y").mapInArrow(phrases, "p string, y int").groupBy("p").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    exceptions = sorted(r.p for r in met.where("good >= 5 and good > 10 * bad").collect())
    masks = tuple(exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, masks)
        for part, texts in sliced(batches, 0):
            got = [measures(t, m) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), part.column(1)], names=["total", "n", "y"])

    got = np.array([(r.total, r.n, r.y) for r in rows.select("text", "y").mapInArrow(measured, "total double, n long, y int").orderBy("total", "n", "y").collect()], float)
    return weights, exceptions, logistic(features(got[:, 0], got[:, 1]), got[:, 2]).tolist() if clean else [base, 0.0, 0.0]


def score(docs: DataFrame, weights: dict[str, float], exceptions: list[str], coefficients: list[float]) -> DataFrame:
    """doc_id, score and the matched entries for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    key, masks, w = tuple(sorted(weights.items())), tuple(exceptions), np.array(coefficients)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, masks)
        for part, texts in sliced(batches, 1):
            got = np.array([measures(t, m) for t in texts], float)
            x = features(got[:, 0], got[:, 1]) @ w
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-x.clip(-35, 35)))), pa.array(got[:, 0])], names=["doc_id", "score", "weight"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("weight", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text); labels (doc_id, toxic)."""
    done = score(docs, *learn(docs, labels))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
