"""Benchmark decontamination by latent semantic retrieval, checked by common subsequences.

Texts become sequences of the benchmark's words (every other word is "another word"). Passages of
PASSAGE words, as TF-IDF vectors over all texts and the benchmark's items, are factorised by a
distributed randomised SVD of one pass: tasks sum A'(A R) for a random orthonormal R, and the driver
takes the singular vectors from that matrix of one row a word (the Nystrom form for A'A). A benchmark
is cut into blocks of BLOCK_ITEMS items, each with a latent space of its own words, so that the rank
is enough however many items there are. Each item is then compared with every window of about its
length, by cosine in the latent space (other words count in the window's length), divided by the part
of the item's own length that the space keeps. An item's own words count at least as they do in the
full space, and other words never count against it, so a window that holds 2 COSINE of an item's
squared TF-IDF length passes, a verbatim copy always. Candidates are verified: the longest common subsequence of item and
window must hold SHARE of the item's words, and ANSWER_SHARE of its answer, which is its last
sentence, or its last quarter where that is longer; a window that holds NEAR_ALL of the item needs no
answer check.

The benchmark is the stated query set: it is read by the driver and refused beyond MAX_VOCABULARY
words. All other work is spread over the texts, each of which is coded once. Null, empty and short
texts and items under LEAST_WORDS words match nothing. Rows that repeat a doc_id or item_id each
count; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import copy
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import runs
from .shared import WORD, cut, latin_words, read, sliced, small_batches, words

RANK, OVERSAMPLE, PASSAGE, COSINE, SHARE, ANSWER_SHARE, NEAR_ALL = 192, 16, 32, 0.2, 0.6, 0.5, 0.9
MAX_VOCABULARY, COMMON, RAREST, LEAST_WORDS, SEED, BLOCK, SLICE_WORDS = 300_000, 0.1, 8, 5, 31, 256, 60_000
#: Of a block, unless one item has more; and the least part of an item's length that its cosine is divided by.
BLOCK_ITEMS, BLOCK_WORDS, LEAST_KEPT = 256, 8192, 0.2
_SENTENCE = re.compile(r"[.!?]\s+(?=\S)")


class Item:
    """A benchmark item: its words as numbers and how many of the last are its answer."""

    def __init__(self, item_id: int, text: str, number: dict[str, int]):
        self.item_id = item_id
        self.ids = np.array([number[w] for w in words(text)], np.int32)
        last = len(words(_SENTENCE.split(text.strip())[-1]))
        self.answer = max(1, min(last, len(self.ids)) if last < len(self.ids) else 0, len(self.ids) // 4)
        # Windows of an item are five strides; a window then holds the item wherever it lies.
        self.stride = max(4, 1 << max(0, math.ceil(math.log2(len(self.ids))) - 2))


class Pattern:
    """Longest common subsequences with one sequence, a bit for each of its places."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.masks: dict[int, int] = {}
        for k, w in enumerate(ids.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << k

    def common(self, other: list[int]) -> int:
        all_, v = (1 << self.n) - 1, (1 << self.n) - 1
        for w in other:
            if (m := self.masks.get(w)) is not None:
                u = v & m
                v = ((v + u) | (v - u)) & all_
        return self.n - v.bit_count()


def code(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """doc_id and the words of each text as little-endian 32-bit numbers, -1 for words that no item has."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import repeat

        get = sent.value.get
        latin = {w.encode("latin-1"): k for w, k in sent.value.items() if all(ord(c) < 256 for c in w)}.get

        def numbers(t: str) -> bytes:
            own = latin_words(t)
            found = map(get, WORD.findall(t.lower()), repeat(-1)) if own is None else map(latin, own, repeat(-1))
            return np.fromiter(found, "<i4").tobytes()

        for part, texts in sliced(batches, 1):
            coded = [numbers(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coded, pa.binary())], names=["doc_id", "ids"])

    own = docs.where("text is not null and text <> ''").select("doc_id", "text")
    return own.mapInArrow(run, T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())]))


def _sequences(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for raw in batch.column(column).to_pylist():
            yield np.frombuffer(raw, "<i4")


def passages(sequences: Iterator[np.ndarray], idf: np.ndarray, most: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the passage matrix: word, passage (rising from 0) and TF-IDF value of its entries, rows of length one."""
    held: list[np.ndarray] = []
    size = row = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        word, of = key % len(idf), key // len(idf)
        value = n * idf[word]
        of = np.concatenate([[0], np.cumsum(np.diff(of) > 0)])
        return word, of, (value / np.sqrt(np.bincount(of, value * value))[of]).astype(np.float32)

    for ids in sequences:
        at = np.flatnonzero((ids >= 0) & (idf[ids] > 0))
        if len(at):
            held.append((row + at // PASSAGE) * np.int64(len(idf)) + ids[at])
            size += len(at)
            row += len(ids) // PASSAGE + 1
        if size >= most:
            yield made()
            held, size, row = [], 0, 0
    if held:
        yield made()


def summed(coded: DataFrame, shape: tuple[int, int], partial, name: str) -> np.ndarray:
    """The sum over all texts of the matrix that partial(sequences) gives for some, added up block by block of its rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(_sequences(batches, 0))
        if total is not None:
            for b in range(0, shape[0], BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([total[b : b + BLOCK].astype("<f8").tobytes()], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sums in runs(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(block[:1]), pa.array([np.sum([np.frombuffer(s, "<f8") for s in sums], axis=0).tobytes()], pa.binary())], names=["block", "sums"])

    parts = coded.select("ids").mapInArrow(local, "block long, sums binary")
    added = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, sums binary")
    out = np.zeros(shape)
    for r in added.collect():
        got = np.frombuffer(r.sums, "<f8").reshape(-1, shape[1])
        out[r.block : r.block + len(got)] = got
    return out


def inverse_frequencies(coded: DataFrame, n_words: int, items: list[Item]) -> np.ndarray:
    """log(texts / texts with the word); zero for words in more than COMMON of the texts, but for the RAREST words of each item."""

    def partial(sequences: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((n_words + 1, 1))
        for ids in sequences:
            own = np.unique(ids)
            out[own[own >= 0], 0] += 1
            out[n_words, 0] += 1
        return out

    counts = summed(coded, (n_words + 1, 1), partial, "frequencies")[:, 0]
    n = max(counts[-1], 1)
    idf = np.log((n + 1) / (counts[:-1] + 0.5))
    rare = counts[:-1] <= COMMON * n
    for i in items:
        own = np.unique(i.ids)
        rare[own[np.argsort(-idf[own], kind="stable")[:RAREST]]] = True
    return np.where(rare, np.maximum(idf, 1e-3), 0.0)


def in_blocks(items: list[Item]) -> Iterator[tuple[np.ndarray, list[Item]]]:
    """Blocks of items in their order: the words of each, rising, and its items with their words as places among these. Items of one item_id stay together."""
    held: list[Item] = []
    own: set[int] = set()

    def made() -> tuple[np.ndarray, list[Item]]:
        block, out = np.array(sorted(own)), []
        for i in held:
            out.append(copy.copy(i))
            out[-1].ids = np.searchsorted(block, i.ids).astype(np.int32)
        return block, out

    for i in items:
        more = own.union(i.ids.tolist())
        if held and held[-1].item_id != i.item_id and (len(held) >= BLOCK_ITEMS or len(more) > BLOCK_WORDS):
            yield made()
            held, own, more = [], set(), set(i.ids.tolist())
        held.append(i)
        own = more
    if held:
        yield made()


def places(block: np.ndarray, n_words: int) -> np.ndarray:
    """The place of each word in a block, -1 for others; the last entry is for -1 itself."""
    out = np.full(n_words + 1, -1, np.int32)
    out[block] = np.arange(len(block))
    return out


def latent_space(coded: DataFrame, items: list[Item], idf: np.ndarray, rank: int = RANK, seed: int = SEED, place: np.ndarray | None = None) -> np.ndarray:
    """The right singular vectors, word x rank, of the passage matrix with the items' rows, which weigh as much as all passages."""
    wide = min(rank + OVERSAMPLE, len(idf))
    start, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), wide)))
    start = start.astype(np.float32)

    def sketched(sequences: Iterator[np.ndarray], m: np.ndarray) -> np.ndarray:
        """A'(A m), and the number of passages in one more row."""
        out = np.zeros((len(idf) + 1, m.shape[1]))
        for word, of, value in passages(sequences, idf):
            y = np.add.reduceat(m[word] * value[:, None], np.flatnonzero(np.diff(of, prepend=-1)))
            order = np.argsort(word, kind="stable")
            heads = np.flatnonzero(np.diff(word[order], prepend=-1))
            out[word[order][heads]] += np.add.reduceat(y[of[order]] * value[order, None], heads)
            out[-1] += len(y)
        return out

    sent = coded.sparkSession.sparkContext.broadcast((start, place))

    def partial(sequences: Iterator[np.ndarray]) -> np.ndarray:
        m, at = sent.value
        return sketched(sequences if at is None else (at[ids] for ids in sequences), m)

    z = summed(coded, (len(idf) + 1, wide), partial, "sketch")
    ours = sketched((i.ids for i in items), start)
    z = z[:-1] + max(z[-1, 0], 1) / max(ours[-1, 0], 1) * ours[:-1]
    # A'A is near (A'A R)(R'A'A R)^-1 (A'A R)': its eigenvectors are the left singular vectors of the first factor times a root of the middle one.
    z += (shift := 1e-6 * max(np.linalg.norm(z), 1e-12)) * start
    middle = start.T.astype(float) @ z
    root = np.linalg.cholesky((middle + middle.T) / 2 + shift * 1e-3 * np.eye(wide))
    left, _, _ = np.linalg.svd(np.linalg.solve(root, z.T).T, full_matrices=False)
    return left[:, : min(rank, wide)].astype(np.float32)


class Searcher:
    """Finds and verifies the items in many texts at once."""

    def __init__(self, items: list[Item], idf: np.ndarray, basis: np.ndarray, cosine: float, share: float, answer_share: float):
        # A word that no item has counts as much in a window's length as an item's word does on average; padding counts nothing.
        other = np.mean(np.concatenate([idf[i.ids] ** 2 for i in items]))
        self.other, self.padding = len(idf), len(idf) + 1
        self.idf2, self.cosine, self.share, self.answer_share = np.concatenate([idf**2, [other, 0.0]]), cosine, share, answer_share
        vectors = basis * idf[:, None].astype(np.float32)
        self.useful = np.concatenate([idf > 0, [False, False]])
        self.classes: list[tuple[int, list[Item], np.ndarray, np.ndarray]] = []
        for stride in sorted({i.stride for i in items}):
            own = [i for i in items if i.stride == stride]
            q = np.stack([vectors[i.ids].sum(axis=0) for i in own])
            terms = [np.unique(i.ids, return_counts=True) for i in own]
            full = np.array([np.linalg.norm(n * idf[w]) for w, n in terms])
            kept = np.linalg.norm(q, axis=1)
            q /= (np.maximum(kept, 1e-9) * np.maximum(kept / full, LEAST_KEPT))[:, None]
            # A window's dot product with an item is the sum of its words'.
            table = np.maximum(vectors @ q.T.astype(np.float32), 0)
            for j, (w, n) in enumerate(terms):
                table[w, j] = np.maximum(table[w, j], n * idf[w] ** 2 / full[j])
            self.classes.append((stride, own, table, 2 * full))
        self.patterns = {id(i): (Pattern(i.ids), Pattern(i.ids[-i.answer :])) for i in items}

    def __call__(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, float, float]]:
        """Text number, item_id, nearness (the latent dot product by the window's length in words, at most 1), share of the item and share of its answer, for each item that a text holds."""
        if not texts:
            return []
        gap = 5 * max(c[0] for c in self.classes)
        sizes = np.array([len(t) for t in texts]) + gap
        starts = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), self.padding)
        for at, t in zip(starts.tolist(), texts, strict=True):
            flat[at : at + len(t)] = np.where(t < 0, self.other, t)
        found: dict[tuple[int, int], tuple[int, int, float, float, float]] = {}
        useful = np.flatnonzero(self.useful[flat])
        if not len(useful):
            return []
        length = self.idf2[flat]
        for stride, items, table, most in self.classes:
            n = -(-len(flat) // stride)
            size = np.sqrt(_fives(np.add.reduceat(length, np.arange(0, len(flat), stride)).reshape(n, 1)))
            heads = np.flatnonzero(np.diff(useful // stride, prepend=-1))
            chunk = np.zeros((n, table.shape[1]), np.float32)
            chunk[useful[heads] // stride] = np.add.reduceat(table[flat[useful]], heads)
            dots = _fives(chunk)
            # Heavy words around an item of light ones do not hide it.
            for w, j in zip(*(x.tolist() for x in np.nonzero((dots >= self.cosine * np.minimum(size, most)) & (size > 0))), strict=True):
                a, b = max(0, (w - 4) * stride), min((w + 1) * stride, len(flat))
                text = int(np.searchsorted(starts, b - 1, "right")) - 1
                self._verify(flat[a:b].tolist(), text, items[j], float(dots[w, j] / size[w, 0]), found)
        return list(found.values())

    def _verify(self, window: list[int], text: int, item: Item, cos: float, found: dict) -> None:
        whole, answer = self.patterns[id(item)]
        share = whole.common(window) / whole.n
        key = text, item.item_id
        if share < self.share or key in found and found[key][3] >= share:
            return
        answered = answer.common(window) / answer.n
        if share >= NEAR_ALL or answered >= self.answer_share:
            found[key] = text, item.item_id, min(cos, 1.0), share, answered


def _fives(x: np.ndarray) -> np.ndarray:
    """Sums of each row and the four before it."""
    out = x.copy()
    for k in range(1, 5):
        out[k:] += x[:-k]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = SHARE, answer_share: float = ANSWER_SHARE, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, nearness, share and answer_share, a row for each document (doc_id, text) and item (item_id, text) that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", T.LongType()), *(T.StructField(k, T.DoubleType()) for k in ("nearness", "share", "answer_share"))])
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    number: dict[str, int] = {}
    kept = []
    # Row by row, so that a table beyond the bound is refused before it fills the driver.
    for r in rows.toLocalIterator():
        for w in words(r.text):
            number.setdefault(w, len(number))
        if len(number) > MAX_VOCABULARY:
            raise ValueError(f"the benchmark has more than {MAX_VOCABULARY} words; split it")
        kept.append(r)
    rows = kept
    items = [Item(r.item_id, r.text, number) for r in rows if len(words(r.text)) >= LEAST_WORDS]
    if not items:
        return spark.createDataFrame([], schema)
    coded = cut(code(docs, number), "coded")
    idf = inverse_frequencies(coded, len(number), items)

    def searched(block: np.ndarray, own: list[Item]) -> DataFrame:
        place = places(block, len(number))
        sent = spark.sparkContext.broadcast((place, (own, idf[block], latent_space(coded, own, idf[block], rank, place=place))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, made = sent.value
            search = Searcher(*made, cosine, share, answer_share)
            for batch in batches:
                texts = [at[np.frombuffer(raw, "<i4")] for raw in batch.column(1).to_pylist()]
                ends = np.cumsum([len(t) for t in texts])
                s, out = 0, []
                while s < len(texts):
                    e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + SLICE_WORDS)))
                    out += [(s + got[0], *got[1:]) for got in search(texts[s:e])]
                    s = e
                cols = list(zip(*out, strict=True)) or [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=schema.names)

        return coded.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [searched(*b) for b in in_blocks(items)])


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that hold no item of the benchmark. Texts are judged, not ids, so null and repeated ids make no difference."""
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    found = leaks(docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.unhex(F.md5(docs["text"].cast("binary"))) == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
