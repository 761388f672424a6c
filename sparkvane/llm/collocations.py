"""Phrase collocation mining by count tries of limited depth.

A task (a shard) reads its texts in slices of about SLICE bytes and builds a count trie for each: a
node is a phrase of one to DEPTH words that stand together in a piece of a text, by language; its parent
is the phrase without its last word, its suffix link leads to the phrase without its first one. Tries
are kept as sorted arrays of nodes, (parent, word) by level, and written as sorted rows; a shuffle by
ranges of (language, phrase) merges the sorted runs of all shards and adds up their counts, so the
phrases of one frequent word spread over many ranges. Nodes seen MIN_COUNT times or more stay. Walking
down from its ancestors gives a phrase the counts of its left parts, following the suffix links those
of its right parts.

So that rare phrases need no nodes, a pass before counts words and pairs of words in hashed cells of
which each shard sends the counts: a cell's count is at least that of each word or pair in it, so what
is in a cell under MIN_COUNT can be left out, and longer phrases that hold such a pair with it. Which
cells are frequent is a table of 2^FILTER_BITS bits, whatever the input. This changes no result: counts
are of whole phrases, not of cells.

A null text is an empty one; a null lang is `und`. Copies of a text and repeated rows count each time.
An empty table gives no rows. Columns other than text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import splittable
from .shared import cut, mix64, parts_for, read, small_batches

DEPTH, MIN_COUNT, FIRST, WITHIN_PERCENT = 4, 30, 2000, 80
SLICE = 16 << 20
CELL_BITS, BLOCK_BITS, FILTER_BITS = 32, 24, 26

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts in order: `ids` into `words` (sorted by their bytes), the language of each (`langs`, into `names`) and whether it starts a piece (`first`)."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        joined = b"\n".join(pc.fill_null(texts.cast(pa.binary()), b"").to_pylist())
        data = _LOWER[np.frombuffer(joined, np.uint8)]
        kind = _KIND[data]
        inside = np.zeros(len(kind) + 2, bool)
        inside[1:-1] = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        stops = np.flatnonzero(kind == 2)
        self.first = np.ones(len(starts), bool)
        self.first[1:] = np.searchsorted(stops, starts[1:]) != np.searchsorted(stops, ends[:-1])

        # The words' bytes one after the other, as an Arrow array.
        held = data[kind == 0].tobytes()
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        order = pc.array_sort_indices(found.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = found.dictionary.take(pa.array(order))
        self.ids = rank[found.indices.to_numpy()]
        del data, kind, inside, edges, held, found

        own = pc.fill_null(langs, "und").dictionary_encode()
        self.names = own.dictionary.to_pylist()
        text_of = np.searchsorted(size[1:] + np.arange(len(size) - 1), starts, side="right")
        self.langs = own.indices.to_numpy()[text_of].astype(np.int64) if len(starts) else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        """A hash of each word (with its language's), for cells."""
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))
        langs = np.array([xxhash.xxh64_intdigest(n, 1) for n in self.names], np.uint64)
        return mix64(words[self.ids] ^ langs[self.langs]) if len(self.ids) else np.zeros(0, np.uint64)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def pairs(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one."""
    return mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) else hashes


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[Words]:
    """The words of about `limit` bytes of whole texts (text, lang) at a time."""
    held, size = [], 0
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        s = 0
        for k in range(len(batch)):
            size += int(length[k]) + 1
            if size >= limit:
                held.append(batch.slice(s, k + 1 - s))
                yield _words(held)
                held, size, s = [], 0, k + 1
        if s < len(batch):
            held.append(batch.slice(s))
    if held:
        yield _words(held)


def _words(held: list[pa.RecordBatch]) -> Words:
    table = pa.Table.from_batches(held).combine_chunks()
    return Words(*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns))


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, cells, counts): of each block of cells those that a slice has, with their counts up to MIN_COUNT, as bytes."""
    for w in slices(batches):
        h = w.hashes()
        at = np.concatenate([cell(h), cell(pairs(h)[~w.first[1:]])]) if len(h) else np.zeros(0, np.int64)
        cells, counts = np.unique(at, return_counts=True)
        counts = np.minimum(counts, MIN_COUNT).astype(np.uint8)
        edges = np.searchsorted(cells, np.arange((1 << (CELL_BITS - BLOCK_BITS)) + 1) << BLOCK_BITS)
        low = (cells & ((1 << BLOCK_BITS) - 1)).astype("<u4")
        full = [b for b in range(len(edges) - 1) if edges[b] < edges[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([low[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()), pa.array([counts[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())], names=["block", "cells", "counts"])


def _frequent_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bits) of rows that are sorted by block."""
    now, counts = None, None

    def done():
        bits = (counts >= MIN_COUNT).reshape(-1, 1 << (CELL_BITS - FILTER_BITS)).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for block, cells, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                if now is not None:
                    yield done()
                now, counts = block, np.zeros(1 << BLOCK_BITS, np.uint8)
            at = np.frombuffer(cells, "<u4")
            counts[at] = np.minimum(counts[at] + np.frombuffer(seen, np.uint8), MIN_COUNT)
    if now is not None:
        yield done()


def frequent(docs: DataFrame) -> np.ndarray:
    """One bit for each 2^(CELL_BITS - FILTER_BITS) cells: whether any of them counts MIN_COUNT words or pairs."""
    counted = docs.select("text", "lang").mapInArrow(_count_cells, "block int, cells binary, counts binary")
    counted = counted.repartition(parts_for(docs.sparkSession), "block").sortWithinPartitions("block")
    each = 1 << (BLOCK_BITS - (CELL_BITS - FILTER_BITS) - 3)
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in counted.mapInArrow(_frequent_cells, "block int, bits binary").toLocalIterator():
        out[r.block * each : (r.block + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return out


def trie(w: Words, admitted: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """The levels of the count trie of some words: language and words of each node (in sorted order), and its count.

    A node is (parent, word) with the parent a node of the level above; words and pairs in cells that
    are not `admitted` have none, and a longer phrase has one only where each pair of it has.
    """

    def frequent_(hashes: np.ndarray) -> np.ndarray:
        at = cell(hashes) >> (CELL_BITS - FILTER_BITS)
        return admitted[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1

    n, width = len(w.ids), np.int64(max(1, len(w.words)))
    if not n:
        return
    h = w.hashes()
    ok = frequent_(h)
    goes_on = np.zeros(n, bool)  # whether the pair that starts here may be a part of longer phrases
    goes_on[:-1] = ~w.first[1:] & ok[:-1] & ok[1:] & frequent_(pairs(h))
    at = np.flatnonzero(ok)
    node, langs, words = None, None, []
    for level in range(depth):
        if level:
            keep = goes_on[at + level - 1]
            at, node = at[keep], node[keep]
        key = (w.langs[at] if not level else node) * width + w.ids[at + level]
        keys, node, counts = np.unique(key, return_inverse=True, return_counts=True)
        parents, last = keys // width, keys % width
        langs = parents if not level else langs[parents]
        words = [x[parents] for x in words] + [last]
        yield langs, words, counts


def _tries(sent: Broadcast) -> Callable:
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admitted = np.frombuffer(sent.value, np.uint8)
        for w in slices(batches):
            names = pa.array(w.names, pa.string())
            roots = np.bincount(w.langs, minlength=len(w.names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(names)), pa.array(np.zeros(len(names), np.int32)), pa.array(roots)], names=["lang", "phrase", "depth", "f"])
            for langs, words, counts in trie(w, admitted):
                for s in range(0, len(counts), 200_000):
                    own = [w.words.take(pa.array(x[s : s + 200_000])) for x in words]
                    text = pc.binary_join_element_wise(*own, pa.scalar(b" ", pa.large_binary())) if len(own) > 1 else own[0]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(langs[s : s + 200_000])), text.cast(pa.binary()).cast(pa.string()), pa.array(np.full(len(text), len(words), np.int32)), pa.array(counts[s : s + 200_000].astype(np.int64))], names=["lang", "phrase", "depth", "f"])

    return local


def without_last(phrase: Column) -> Column:
    return F.regexp_replace(phrase, " [^ ]*$", "")


def without_first(phrase: Column) -> Column:
    return F.regexp_replace(phrase, "^[^ ]* ", "")


def phrases(docs: DataFrame) -> DataFrame:
    """(lang, phrase, depth, f): the merged trie's nodes of MIN_COUNT occurrences or more, for docs (text, lang); the roots (depth 0) count all words."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(frequent(docs).tobytes())
    tries = cut(docs.select("text", "lang").mapInArrow(_tries(sent), "lang string, phrase string, depth int, f long"), "tries")
    merged = tries.repartitionByRange(parts_for(spark), "lang", "phrase").sortWithinPartitions("lang", "phrase")
    merged = merged.groupBy("lang", "phrase").agg(F.first("depth").alias("depth"), F.sum("f").alias("f")).where((F.col("f") >= MIN_COUNT) | (F.col("depth") == 0))
    return cut(merged, "phrases")


def candidates(nodes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of two words or more that no longer one makes up for.

    lefts and rights are the counts of a phrase's parts before and after each cut, by the cut's place:
    a node has its parent's lefts and then its parent's count; its suffix link's count and then its rights.
    """
    empty = F.expr("CAST(array() AS array<bigint>)")
    level = nodes.where("depth = 1").select("lang", "phrase", "f", empty.alias("lefts"), empty.alias("rights"))
    out = None
    for depth in range(2, DEPTH + 1):
        own = nodes.where(F.col("depth") == depth).select("lang", "phrase", "f", without_last(F.col("phrase")).alias("parent"), without_first(F.col("phrase")).alias("suffix"))
        up = level.select(F.struct("lang", "phrase").alias("_up"), F.concat("lefts", F.array("f")).alias("lefts"))
        link = level.select(F.struct("lang", "phrase").alias("_link"), F.concat(F.array("f"), "rights").alias("rights"))
        walked = splittable(own.withColumn("_up", F.struct("lang", F.col("parent").alias("phrase"))), up, "_up").drop("_up")
        walked = splittable(walked.withColumn("_link", F.struct("lang", F.col("suffix").alias("phrase"))), link, "_link").drop("_link")
        level = cut(walked, f"level-{depth}")
        out = level if out is None else out.unionByName(level)
    # Parts are at least as frequent as the whole, so a longer phrase that makes up for one has one between them that does.
    longer = out.select("lang", F.explode(F.array("parent", "suffix")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = out.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(19,0)") < F.lit(WITHIN_PERCENT).cast("decimal(3,0)") * F.col("f").cast("decimal(19,0)")))

    def parts(l: Column, r: Column) -> Column:
        whole = F.col("f").cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)")
        return F.struct(F.call_function("div", whole, l.cast("decimal(19,0)") + r.cast("decimal(19,0)")).alias("score"), l.alias("l"), r.alias("r"))

    scored = F.zip_with("lefts", "rights", parts)
    worst = F.aggregate(scored, F.get(scored, F.lit(0)), lambda x, y: F.when(y["score"] < x["score"], y).otherwise(x))
    return kept.withColumn("_w", worst).select("lang", "phrase", F.col("f").alias("a"), "_w.l", "_w.r", "_w.score")


def collocations(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best phrases of each language of docs (text, lang)."""
    nodes = phrases(docs)
    n = nodes.where("depth = 0").select("lang", F.col("f").alias("n"))
    # Spark keeps the first rows of each task before it brings those of a language together.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = candidates(nodes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def _sql() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k} + 2)]) AS phrase FROM pieces" for k in range(1, DEPTH + 1))
    return f"""WITH pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
split AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM split),
scored AS (SELECT s.lang, s.phrase, s.a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM cuts s
  JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(w[:c], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(w[c + 1:], ' ')),
worst AS (SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), score * 10 + c) AS x FROM scored GROUP BY ALL),
parts AS (SELECT lang, a AS longer, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase FROM split),
within AS (SELECT lang, phrase, max(longer) AS longer FROM parts GROUP BY ALL),
ranked AS (SELECT worst.*, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, phrase) AS rank FROM worst LEFT JOIN within USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < {WITHIN_PERCENT}::HUGEINT * a)
SELECT lang, rank, phrase, a, x.l AS l, x.r AS r, n, x.score AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {FIRST}"""


SQL = _sql()
