"""Filter interaction audit: what each of five filters removes in every order of them, by part of the corpus.

The filters judge whole texts. FAILS tells when a text fails A to D; E fails a text that is identical to
that of any smaller doc_id, removed or not. For E the rows are range-sorted by fingerprints of the text
(a fast one and SHA-256), the text and doc_id, so that copies stand together, however many there are: a
task compares each row with its predecessor and hands on its first and last run of equal texts, by
which the runs that cross a boundary are put together. Ranges are drawn by fingerprints and doc_id
alone, so that no texts come to the driver with the sample that the bounds are chosen from. A document then is a mask of the filters it fails, and all figures are
sums over (part, mask) cells, 32 a part at most: in an order of filters a document goes at the first
step whose filter it fails.

Null texts are empty ones; they are copies of each other. A null doc_id is neither smaller nor larger
than another, so such rows neither fail E nor make others fail it; rows of one doc_id are no copies of
each other, but each counts. Null langs are the part ''. Words are maximal runs of characters other
than space and \\t to \\r. A document is good or toxic if any of its `labels` rows says so; documents
without labels are neither. An empty table gives no rows. Columns other than doc_id, text and lang are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, parts_for, read, small_batches

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 200, 50, 3, "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_ROWS = "doc_id long, part string, mask int, range int, open boolean, run binary, first long, ends int"


def fails(text: Column) -> list[Column]:
    """Whether a text that is not null fails A, B, C and D."""
    words = F.regexp_extract_all(text, F.lit("[^ \\t-\\r]+"), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * F.length(text), text.rlike(MARKS)]


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fingerprint, text, doc_id, part, mask) without their texts; the mask has E's bit.

    Rows of the task's first run are `open`, as it may go on from the task before. The rows with `ends`
    are no documents: 1 has the first run and 2 the last one, by a hash of the text and the first doc_id.
    """
    import hashlib

    at = TaskContext.get().partitionId()
    e = 1 << FILTERS.index("E")
    last: tuple | None = None  # fingerprint and text of the row before
    first = None  # first doc_id of the present run
    opened, first_run = True, None

    def made(doc, part, mask, open_, run=None, start=None, ends=0):
        n = len(doc)
        return pa.RecordBatch.from_arrays([doc, part, pa.array(mask, pa.int32()), pa.array(np.full(n, at, np.int32)), pa.array(open_, pa.bool_()), pa.array([run] * n, pa.binary()), pa.array([start] * n, pa.int64()), pa.array(np.full(n, ends, np.int32))], names=[c.split()[0] for c in _ROWS.split(", ")])

    def end(kind: int, text: str, start: int | None):
        return made(pa.array([None], pa.int64()), pa.array([None], pa.string()), [0], [False], hashlib.sha256(text.encode()).digest(), start, kind)

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        key, text, doc, part, mask = batch.columns
        differs = np.ones(n, bool)
        if n > 1:
            unlike = pc.not_equal(key.slice(1), key.slice(0, n - 1))
            differs[1:] = pc.or_(unlike, pc.not_equal(text.slice(1), text.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        differs[0] = last is None or key[0].as_py() != last[0] or text[0].as_py() != last[1]
        ids, known = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False)
        masks, open_ = mask.to_numpy(zero_copy_only=False).copy(), np.zeros(n, bool)
        starts = np.flatnonzero(differs).tolist()
        for s, t in zip([0, *starts] if not differs[0] else starts, [*starts, n] if not differs[0] else [*starts[1:], n], strict=True):
            if differs[s]:
                if last is not None and opened:
                    opened, first_run = False, (last[1] if s == 0 else text[s - 1].as_py(), first)
                elif s and opened:
                    opened, first_run = False, (text[s - 1].as_py(), first)
                first = None
            if first is None and known[s:t].any():
                first = int(ids[s + int(np.argmax(known[s:t]))])
            if first is not None:
                masks[s:t] += e * (known[s:t] & (ids[s:t] > first))
            open_[s:t] = opened
        last = key[n - 1].as_py(), text[n - 1].as_py()
        yield made(doc, part, masks, open_)
    if last is not None:
        yield end(1, *(first_run or (last[1], first)))
        yield end(2, last[1], first)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit k: the document fails FILTERS[k]) for every row of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    ranged = rows.repartitionByRange(parts_for(spark), "key", "sha", "doc_id").sortWithinPartitions("key", "sha", "text", "doc_id")
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails(F.col("text")))), F.lit(0))
    found = cut(ranged.select("key", "text", "doc_id", "part", mask.cast("int").alias("mask")).mapInArrow(_copies, _ROWS), "copies")

    # Two rows a partition tell which first runs go on from the partition before, and since which doc_id.
    ends: dict[int, dict] = {}
    for r in found.where("ends > 0").select("range", "ends", "run", "first").collect():
        ends.setdefault(r["range"], {})[r.ends] = (bytes(r["run"]), r["first"])
    before, since = (None, None), []
    for at in sorted(ends):
        (head, start), tail = ends[at][1], ends[at][2]
        if before[0] == head and before[1] is not None:
            since.append((at, before[1]))
            start = before[1]
        # One run may fill a partition and be the last one, too.
        before = (head, start) if tail[0] == head else tail
    since = F.broadcast(spark.createDataFrame(since, "range int, since long"))
    e = 1 << FILTERS.index("E")
    joined = found.where("ends = 0").join(since, "range", "left")
    again = F.col("open") & (F.col("doc_id") > F.col("since"))
    return joined.select("doc_id", "part", F.when(again, F.col("mask").bitwiseOR(F.lit(e))).otherwise(F.col("mask")).alias("mask"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those that labels (doc_id, quality, toxic) call good and toxic."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    # Rows without an id have no labels, and would all meet in one task.
    known = marked.where("doc_id is not null").join(said, "doc_id", "left").select("part", "mask", "good", "toxic")
    rows = known.unionByName(marked.where("doc_id is null").select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic")))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(counted: DataFrame, orders: list[str] | None = None) -> DataFrame:
    """A row for each part, order of filters and step, from cells(); shapley sums over all orders whatever `orders` is."""
    orders = orders or ORDERS
    spark = counted.sparkSession
    counted = cut(counted, "cells")
    steps = []
    for order, mask in product(orders, range(1 << len(FILTERS))):
        gone = 0
        for k, f in enumerate(order):
            own = 1 << FILTERS.index(f)
            # Of all orders, a document that fails f and others goes by f in those that have f first among them.
            among = len(ORDERS) // mask.bit_count() if mask & own else 0
            steps.append((mask, order, k + 1, bool(mask & own), bool(mask & gone), mask == own, among))
            gone |= own
    # A constant table, five rows an order and mask: what each step of each order makes of a mask.
    table = F.broadcast(spark.createDataFrame(steps, "mask int, filter_order string, step int, fails_own boolean, gone boolean, alone boolean, among int"))
    met = counted.join(table, "mask")
    fails_own, gone = F.col("fails_own"), F.col("gone")
    here = fails_own & ~gone

    def total(what: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    return met.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails_own & ~gone).alias("kept"),
        total("n", here).alias("removed"),
        total("n", fails_own & gone).alias("redundant"),
        total("n", F.col("alone")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.sum(F.col("n") * F.col("among")).cast("long").alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(masks(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")))


def _sql() -> str:
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    return f"""WITH rows AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^ \\t-\\r]+') AS w FROM rows),
said AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
marked AS (SELECT doc_id, part, (len(w) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(t))::INT + 8 * regexp_matches(t, '{MARKS}')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM words),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM marked LEFT JOIN said USING (doc_id) GROUP BY ALL),
letter(f, b) AS (VALUES {letters}),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = {len(FILTERS)}),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier FROM orders, range(1, {len(FILTERS) + 1}) AS r(s)),
met AS MATERIALIZED (SELECT *, mask & own <> 0 AS fails_own, mask & earlier <> 0 AS gone FROM cells, steps),
worth AS (SELECT part, own, sum(n) FILTER (fails_own AND NOT gone) AS shapley FROM met GROUP BY ALL)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails_own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails_own AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails_own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails_own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails_own AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(any_value(shapley), 0)::BIGINT AS shapley
FROM met JOIN worth USING (part, own) GROUP BY part, filter_order, step"""


SQL = _sql()
