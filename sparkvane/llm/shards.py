"""Sharding by a minimax contiguous partition, in DataFrame operations alone.

Equal texts are one group that is never parted. Groups stand in the order of their smallest doc_id, and
a shard takes a contiguous stretch of them. The capacity is the smallest that `shards` shards can keep to:
it is binary-searched, each try checked greedily (a shard takes groups as long as they fit). The cuts are
then made under that capacity: each shard takes its share of what is left, but so much that the later
ones can hold the rest, so that shards stay near equal even where one huge group sets the capacity.

The check needs the running sums of sizes at few places only. They are read in cells: first, last and
number of sums in each of at most CELLS cells of equal width come to the driver, which then knows what
a greedy check gives at most and at least; where that leaves it open, the cells concerned are read
again in finer ones, down to single sums. So a search takes a few scans of one number a group, and the
driver holds a bounded table whatever the number of documents.

A size is a text's UTF-8 bytes plus OVERHEAD; a null text is an empty one. Within a shard slots go by
doc_id (nulls first), then by text. A null doc_id comes first in the order too. Rows that repeat a
doc_id are rows of their own. An empty table gives no rows. Columns other than those asked for in
`keep` are ignored, whatever their names. Fewer groups than shards leave shards empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import splittable
from .shared import cut, parts_for, read

SHARDS, OVERHEAD, CELLS = 24, 8, 1 << 16


class Ends:
    """What is known of the ends of groups (running sums of their sizes): stretches (first, last, number of ends, width) in order."""

    def __init__(self, ends: DataFrame, total: int, cells: int = CELLS):
        self.ends, self.cells, self.jobs = ends, cells, 0
        self.known = self._read(max(0, total.bit_length() - (cells.bit_length() - 1)), None)
        self.firsts = [k[0] for k in self.known]

    def _read(self, shift: int, inside: tuple[int, list[int]] | None) -> list[tuple]:
        rows = self.ends
        if inside is not None:
            wide, ids = inside
            wanted = rows.sparkSession.createDataFrame([(i,) for i in ids], "cell long")
            rows = rows.join(F.broadcast(wanted), F.shiftright("end", wide) == F.col("cell"), "left_semi")
        self.jobs += 1
        got = rows.groupBy(F.shiftright("end", shift).alias("cell")).agg(F.min("end"), F.max("end"), F.count("*")).collect()
        return sorted((r[1], r[2], r[3], shift) for r in got)

    def floor(self, x: int) -> tuple[int, int, int | None]:
        """The last end up to x (0 if none) at least and at most, and the stretch to look into if that differs."""
        k = bisect_right(self.firsts, x) - 1
        if k < 0:
            return 0, 0, None
        first, last, n, _ = self.known[k]
        if x >= last:
            return last, last, None
        return (first, first, None) if n <= 2 else (first, x, k)

    def ceil(self, x: int) -> tuple[int, int, int | None]:
        """The first end from x on (0 counts as one) at least and at most, and the stretch to look into."""
        if x <= 0:
            return 0, 0, None
        k = bisect_left(self.firsts, x)
        if k:
            first, last, n, _ = self.known[k - 1]
            if x <= last:
                return (last, last, None) if n <= 2 else (x, last, k - 1)
        return self.firsts[k], self.firsts[k], None

    def between(self, low: int, high: int) -> set[int]:
        """The stretches with open ends that reach into [low, high]."""
        k = max(0, bisect_right(self.firsts, low) - 1)
        return {i for i in range(k, bisect_right(self.firsts, high)) if self.known[i][2] > 2 and self.known[i][1] >= low}

    def refine(self, stretches: set[int]) -> None:
        """Read so many stretches again in cells so fine that all of them together stay under the bound."""
        finer = max(1, (self.cells // len(stretches)).bit_length() - 1)
        kept, by_width = [], {}
        for k, one in enumerate(self.known):
            by_width.setdefault(one[3], []).append(one[0] >> one[3]) if k in stretches else kept.append(one)
        for shift, ids in by_width.items():
            kept += self._read(max(0, shift - finer), (shift, ids))
        self.known = sorted(kept)
        self.firsts = [k[0] for k in self.known]


def capacity(ends: Ends, total: int, largest: int, shards: int) -> int:
    """The smallest capacity by which greedy filling needs no more than `shards` shards."""

    def reach(c: int, side: int) -> list[int]:
        at = [0]
        for _ in range(shards):
            at.append(ends.floor(at[-1] + c)[side])
        return at

    def smallest(low: int, high: int, side: int) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if reach(mid, side)[-1] >= total else (mid + 1, high)
        return low

    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while True:
        high = smallest(low, high, 0)  # certainly enough
        low = smallest(low, high, 1)  # anything less is certainly not
        if low == high:
            return high
        ends.refine(set().union(*(ends.between(a, b) for a, b in zip(reach(low, 0), reach(high, 1), strict=True))))


def cuts(ends: Ends, total: int, most: int, shards: int) -> list[int]:
    """The ends of all shards but the last, under the capacity `most`."""
    while True:
        unsure, rest = set(), [total]
        for _ in range(shards - 1):
            # The earliest end from which so many shards can hold all that follows.
            _, at, open_ = ends.ceil(rest[-1] - most)
            rest.append(at)
            unsure.add(open_)
        out = [0]
        for left in range(shards - 1, 0, -1):
            share = out[-1] + (total - out[-1]) // (left + 1)
            at, _, open_ = ends.floor(min(out[-1] + most, max(share, rest[left])))
            out.append(at)
            unsure.add(open_)
        unsure.discard(None)
        if not unsure:
            return out[1:]
        ends.refine(unsure)


def group_ends(rows: DataFrame) -> DataFrame:
    """(group, first, bytes, end) for rows (group, doc_id, size): running sums by ranges of the order, whose totals are added on."""
    spark = rows.sparkSession
    groups = rows.groupBy("group").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    ranged = cut(groups.repartitionByRange(parts_for(spark), "first", "group").withColumn("range", F.spark_partition_id()), "groups")
    before, offsets = 0, []
    for r in ranged.groupBy("range").agg(F.sum("bytes").alias("bytes")).orderBy("range").collect():  # a row a partition
        offsets.append((r["range"], before))
        before += r.bytes
    own = F.sum("bytes").over(Window.partitionBy("range").orderBy("first", "group").rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("own", own).join(F.broadcast(spark.createDataFrame(offsets, "range int, before long")), "range")
    return cut(summed.select("group", "bytes", (F.col("own") + F.col("before")).alias("end")), "ends")


def assign(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = (), cells: int = CELLS) -> DataFrame:
    """doc_id, size, shard, slot and the columns of `keep` for every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"), F.struct(*keep).alias("_kept") if keep else F.lit(0).alias("_kept"))
    ends = group_ends(rows.select("group", "doc_id", "size"))
    total, largest = ends.agg(F.max("end"), F.max("bytes")).first()
    found: list[int] = []
    if total:
        known = Ends(ends.select("end"), total, cells)
        found = cuts(known, total, capacity(known, total, largest, shards), shards)
    shard = F.lit(0)
    for c in found:
        shard = shard + (F.col("end") > c).cast("int")
    # A group may hold a third of all rows: its rows may be dealt to several tasks.
    placed = splittable(rows, ends.select("group", shard.alias("shard")), "group")
    order = ["shard", "doc_id", "group"]
    numbered = placed.repartitionByRange(parts_for(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered = cut(numbered.select("doc_id", "size", "shard", "_kept", F.shiftright("_id", 33).cast("int").alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")), "numbered")
    before: dict[int, int] = {}
    starts = []
    for r in numbered.groupBy("_range", "shard").agg(F.min("_at").alias("a"), F.count("*").alias("n")).orderBy("_range", "shard").collect():  # a row a partition and shard in it
        starts.append((r["_range"], r.shard, before.get(r.shard, 0) - r.a))
        before[r.shard] = before.get(r.shard, 0) + r.n
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "_range int, shard int, _add long"))
    slotted = numbered.join(starts, ["_range", "shard"]).withColumn("slot", F.col("_at") + F.col("_add"))
    return slotted.select("doc_id", "size", "shard", "slot", *([F.col(f"_kept.{c}").alias(c) for c in keep]))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Write doc_id and text of each document to folder/shard=<k>, in the order of slots within each file; returns what is read back."""
    rows = assign(docs.select("doc_id", "text"), shards, ("text",))
    rows.repartitionByRange(parts_for(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    done = assign(docs, keep=("text_crc32",))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _crc32_sql(text: str) -> str:
    """CRC-32, half a byte at a time (the low half first), over the bytes of a text in hexadecimal."""
    table = "[list_reduce([i, 0, 0, 0, 0]::BIGINT[], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR i IN range(16)]"
    halves = "[strpos('0123456789ABCDEF', h[k + 1 - 2 * (k % 2) + 1]) - 1 FOR k IN range(len(h))]"
    step = "xor(c // 16, t[xor(c % 16, b) + 1])"
    return f"(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, n), lambda c, b: {step}), 4294967295::BIGINT) FROM (SELECT {halves}::BIGINT[] AS n, {table} AS t FROM (SELECT hex(encode({text})) AS h)))"


def _sql() -> str:
    parts = [
        f"rows AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + {OVERHEAD} AS size FROM documents)",
        "groups AS (SELECT t, min(doc_id) AS first, sum(size)::BIGINT AS bytes FROM rows GROUP BY t)",
        "ends AS MATERIALIZED (SELECT t, bytes, (sum(bytes) OVER (ORDER BY first NULLS FIRST, unhex(sha256(t)) ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM groups)",
        "g AS MATERIALIZED (SELECT list(e ORDER BY e) AS l, max(e) AS total, max(bytes) AS largest FROM ends)",
        f"""search AS (SELECT greatest(largest, (total + {SHARDS - 1}) // {SHARDS}) - 1 AS low, (total + {SHARDS - 1}) // {SHARDS} + largest AS high FROM g
  UNION ALL SELECT CASE WHEN enough THEN low ELSE mid END, CASE WHEN enough THEN mid ELSE high END FROM
  (SELECT low, high, (low + high) // 2 AS mid, list_reduce(list_resize([0::BIGINT], {SHARDS + 1}, 0::BIGINT), lambda p, _: coalesce(list_max(list_filter(l, lambda e: e <= p + (low + high) // 2)), 0)) >= total AS enough FROM search, g WHERE high - low > 1))""",
        "r0 AS MATERIALIZED (SELECT l, total, (SELECT min(high) FROM search) AS most, total AS back, [total] AS rest FROM g)",
    ]
    for k in range(1, SHARDS):
        parts.append(f"r{k} AS MATERIALIZED (SELECT l, total, most, b AS back, list_append(rest, b) AS rest FROM (SELECT *, CASE WHEN back - most <= 0 THEN 0 ELSE list_min(list_filter(l, lambda e: e >= back - most)) END AS b FROM r{k - 1}))")
    parts.append(f"f0 AS MATERIALIZED (SELECT l, total, most, rest, 0::BIGINT AS pos, []::BIGINT[] AS made FROM r{SHARDS - 1})")
    for k in range(1, SHARDS):
        left = SHARDS - k
        parts.append(f"f{k} AS MATERIALIZED (SELECT l, total, most, rest, n AS pos, list_append(made, n) AS made FROM (SELECT *, coalesce(list_max(list_filter(l, lambda e: e <= least(pos + most, greatest(pos + (total - pos) // {left + 1}, rest[{left + 1}])))), 0) AS n FROM f{k - 1}))")
    parts.append(f"placed AS (SELECT doc_id, size, t, (SELECT len(list_filter(made, lambda c: c < e)) FROM f{SHARDS - 1})::INTEGER AS shard FROM rows JOIN ends USING (t))")
    return "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT doc_id, size::BIGINT AS size, {_crc32_sql("t")} AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, unhex(sha256(t))) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM placed"""


SQL = _sql()
