"""Removal of repeated 400-byte strings, exactly, over all documents.

Every 400-byte window is filed under its minimiser: the least-hashed 32-byte string in it. Equal
windows have the same minimiser at the same place, so windows of one minimiser that are neighbours
in a document form one run, and only runs filed under the same string are compared:

* runs with the same bytes repeat as wholes, whatever their number, and are compared as one;
* the others are sorted by two-stage suffix sorting: only suffixes not greater than their successor
  are sorted directly, the rest are induced from them by scans of the buckets, and windows whose
  common prefix with a neighbour reaches 400 bytes repeat;
* minimisers with more than HOT different runs (a passage in very many contexts) would not fit one
  task; their windows are counted by two 64-bit hashes instead, with partial sums before the shuffle.

Runs are told equal by a 64-bit hash of their bytes beside that of their minimiser, and texts by md5,
so results are exact up to collisions of these.

Null texts are empty; texts shorter than 400 bytes lose nothing and take no part. Documents of equal text get equal
results, so rows that repeat a doc_id, and a null doc_id, need no rule. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import runs, splittable
from .shared import cut, mix64, read, sliced, small_batches

LENGTH, GRAM, HOT, SORT_BYTES, STRIDE = 400, 32, 2000, 400_000, 1 << 22
_POS = np.uint64((1 << 23) - 1)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number."""
    n = len(raw) - 7
    out = np.empty(max(n, 0), np.uint64)
    for k in range(min(8, n)):
        out[k::8] = raw[k : k + (n - k + 7) // 8 * 8].view("<u8")
    return out


def minimisers(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one minimiser: its first window, its number of windows, its minimiser's hash."""
    v = eights(raw)
    n = len(raw) - gram + 1
    h = v[:n] * _C[0]
    for k in range(1, gram // 8):
        h += mix64(v[8 * k : 8 * k + n] + _C[k]) * (_C[k] | np.uint64(1))
    h = mix64(h)
    key = (h & ~_POS) | np.arange(n, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.diff(np.append(first, len(key))), h[(key[first] & _POS).astype(np.int64)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for part, texts in sliced(batches, 1):
        out: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
            data = text.encode() if text else b""
            if len(data) < LENGTH:
                continue
            tkey, view = hashlib.md5(data).digest(), memoryview(data)
            for base in range(0, len(data) - LENGTH + 1, STRIDE):
                raw = np.frombuffer(data, np.uint8, min(len(data) - base, STRIDE + LENGTH - 1), base)
                s, n, key = minimisers(raw)
                s = s + base
                out[0].append(key.view(np.int64))
                out[1] += [digest(view[a : a + m + LENGTH - 1], a_) for a, m, a_ in zip(s.tolist(), n.tolist(), n.tolist(), strict=True)]
                out[2] += [tkey] * len(s)
                out[3] += [doc] * len(s)
                out[4].append(s)
                out[5].append(n)
        if out[2]:
            cols = [pa.array(np.concatenate(out[0])), pa.array(np.array(out[1], np.uint64).view(np.int64)), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64()), pa.array(np.concatenate(out[4])), pa.array(np.concatenate(out[5]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "seg", "tkey", "doc", "s", "n"])


def two_stage(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places starts[k] <= i < ends[k] of all k, in the order of the strings of LENGTH bytes there.

    Each range ends LENGTH - 1 bytes before its segment does, so every such string lies in its segment.
    """
    raw = np.frombuffer(data, np.uint8).astype(np.int16)
    down = np.zeros(len(raw), bool)
    down[:-1] = raw[:-1] > raw[1:]
    owned = np.zeros(len(raw) + 1, np.int8)
    np.add.at(owned, starts, 1)
    np.add.at(owned, ends, -1)
    owned = np.cumsum(owned)[:-1].astype(bool)
    # A falling suffix is induced from its successor; so ranges are prolonged to a place that does not fall.
    wanted, edge = owned.copy(), ends.copy()
    while len(edge := edge[down[edge - 1]]):
        wanted[edge] = True
        edge = edge + 1
    direct = np.flatnonzero(wanted & ~down)
    strings = [data[p : p + LENGTH] for p in direct.tolist()]
    direct = direct[np.array(sorted(range(len(direct)), key=strings.__getitem__), np.int64)] if len(direct) else direct
    del strings
    firsts = raw[direct]
    bounds = np.searchsorted(firsts, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        bucket = np.concatenate([*induced[c], direct[bounds[c] : bounds[c + 1]]]) if induced[c] or bounds[c] < bounds[c + 1] else None
        if bucket is None:
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[wanted[before] & down[before]]
        heads = raw[before]
        at = np.argsort(heads, kind="stable")
        before, heads = before[at], heads[at]
        for h, s, e in zip(*_spans(heads), strict=True):
            induced[h].append(before[s:e])
    full = np.concatenate(order) if order else np.zeros(0, np.int64)
    return full[owned[full]]


def _spans(sorted_values: np.ndarray) -> tuple[list, list, list]:
    if not len(sorted_values):
        return [], [], []
    s = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[s].tolist(), s.tolist(), [*s[1:].tolist(), len(sorted_values)]


def repeated(segments: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each segment, which of its first counts[k] windows occur again among them all."""
    data = b"".join(segments)
    starts = np.cumsum([0] + [len(s) for s in segments[:-1]])
    order = two_stage(data, starts, starts + np.array(counts))
    view = memoryview(data)
    places = order.tolist()
    same = np.fromiter((view[a : a + LENGTH] == view[b : b + LENGTH] for a, b in zip(places, places[1:], strict=False)), bool, max(len(places) - 1, 0))
    flag = np.zeros(len(data), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return [flag[s : s + n] for s, n in zip(starts.tolist(), counts, strict=True)]


def stretches(flags: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the stretches of true flags."""
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).tolist()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "key long, seg long, a int, b int"


def _found(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "seg", "a", "b"])


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, n, bytes), one key's rows together, to the stretches of repeated windows."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        flags = repeated([h[3] for h in held], [h[2] for h in held])
        out = []
        for (key, seg, _, _), f in zip(held, flags, strict=True):
            cuts = stretches(f)
            out += [(key, seg, a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        return _found(out)

    for key, seg, n, raw in runs(batches, 1):
        held += zip(key.tolist(), seg.tolist(), n.tolist(), raw, strict=True)
        size += int(n.sum())
        if size >= SORT_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, [(key, seg, s, n, hot)]) to (key, seg, n, hot, bytes)."""
    for part, texts in sliced(batches, 0, 200_000):
        out = []
        for text, wanted in zip(texts, part.column(1).to_pylist(), strict=True):
            data = text.encode()
            out += [(w["key"], w["seg"], w["n"], w["hot"], data[w["s"] : w["s"] + w["n"] + LENGTH - 1]) for w in wanted]
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["key", "seg", "n", "hot", "bytes"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, n, bytes) to a row with the hashes of each window."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for key, seg, n, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            view = memoryview(raw)
            h = np.frombuffer(b"".join(digest(view[k : k + LENGTH]) for k in range(n)), np.int64).reshape(n, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, seg)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["key", "seg", "a", "h1", "h2"])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, window stretches) to the removed spans and the bytes that are left."""
    for part, texts in sliced(batches, 1):
        all_spans, kept = [], []
        for text, found in zip(texts, part.column(2).to_pylist(), strict=True):
            data = text.encode() if text else b""
            spans, end = [], -1
            for a, b in sorted((f["a"], f["b"]) for f in found or ()):
                if a <= end:
                    spans[-1]["end"] = end = max(end, b + LENGTH - 1)
                else:
                    end = b + LENGTH - 1
                    spans.append({"start": a, "end": end})
            edges = [0, *(x for s in spans for x in s.values()), len(data)]
            all_spans.append(spans)
            kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(all_spans, _SPANS), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])


def repeated_windows(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """tkey (md5 of a text) and the stretches [a, b) of its windows that occur again, for texts that have any."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text")
    rows = cut(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_runs, "key long, seg long, tkey binary, doc long, s long, n int"), "runs")
    alike = rows.groupBy("key", "seg").agg(F.count("*").alias("c"), F.min(F.struct("doc", "tkey", "s", "n")).alias("rep"))
    alike = cut(alike, "alike")
    several = alike.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wholes = alike.where("c > 1").select("key", "seg", F.lit(0).alias("a"), F.col("rep.n").alias("b"))

    wanted = alike.join(several, "key").select("rep.doc", "rep.tkey", F.struct("key", "seg", F.col("rep.s").alias("s"), F.col("rep.n").alias("n"), (F.col("kinds") > hot).alias("hot")).alias("w"))
    wanted = wanted.groupBy("doc", "tkey").agg(F.collect_list("w").alias("wanted"))
    pieces = texts.join(wanted, "doc").where(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("tkey")).select("text", "wanted")
    pieces = cut(pieces.mapInArrow(_cut_out, "key long, seg long, n int, hot boolean, bytes binary"), "pieces")
    sort_in = pieces.where("not hot").select("key", "seg", "n", "bytes").repartition("key").sortWithinPartitions("key", "seg")
    sorted_ = sort_in.mapInArrow(_sort, _FOUND)

    windows = pieces.where("hot").select("key", "seg", "n", "bytes").mapInArrow(_windows, "key long, seg long, a int, h1 long, h2 long").distinct()
    again = windows.groupBy("key", "h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    counted = windows.join(again, ["key", "h1", "h2"]).select("key", "seg", "a", (F.col("a") + 1).alias("b"))

    found = cut(wholes.unionByName(sorted_).unionByName(counted).groupBy("key", "seg").agg(F.collect_set(F.struct("a", "b")).alias("w")), "found")
    placed = rows.join(found, ["key", "seg"]).select("tkey", "s", F.explode("w").alias("w"))
    return placed.groupBy("tkey").agg(F.collect_set(F.struct((F.col("s") + F.col("w.a")).alias("a"), (F.col("s") + F.col("w.b")).alias("b"))).alias("found"))


def drop_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, spans (the maximal removed stretches of bytes) and kept (the other bytes) for every row of docs (doc_id, text)."""
    found = repeated_windows(docs, hot)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text") >= LENGTH, F.lit(False))
    short = texts.where(~long).select("doc_id", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("kept"))
    keyed = texts.where(long).withColumn("tkey", F.unhex(F.md5(F.col("text").cast("binary"))))
    joined = splittable(keyed, found, "tkey", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_drop, "doc_id long, spans array<struct<start:bigint,end:bigint>>, kept binary").unionByName(short)


def digest(dropped: DataFrame) -> DataFrame:
    """What drop_repeats() gives, in numbers: the bytes of a text, of them removed and kept, the spans and a hash of what is left."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return dropped.select("doc_id", (removed + F.length("kept")).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("n_kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(drop_repeats(read(spark, sf_dir, "documents")))
