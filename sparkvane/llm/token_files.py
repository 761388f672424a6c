"""Token-id files: whole texts as ids in coded blocks, written in document order and read back.

The files are Parquet containers (so that Spark's writer commits them and any store holds them) of
rows (part, block, n_ids, n_docs, payload). The payload is this format's own binary: a section of
document ids and lengths, and the ids as a block of the range coder in `range_coder`, each with its
checksum. Blocks are coded independently; a block holds whole documents.

Null and empty texts are documents of the end id alone. Rows that repeat a doc_id are all kept, side
by side, in the order of a hash of their text, so every run places them alike; rows whose doc_id is
null come first. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import range_coder
from .shared import parts_for, read, shared_dir, sliced, small_batches

BLOCK_IDS, LANES, END_ID = 1_500_000, 4096, 2
CACHE_WORDS, SLICE_CHARS = 300_000, 4_000_000
#: Kinds of the bytes of UTF-8 texts: white space, letters, digits, other marks, the end of a text; ODD where Unicode
#: versions may differ on the character, so that a text with such goes to the library as a whole.
SPACE, LETTER, DIGIT, MARK, END, ODD = range(6)
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*b"\t\n\r "]] = SPACE
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
KIND[48:58] = DIGIT
KIND[0xC2] = MARK
KIND[0] = END
KIND_OF = KIND.tobytes()
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: The characters by which the library's ByteLevel writes bytes: printable Latin-1 as it is, the others from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_UNPRINTED = [b for b in range(256) if b not in _PRINTED]
BYTE_LEVEL = "".join(chr(b if b in _PRINTED else 256 + _UNPRINTED.index(b)) for b in range(256))
BLOCKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("n_docs", T.IntegerType()), T.StructField("payload", T.BinaryType())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Places of characters outside À-ÖØ-öø-ɏ, ASCII and ¡-§¿, of control characters and of `<|`; raw has a byte more than kinds."""
    odd, after = kinds == ODD, raw[1:]
    for lead, wrong in ((0xC2, lambda c: ((c < 0xA1) | (c > 0xA7)) & (c != 0xBF)), (0xC3, lambda c: (c == 0x97) | (c == 0xB7)), (0xC9, lambda c: c > 0x8F), (0x3C, lambda c: c == 0x7C)):
        at = np.flatnonzero(raw[:-1] == lead)
        odd[at[wrong(after[at])]] = True
    return np.flatnonzero(odd)


def pre_tokens(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of byte-level BPE, as the library documents its ByteLevel pattern; a text's END is one.

    `'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|\\s+(?!\\S)|\\s+`: runs of one kind, but the last of several
    white spaces stands apart, a blank goes to the run after it, and an apostrophe that begins a run may be a contraction.
    """
    start = np.empty(len(kinds), bool)
    start[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start |= kinds == END
    space = kinds == SPACE
    run = ~space & (kinds != END)
    start[:-1] |= space[:-1] & run[1:]
    start[1:] &= ~((raw[: len(kinds) - 1] == 32) & run[1:])
    at = np.flatnonzero(start & (raw[: len(kinds)] == 39))
    one, two = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
    pair = one.astype(np.uint16) << 8 | two
    for wide, hit in ((2, np.isin(one, [*b"stmd"])), (3, np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]))):
        start[at[hit] + 1] = False
        start[at[hit] + wide] = True
    return np.flatnonzero(start)


def alike(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each different string data[starts:ends] one place among them, and of each string which of these it is; exact.

    Strings of up to 16 bytes are told by their length, first and last 8 bytes; longer ones by their number in a dictionary.
    data has 8 bytes more than the strings.
    """
    eights = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    size = ends - starts
    head = eights[starts] & _HEAD[np.minimum(size, 8)]
    tail = np.where(size > 8, eights[np.maximum(ends - 8, 0)], np.uint64(0))
    if len(long := np.flatnonzero(size > 16)):
        numbers: dict[bytes, int] = {}
        head[long] = [numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        tail[long] = 0
    size = np.minimum(size, 17).astype(np.uint64)
    h = (head ^ (tail * _C[1])) * _C[0] + size
    h = (h ^ (h >> np.uint64(32))) * _C[2]
    order = np.argsort(h)
    head, tail, size, h = head[order], tail[order], size[order], h[order]
    differ = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]) | (size[1:] != size[:-1])
    if (differ & (h[1:] == h[:-1])).any():
        # Two strings of one hash: in the order of all that tells them.
        again = np.lexsort((size, tail, head))
        order, head, tail, size = order[again], head[again], tail[again], size[again]
        differ = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]) | (size[1:] != size[:-1])
    first = np.concatenate([[True], differ])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(first) - 1
    return order[first], which


class Words(dict):
    """Pre-tokens and their ids as bytes, each asked of the library's model once.

    Two generations of at most CACHE_WORDS words each are kept (and those of one slice of text), so memory is bounded
    and frequent words stay.
    """

    def __init__(self, model):
        super().__init__()
        self.ask = model.tokenize
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = b"" if word == b"\0" else array("i", [t.id for t in self.ask(charmap_decode(word, "strict", BYTE_LEVEL)[0])]).tobytes()
        self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()


class Encoder:
    """The library's encoding of texts: each different pre-token of a slice of texts is looked up once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        kind = repr(self.tokenizer.pre_tokenizer) + repr(self.tokenizer.normalizer)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and kind.endswith("None") and all(t.startswith("<|") for t in added)
        self.words = Words(self.tokenizer.model)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not texts or not self.by_word:
            return [self._whole(t) for t in texts]
        data = "\0".join([*texts, "\0" * 8]).encode()
        raw = np.frombuffer(data, np.uint8)[:-7]
        kinds = np.frombuffer(bytearray(data).translate(KIND_OF), np.uint8)[: len(raw) - 1]
        kinds[np.flatnonzero(raw[:-2] == 0xC2) + 1] = MARK
        bounds = np.flatnonzero(kinds == END)
        odd = odd_texts(raw, kinds)
        if len(odd) or len(bounds) > len(texts):
            sizes = np.cumsum([len(t.encode()) + 1 for t in texts])
            apart = {*np.searchsorted(sizes, odd, "right").tolist(), *(k for k, t in enumerate(texts) if "\0" in t)}
            rest = iter(self([t for k, t in enumerate(texts) if k not in apart]))
            return [self._whole(t) if k in apart else next(rest) for k, t in enumerate(texts)]
        starts = pre_tokens(raw, kinds)
        ends = np.append(starts[1:], len(kinds))
        one, which = alike(data, starts, ends)
        self.words.age()
        found = list(map(self.words.__getitem__, [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]))
        size = np.array(list(map(len, found)), np.int64) // 4
        at, n = (np.cumsum(size) - size)[which], size[which]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(found), np.int32)[np.repeat(at - (upto - n), n) + np.arange(upto[-1])]
        return np.split(ids, upto[np.searchsorted(starts, bounds[:-1])])


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder a worker process, which serves many tasks."""
    return Encoder(path)


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocab: int) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    index = zlib.compress(null.tobytes() + np.diff(np.array([d or 0 for d in doc_ids], "<i8"), prepend=np.int64(0)).tobytes() + np.array(lengths, "<u8").tobytes(), 1)
    return struct.pack("<III", len(doc_ids), len(index), zlib.crc32(index)) + index + range_coder.encode(ids, min(LANES, max(1, len(ids) // 256)), vocab)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Null flags, document ids, lengths and ids of a payload; ValueError if it is not whole."""
    n, size, crc = struct.unpack_from("<III", payload)
    if zlib.crc32(raw := payload[12 : 12 + size]) != crc:
        raise ValueError("the index's checksum is wrong")
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, np.uint8, n), np.cumsum(np.frombuffer(raw, "<i8", n, n)), np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64), range_coder.decode(payload[12 + size :])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of docs (doc_id, text) to path, in ascending order of doc_id."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_for(tokenizer), TaskContext.get().partitionId()
        vocab = max(encoder.vocab, end_id + 1)
        doc_ids: list = []
        lengths: list[int] = []
        chunks: list[np.ndarray] = []
        have = number = 0

        def close() -> pa.RecordBatch:
            row = [part], [number], [have], [len(doc_ids)], [pack(doc_ids, lengths, np.concatenate(chunks), vocab)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=BLOCKS.names)

        for batch, texts in sliced(batches, 1, SLICE_CHARS):
            for key, ids in zip(batch.column(0).to_pylist(), encoder([t or "" for t in texts]), strict=True):
                ids = np.append(ids, np.int32(end_id))
                if have and have + len(ids) > block_ids:
                    yield close()
                    doc_ids, lengths, chunks, have, number = [], [], [], 0, number + 1
                doc_ids.append(key)
                lengths.append(len(ids))
                chunks.append(ids)
                have += len(ids)
        if have:
            yield close()

    spark = docs.sparkSession
    small_batches(spark)
    # Rows of one doc_id, or of none, may be many: a hash of their text deals them to several ranges.
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts_for(spark), *order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files at path: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""
    stored = spark.read.schema(BLOCKS).parquet(path)
    # The running sums are over one row a block within a part, and one row a part over all.
    past = (Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(*past)), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(*past)), F.lit(0))
    starts = stored.select("part", "block", inside.alias("in_part")).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("in_part")).alias("block_start"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())] + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                null, keys, lengths, ids = unpack(payload.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = [pa.array(keys, pa.int64(), mask=null.astype(bool)), pa.array(first + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return stored.join(starts, ["part", "block"]).select("payload", "block_start").mapInArrow(documents, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs as token-id files and return what read_ids() reads from them."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer or default_tokenizer())
    return read_ids(spark, path)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the token-id files of docs, and what they hold of each document."""
    return token_files(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"))
