"""What the operators of this package share: the shared folder, written tables, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of letters and digits; the words of every word-based operator here.
WORD = re.compile(r"[^\W_]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a session of one process, if need be, one made for it."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkvane-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The folder of the run that this thread is in, if any (see scratch()).
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, so that lost executors cost a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the intermediate tables of what is called within, deleted at the end with what it holds.

    For callers that have written or collected the results by then; those of others, and results made
    before, keep their tables.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    before = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(key: Column) -> Column:
    """True for the fifth of the rows that no model of this package learns from; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


#: Lower case of each Latin-1 character that words have, and a space for each other.
_LATIN = bytes(ord(chr(c).lower()) if WORD.match(chr(c)) else 32 for c in range(256))


def latin_words(text: str) -> list[bytes] | None:
    """words() of a text as Latin-1 bytes, several times as fast; None for a text with other characters."""
    try:
        return text.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        return None


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the finaliser published as splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], text: int, chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches again, each with its texts and about `chars` bytes of them, however long the texts are."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        s = 0
        while s < len(batch):
            e = max(s + 1, int(np.searchsorted(size, (size[s - 1] if s else 0) + chars)))
            part = batch.slice(s, e - s)
            yield part, part.column(text).to_pylist()
            s = e


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python workers at most so many rows at once: texts are long, and a worker holds a batch whole."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
