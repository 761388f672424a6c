"""What operators do with whole DataFrames."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df, kept in memory for as long as it is read again and again."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; in a session of one process, if it is unset, one made for it."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
