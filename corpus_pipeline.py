"""A training corpus from raw documents: each stage is written as Parquet and read again by the next.

Every stage works on all that its predecessor kept. The first four return the columns of documents;
the last returns what the token-id files hold of each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkvane.llm import decontamination, jaccard, language, mixing, token_files
from sparkvane.llm.shared import read, scratch, shared_dir

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language.keep_identified),
    ("jaccard_join", jaccard.keep_one_of_each),
    ("decontamination", decontamination.keep_clean),
    ("mixing", mixing.keep_sampled),
    ("token_files", token_files.write_tokens),
]

#: No stage but mixing can be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents at sf_dir."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):  # what the stage writes on its way
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
