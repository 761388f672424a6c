"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, filter_audit, jaccard, language, line_templates, mixing, pages, repeats, shards, token_files, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.query,
    "op2_near_vectors": vectors.query,
    "op3_line_templates": line_templates.query,
    "op4_toxicity": toxicity.query,
    "op5_language_id": language.query,
    "op6_repeats": repeats.query,
    "op7_jaccard_join": jaccard.query,
    "op8_mixing": mixing.query,
    "op9_pages": pages.query,
    "op10_token_files": token_files.query,
    "op11_collocations": collocations.query,
    "op12_shards": shards.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_templates": line_templates.SQL,
    "op8_mixing": mixing.SQL,
    "op11_collocations": collocations.SQL,
    "op12_shards": shards.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
