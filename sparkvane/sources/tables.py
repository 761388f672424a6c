"""Scans, validated scans, sinks, and the adapters that give tables the engine's shape."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import count_if, uniform

# The columns of the raw flow table, by type.
LONG_COLUMNS = "id spkts dpkts sbytes dbytes sttl dttl sloss dloss swin stcpb dtcpb dwin smean dmean trans_depth response_body_len ct_srv_src ct_state_ttl ct_dst_ltm ct_src_dport_ltm ct_dst_sport_ltm ct_dst_src_ltm is_ftp_login ct_ftp_cmd ct_flw_http_mthd ct_src_ltm ct_srv_dst is_sm_ips_ports label".split()
DOUBLE_COLUMNS = "dur rate sload dload sinpkt dinpkt sjit djit tcprtt synack ackdat".split()
STRING_COLUMNS = "proto service state attack_cat".split()
ID, CATEGORY, LABEL = "id", "attack_cat", "label"

RAW_SCHEMA = T.StructType([*(T.StructField(c, T.LongType()) for c in LONG_COLUMNS), *(T.StructField(c, T.DoubleType()) for c in DOUBLE_COLUMNS), *(T.StructField(c, T.StringType()) for c in STRING_COLUMNS)])

#: Weight of the label in each model's synthetic score; the rest is a uniform draw.
MODEL_WEIGHTS = {"svm": 0.30, "rf": 0.38, "qsvc": 0.25}
MODELS = ("svm", "rf", "qsvc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A CSV table with a header, by column name; FileNotFoundError if it is missing."""
    try:
        names = spark.read.option("header", True).csv(path).columns
        known = {f.name: f for f in schema}
        ordered = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
        return spark.read.schema(ordered).option("header", True).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def checked_csv(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = (), binary: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table with a header whose bad records are kept beside the good ones; FileNotFoundError if it is missing, ValueError without a required column.

    Fields are read as text and cast, so that one that does not parse spoils nothing else: reject_column
    is the first column, in the file's order, whose text is no value of its type (or no 0 or 1, for
    those in `binary`; or missing, for required ones), or `fields` for a line of another number of
    fields; reject_value is the text. Both are null for good records.
    """
    try:
        names = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if missing := [c for c in (*required, *binary) if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    types = {f.name: f.dataType for f in schema}
    text = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField("_line", T.StringType())])
    rows = spark.read.schema(text).option("header", True).option("columnNameOfCorruptRecord", "_line").csv(path)
    typed = {c: F.col(f"`{c}`").try_cast(types.get(c, T.StringType())) for c in names}
    column, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(names):
        own = F.col(f"`{c}`")
        bad = own.isNotNull() & typed[c].isNull()
        if c in required or c in binary:
            bad = bad | own.isNull()
        if c in binary:
            bad = bad | ~typed[c].isin(0, 1)
        column, value = F.when(bad, F.lit(c)).otherwise(column), F.when(bad, own).otherwise(value)
    # Spark does not read the line of a bad record alone, so the fields are looked at with it (the length is never negative).
    short = F.col("_line").isNotNull() & (F.length(F.concat_ws("", *(F.col(f"`{c}`") for c in names))) >= 0)
    return rows.select(*(typed[c].alias(c) for c in names), F.when(short, F.lit("fields")).otherwise(column).alias("reject_column"), F.when(short, F.col("_line")).otherwise(value).alias("reject_value"))


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, report): whole JSON files as text."""
    return spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("report"))


def report_rows(df: DataFrame, report: str, *keep: str) -> DataFrame:
    """keep, path, kind and value: a row for each scalar of nested JSON texts of any shape, whose keys need not be known.

    Paths are like $.a.b[0]. Empty objects and lists are values {} and []. A text that is no JSON is
    one row of kind `BROKEN`, a null text none. The levels are opened one after the other, as many as
    the deepest report has.
    """
    spark = df.sparkSession
    level = df.where(F.col(report).isNotNull()).select(*keep, F.lit("$").alias("path"), F.try_parse_json(report).alias("v"), F.col(report).alias("_text"))
    out = level.where("v IS NULL").select(*keep, "path", F.lit("BROKEN").alias("kind"), F.col("_text").alias("value"))
    level = level.where("v IS NOT NULL").drop("_text")
    while True:
        told = level.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)).withColumn("text", F.to_json("v"))
        box = F.col("kind").isin("OBJECT", "ARRAY") & ~F.col("text").isin("{}", "[]")
        scalar = F.when(F.col("kind").isin("OBJECT", "ARRAY"), F.col("text")).otherwise(F.col("v").cast("string"))
        out = out.unionByName(told.where(~box).select(*keep, "path", "kind", scalar.alias("value")))
        level = told.where(box).drop("kind", "text")
        if level.isEmpty():
            return out
        inner = spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_v"))
        step = F.when(F.col("_key").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "_key"))
        level = level.lateralJoin(inner).select(*keep, F.concat("path", step).alias("path"), F.col("_v").alias("v"))


def load_data(spark: SparkSession, train_path: str, test_path: str) -> tuple[DataFrame, DataFrame]:
    return scan_csv(spark, train_path), scan_csv(spark, test_path)


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def report_or(path: str | Path, fallback: dict) -> tuple[dict, bool]:
    """A JSON report and whether it is real; the fallback if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text()), True
    except (OSError, ValueError):
        return fallback, False


@lru_cache(maxsize=64)
def loaded_report(path: str) -> dict:
    """A JSON report, read once a process."""
    return json.loads(Path(path).read_text())


def stored_selection(path: str, run: str = "all_features", size: int | None = 4) -> list[str]:
    """The features that a stored selection report holds for a run; FileNotFoundError without it, ValueError unless there are `size`."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    got = list(loaded_report(str(path))["runs"][run]["selected_features"])
    if size is not None and len(got) != size:
        raise ValueError(f"{len(got)} features stored, not {size}: {', '.join(got)}")
    return got


def stored_sets(path: str, primary: str = "all_features", ablation: str = "TTL_excluded") -> tuple[list[str], list[str]]:
    """The primary and the ablation features of a stored selection report."""
    return stored_selection(path, primary, None), stored_selection(path, ablation, None)


def write_report(report: dict, path: str | Path) -> None:
    """A small report as indented JSON; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, default=str))


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def check_predictions(df: DataFrame, required: list[str], binary: list[str]) -> DataFrame:
    """df itself, if it has the required columns and its binary columns hold 0 and 1 only; one pass."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if bad := {c: n for c, n in invalid_counts(df, binary).first().asDict().items() if n}:
        raise ValueError(f"values other than 0 and 1: {bad}")
    return df


def invalid_counts(df: DataFrame, binary: list[str]) -> DataFrame:
    return df.agg(*(count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias(c) for c in binary))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by an explicit order, as files have none here."""
    return df.orderBy(order).limit(n)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order."""
    got = df.agg(F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{got.x}|{got.s}|{got.n}".encode()).hexdigest()


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as labelled flows: row_id, four numeric features, a binary one, two categories, label and category."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_linestatus") == "O").cast("int").alias("is_open"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_returnflag").alias("category"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y, category and a score and a prediction of three models for each flow."""
    base = flows(spark, sf_dir).select("row_id", F.col("label").alias("y"), "category")
    scores = {f"{m}_score": F.lit(w) * F.col("y") + F.lit(1 - w) * uniform(m, F.col("row_id")) for m, w in MODEL_WEIGHTS.items()}
    return base.withColumns(scores).withColumns({f"{m}_pred": (F.col(f"{m}_score") >= 0.5).cast("int") for m in MODELS})


def by_model(df: DataFrame, *keep: str) -> DataFrame:
    """The long form of scored rows: keep, model, score, pred."""
    stacked = ", ".join(f"'{m}', {m}_score, {m}_pred" for m in MODELS)
    return df.selectExpr(*keep, f"stack({len(MODELS)}, {stacked}) AS (model, score, pred)")
