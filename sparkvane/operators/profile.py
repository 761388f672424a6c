"""Dataset profiling and role typing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def _long(df: DataFrame, section: str, names: dict[str, str]) -> DataFrame:
    """One wide row as rows (section, name, value)."""
    pairs = F.array(*(F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for c, n in names.items()))
    return df.select(F.inline(pairs))


def profile(df: DataFrame, id_col: str, label: str, category: str) -> DataFrame:
    """(section, name, value): rows, columns, nulls, duplicates but for the id, cardinalities, label and category counts.

    One pass for counts and nulls; distinct counts and groups are partial aggregates of their own.
    """
    rest = [c for c in df.columns if c != id_col]
    wide = df.agg(F.count("*").alias("rows"), F.countDistinct(F.struct(*rest)).alias("distinct_rows"), *(count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns))
    wide = wide.withColumns({"columns": F.lit(len(df.columns)), "duplicates": F.col("rows") - F.col("distinct_rows")})
    counts = _long(wide, "table", {"rows": "rows", "columns": "columns", "duplicates": "duplicates"})
    nulls = _long(wide, "nulls", {f"null_{c}": c for c in df.columns}).where("value > 0")
    strings = [c for c, t in df.dtypes if t == "string" and c != id_col]
    kinds = _long(df.agg(*(F.countDistinct(c).alias(c) for c in strings)), "cardinality", {c: c for c in strings})
    return reduce(DataFrame.unionByName, [counts, nulls, kinds, balance(df, label), categories(df, category)])


def balance(df: DataFrame, label: str) -> DataFrame:
    """Counts and percentages by label."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all"))))  # two rows by one
    pairs = F.array(F.struct(F.lit("label").alias("section"), F.col(label).cast("string").alias("name"), F.col("n").cast("double").alias("value")), F.struct(F.lit("label_pct").alias("section"), F.col(label).cast("string").alias("name"), F.round(100.0 * F.col("n") / F.col("all"), 2).alias("value")))
    return n.select(F.inline(pairs))


def categories(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(F.col(category).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("category").alias("section"), "name", "value")


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    return sorted(a.dtypes) == sorted(b.dtypes)


def compare(a: DataFrame, b: DataFrame, id_col: str, label: str, category: str) -> DataFrame:
    """Both profiles side by side."""
    left, right = (profile(x, id_col, label, category).withColumnRenamed("value", n) for x, n in ((a, "first"), (b, "second")))
    return left.join(right, ["section", "name"], "full")


def prevalence(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select(label, "n", (F.col("n") / F.col("all")).alias("share"))


def roles(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(name, role): categorical, binary (values within {0, 1}) or numeric, all from one pass."""
    kinds = {c: t for c, t in df.dtypes if c not in exclude}
    numeric = [c for c, t in kinds.items() if t in NUMERIC]
    wide = df.agg(*(count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)).alias(c) for c in numeric))
    found = F.array(*(F.struct(F.lit(c).alias("name"), (F.when(F.col(c) == 0, "binary").otherwise("numeric") if c in numeric else F.lit("categorical")).alias("role")) for c in sorted(kinds)))
    return wide.select(F.inline(found))


def kernel_pool(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """The sorted names of numeric and binary columns."""
    return sorted(r.name for r in roles(df, exclude).collect() if r.role != "categorical")
