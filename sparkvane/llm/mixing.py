"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents fall into cells of source, language and topic. A cell's tokens are raked: its weight is
multiplied, for one dimension after the other, by target share over present share of its value, until
all three marginals are within GAP of their targets; targets that no weights can meet end after
MOST_ROUNDS. Documents are then sampled with probability
min(1, scale x weight of the cell), the scale set so that the expected tokens are the wanted fraction.

Targets are shares by value of a dimension, or by default every value's own share of the tokens to the
power SMOOTHING, which lifts the rare ones. A document's tokens are its characters over four, one at
least. Null sources, languages and texts are the values `none`, `und` and an empty text. A value that
targets lack gets nothing. An empty table gives no rows. Rows that repeat a doc_id share one draw and
a null doc_id is drawn as `null`; other columns are ignored by `mix` and kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, read

DIMENSIONS = ("source", "lang", "topic")
SMOOTHING, FRACTION, GAP, CUT_ROUNDS, MOST_ROUNDS, SCALINGS, SEED = 0.7, 0.5, 1e-12, 4, 60, 12, "mix"


def topic(text: Column) -> Column:
    """A coarse topic by plain marks in the text."""
    return (
        F.when(text.contains("icense") | text.contains("opyright"), "legal")
        .when(text.contains("@") | text.contains("http"), "contact")
        .when(F.length(text) < 400, "short")
        .when(F.length(text) >= 6000, "long")
        .otherwise("prose")
    )


def placed(docs: DataFrame) -> DataFrame:
    """docs with the cell and the draw of each document: _source, _lang, _topic, _tokens, _draw."""
    text = F.coalesce("text", F.lit(""))
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return docs.withColumns({"_source": F.coalesce("source", F.lit("none")), "_lang": F.coalesce("lang", F.lit("und")), "_topic": topic(text), "_tokens": F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long"), "_draw": draw})


def rake(cells: DataFrame, gap: float = GAP, most: int = MOST_ROUNDS) -> DataFrame:
    """cells (_source, _lang, _topic, tokens, and the targets t_source, t_lang, t_topic) with their weight."""
    out = cells.withColumn("weight", F.lit(1.0))
    total = F.sum(F.col("tokens")).over(Window.partitionBy())
    out = out.withColumn("all_tokens", total.cast("double"))
    for _ in range(0, most, CUT_ROUNDS):
        for _ in range(CUT_ROUNDS):
            for d in DIMENSIONS:
                have = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(f"_{d}"))
                out = out.withColumn("have", have).withColumn("weight", F.when(F.col("have") > 0, F.col("weight") * F.col(f"t_{d}") * F.col("all_tokens") / F.col("have")).otherwise(0.0)).drop("have")
        out = cut(out, "cells")
        # The last dimension's marginal is met by construction; the others tell how far it is.
        off = None
        for d in DIMENSIONS[:-1]:
            own = out.groupBy(f"_{d}").agg(F.sum(F.col("weight") * F.col("tokens")).alias("have"), (F.max(f"t_{d}") * F.max("all_tokens")).alias("want"))
            own = own.select(F.abs(F.try_divide(F.col("have"), F.col("want")) - 1).alias("off"))
            off = own if off is None else off.unionByName(own)
        if (off.agg(F.max("off")).first()[0] or 0.0) <= gap:
            break
    return out


def default_targets(cells: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """cells (_source, _lang, _topic, tokens) with t_source, t_lang and t_topic."""
    for d in DIMENSIONS:
        sums = cells.groupBy(f"_{d}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(smoothing)).alias("lifted"))
        sums = sums.select(f"_{d}", (F.col("lifted") / F.sum("lifted").over(Window.partitionBy())).alias(f"t_{d}"))
        cells = cells.join(sums, f"_{d}")
    return cells


def given_targets(cells: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    for d in DIMENSIONS:
        share = F.lit(0.0)
        for value, s in targets[d].items():
            share = F.when(F.col(f"_{d}") == value, float(s) / sum(targets[d].values())).otherwise(share)
        cells = cells.withColumn(f"t_{d}", share)
    return cells


def _drawn(docs: DataFrame, targets: dict[str, dict[str, float]] | None, fraction: float) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _draw, _weight and _probability."""
    rows = placed(docs)
    cells = rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    cells = cut(cells, "counts")
    raked = cut(rake(given_targets(cells, targets) if targets else default_targets(cells)), "raked")
    # The scale is found from sums, one row at a time: capped cells give all they have.
    scale, everything = fraction, raked.agg(F.sum("tokens")).first()[0] or 0
    for _ in range(SCALINGS):
        capped = F.lit(scale) * F.col("weight") >= 1
        full, rest = raked.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        if not rest:
            break
        new = max((fraction * everything - full) / rest, 0.0)
        if abs(new - scale) <= 1e-12 * max(scale, 1.0):
            break
        scale = new
    chance = raked.select("_source", "_lang", "_topic", F.col("weight").alias("_weight"), F.least(F.lit(1.0), F.lit(scale) * F.col("weight")).alias("_probability"))
    return rows.join(chance, ["_source", "_lang", "_topic"])


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability and kept for every row of docs (doc_id, text, lang, source)."""
    done = _drawn(docs.select("doc_id", "text", "lang", "source"), targets, fraction)
    named = [F.col(f"_{k}").alias(k) for k in ("source", "lang", "topic", "tokens", "weight", "probability")]
    return done.select("doc_id", *named, (F.col("_draw") < F.col("_probability")).alias("kept"))


def keep_sampled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that the sample holds, with all their columns, whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "lang", "source")
    return _drawn(packed, None, FRACTION).where("_draw < _probability").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(read(spark, sf_dir, "documents"))
    return done.withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)})


def _sql() -> str:
    parts = [f"""rows AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'und') AS lang,
  CASE WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'legal' WHEN contains(t, '@') OR contains(t, 'http') THEN 'contact'
    WHEN length(t) < 400 THEN 'short' WHEN length(t) >= 6000 THEN 'long' ELSE 'prose' END AS topic,
  greatest(1, ceil(length(t) / 4.0))::BIGINT AS tokens,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS draw
  FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL)"]
    for d in DIMENSIONS:
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, l / sum(l) OVER () AS t_{d} FROM (SELECT {d}, pow(sum(tokens)::DOUBLE, {SMOOTHING}) AS l FROM cells GROUP BY {d}))")
    parts.append("w0 AS MATERIALIZED (SELECT cells.*, t_source, t_lang, t_topic, 1.0::DOUBLE AS weight, (sum(tokens) OVER ())::DOUBLE AS total FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n = 0
    for _ in range(MOST_ROUNDS):
        for d in DIMENSIONS:
            have = f"SELECT *, sum(weight * tokens) OVER (PARTITION BY {d}) AS have FROM w{n}"
            n += 1
            parts.append(f"w{n} AS MATERIALIZED (SELECT * EXCLUDE (have) REPLACE (CASE WHEN have > 0 THEN weight * t_{d} * total / have ELSE 0 END AS weight) FROM ({have}))")
    parts.append(f"s0 AS (SELECT {FRACTION}::DOUBLE AS scale)")
    for k in range(SCALINGS):
        parts.append(f"""s{k + 1} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN greatest(({FRACTION} * everything - full_) / rest, 0.0) ELSE scale END AS scale FROM
  (SELECT any_value(scale) AS scale, sum(tokens)::DOUBLE AS everything, sum(CASE WHEN scale * weight >= 1 THEN tokens ELSE 0 END)::DOUBLE AS full_, sum(CASE WHEN scale * weight >= 1 THEN 0.0 ELSE tokens * weight END) AS rest FROM w{n}, s{k}))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, rows.source, rows.lang, rows.topic, rows.tokens, round(weight, 6) AS weight, round(least(1.0, scale * weight), 6) AS probability, draw < least(1.0, scale * weight) AS kept
FROM rows JOIN w{n} AS c USING (source, lang, topic), s{SCALINGS}"""


SQL = _sql()
