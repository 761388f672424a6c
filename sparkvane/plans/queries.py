"""The registered queries over the driver's tables, each next to its oracle SQL where SQL can tell it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import count_if, uniform
from ..functions.frames import shared_folder
from ..operators import agreement, calibrate, inference, jobs, kernel, metrics, models, policy, prepare, profile, projection, select, split, summaries
from ..sources import tables
from ..sources.tables import MODELS, by_model, flows, scored, table
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NUMERIC = ["quantity", "price", "discount", "tax"]
POOL = [*NUMERIC, "is_open"]
SIZES = {"train": 800, "tune": 200, "cal": 400, "test": 1000}
ANGLES = ["e0", "e1", "e2", "e3"]
#: Rows of a task of the whole-table fits.
ROWS_A_TASK = 100_000


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


def long_scored(spark: SparkSession, d: str) -> DataFrame:
    return by_model(scored(spark, d), "row_id", "y")


# --- sources -----------------------------------------------------------------------------------------------------

@query("IO4_train_pool", f"WITH {sql.FLOWS} SELECT min(row_id) AS row_id, quantity, price, discount, tax, is_open FROM flows GROUP BY quantity, price, discount, tax, is_open, status, flag, label, category")
def _(s, d):
    return prepare.dedup(flows(s, d), "row_id").select("row_id", *POOL)


@query("IO5_slice", f"WITH {sql.SCORED} SELECT row_id, y, svm_pred, rf_pred, qsvc_pred FROM scored ORDER BY row_id LIMIT 500")
def _(s, d):
    return tables.first_rows(scored(s, d).select("row_id", "y", "svm_pred", "rf_pred", "qsvc_pred"), "row_id", 500)


@query("IO8_invalid_counts", f"WITH {sql.SCORED} SELECT count_if(y NOT IN (0, 1))::BIGINT AS y, count_if(svm_pred NOT IN (0, 1))::BIGINT AS svm_pred, count_if(rf_pred NOT IN (0, 1))::BIGINT AS rf_pred, count_if(qsvc_pred NOT IN (0, 1))::BIGINT AS qsvc_pred FROM scored")
def _(s, d):
    return tables.invalid_counts(scored(s, d), ["y", "svm_pred", "rf_pred", "qsvc_pred"])


#: Faults that the scan of written flows must find: of every so many orders one has such a text in a column.
_FAULTS = (("quantity", 97, "n/a"), ("discount", 89, "0,04"), ("label", 83, "2"), ("flag", 79, None))


def _fault_sql() -> str:
    cases = " ".join(f"WHEN l_orderkey % {n} = 0 THEN '{c}'" for c, n, _ in _FAULTS)
    values = " ".join(f"WHEN '{c}' THEN {f"'{v}'" if v else 'NULL'}" for c, _, v in _FAULTS)
    return f"WITH c AS (SELECT l_quantity, CASE {cases} END AS reject_column FROM lineitem) SELECT coalesce(reject_column, 'kept') AS outcome, count(*) AS n, max(CASE reject_column {values} END) AS value, round(sum(CASE WHEN reject_column IS NULL THEN l_quantity END), 2) AS quantity FROM c GROUP BY ALL"


@query("IO2_checked_scan", _fault_sql())
def _(s, d):
    """Flows are written as CSV, some with faults, and read back: what the scan keeps and rejects, by column."""
    rows = flows(s, d).select("row_id", *(F.col(c).cast("string").alias(c) for c in ("quantity", "discount", "label", "flag")), F.split("row_id", ":")[0].cast("long").alias("_order"))
    for c, n, v in _FAULTS:
        rows = rows.withColumn(c, F.when(F.col("_order") % n == 0, F.lit(v)).otherwise(F.col(c)))
    path = f"{shared_folder(s)}/checked-{uuid.uuid4().hex}"
    rows.drop("_order").write.option("header", True).csv(path)
    got = tables.checked_csv(s, path, T.StructType([T.StructField("quantity", T.DoubleType()), T.StructField("discount", T.DoubleType()), T.StructField("label", T.IntegerType())]), required=("flag",), binary=("label",))
    kept = F.col("reject_column").isNull()
    return got.groupBy(F.coalesce("reject_column", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), F.max("reject_value").alias("value"), F.round(F.sum(F.when(kept, F.col("quantity"))), 2).alias("quantity"))


_REPORTS = "SELECT user_id, event_type, count(*) AS n, max(json_extract_string(props, '$.k')::INT) AS top FROM events GROUP BY ALL"


@query("IO6_report_rows", f"""WITH p AS ({_REPORTS})
SELECT user_id, '$.types.' || event_type || '.n' AS path, 'BIGINT' AS kind, n::VARCHAR AS value FROM p
UNION ALL SELECT user_id, '$.types.' || event_type || '.top', CASE WHEN top IS NULL THEN 'VOID' ELSE 'BIGINT' END, top::VARCHAR FROM p
UNION ALL SELECT user_id, '$.seen[' || (row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1) || ']', 'STRING', event_type FROM p
UNION ALL SELECT DISTINCT user_id, '$.none', 'OBJECT', '{{}}' FROM p""")
def _(s, d):
    """Nested reports a user, whose keys are the event types that there are, opened to their scalars."""
    per = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("top"))
    inner = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", F.to_json(F.struct("n", "top"), {"ignoreNullFields": "false"})))))
    reports = per.groupBy("user_id").agg(inner.alias("types"), F.array_sort(F.collect_list("event_type")).alias("seen"))
    # The inner reports as text, keys and all, as a report file has them.
    body = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    text = F.concat(F.lit('{"types":{'), body, F.lit('},"seen":'), F.to_json("seen"), F.lit(',"none":{}}'))
    return tables.report_rows(reports.select("user_id", text.alias("report")), "report", "user_id")


# --- projections and predicates ----------------------------------------------------------------------------------

@query("P1_features_target", f"WITH {sql.FLOWS} SELECT row_id, quantity, price, discount, tax, is_open, status, flag, label AS y, trim(category) AS category FROM flows")
def _(s, d):
    return prepare.features_and_target(flows(s, d), "label", (), "category")


@query("P2_clean_category", "SELECT trim(coalesce(event_type, 'Normal')) AS category, 'Unknown' AS missing, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").select(prepare.clean_category(F.col("event_type")).alias("category"), prepare.clean_category(None).alias("missing")).groupBy("category", "missing").agg(F.count("*").alias("n"))


def _roles_sql() -> str:
    parts = [f"SELECT '{c}' AS name, CASE WHEN count_if({c} IS NOT NULL AND {c} NOT IN (0, 1)) = 0 THEN 'binary' ELSE 'numeric' END AS role FROM flows" for c in [*POOL, "label"]]
    return f"WITH {sql.FLOWS} " + " UNION ALL ".join(parts + [f"SELECT '{c}', 'categorical'" for c in ("category", "flag", "row_id", "status")])


@query("P3_roles", _roles_sql())
def _(s, d):
    return profile.roles(flows(s, d))


@query("P4_kernel_pool", f"WITH roles AS ({_roles_sql()}) SELECT name FROM roles WHERE role <> 'categorical' AND name <> 'label'")
def _(s, d):
    return profile.roles(flows(s, d), ("label",)).where("role <> 'categorical'").select("name")


@query("P8_assemble", f"WITH {sql.SCORED} SELECT row_id AS sample_id, y AS y_true, category, svm_pred, svm_score, rf_pred, rf_score, qsvc_pred, qsvc_score FROM scored")
def _(s, d):
    return scored(s, d).select(F.col("row_id").alias("sample_id"), F.col("y").alias("y_true"), "category", *(f"{m}_{k}" for m in MODELS for k in ("pred", "score")))


@query("P9_disagreeing_head", f"WITH {sql.SCORED} SELECT row_id, y, rf_pred, qsvc_pred FROM scored WHERE rf_pred <> qsvc_pred ORDER BY row_id LIMIT 50")
def _(s, d):
    return scored(s, d).where("rf_pred <> qsvc_pred").orderBy("row_id").limit(50).select("row_id", "y", "rf_pred", "qsvc_pred")


@query("P10_threshold", f"WITH {sql.SCORED} SELECT (rf_score >= 0.25::DOUBLE)::INT AS alarm, count(*) AS n FROM scored GROUP BY 1")
def _(s, d):
    return scored(s, d).groupBy(metrics.predict(F.col("rf_score"), 0.25).alias("alarm")).agg(F.count("*").alias("n"))


@query("P11_mask_counts", f"WITH {sql.SCORED} SELECT count_if(y = 1 AND rf_pred = 1)::BIGINT AS hits, count_if(y = 0 AND rf_pred = 1)::BIGINT AS alarms, count_if(svm_score > rf_score)::BIGINT AS svm_higher FROM scored")
def _(s, d):
    return scored(s, d).agg(count_if((F.col("y") == 1) & (F.col("rf_pred") == 1)).alias("hits"), count_if((F.col("y") == 0) & (F.col("rf_pred") == 1)).alias("alarms"), count_if(F.col("svm_score") > F.col("rf_score")).alias("svm_higher"))


@query("P12_negatives", f"WITH {sql.SCORED} SELECT category, count(*) AS n, round(max(rf_score), 6) AS top FROM scored WHERE y = 0 GROUP BY category")
def _(s, d):
    return scored(s, d).where("y = 0").groupBy("category").agg(F.count("*").alias("n"), F.round(F.max("rf_score"), 6).alias("top"))


@query("P13_offenders", f"WITH {sql.FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count_if({c} IS NULL OR isnan({c}::DOUBLE) OR isinf({c}::DOUBLE))::BIGINT AS n FROM flows" for c in POOL))
def _(s, d):
    return prepare.offenders(flows(s, d), POOL)


@query("P14_quarantine", "SELECT CASE WHEN c_acctbal IS NULL THEN 'c_acctbal: missing' WHEN isnan(c_acctbal) OR isinf(c_acctbal) THEN 'c_acctbal: not finite' END AS reject_reason, count(*) AS n FROM customer GROUP BY 1")
def _(s, d):
    return prepare.quarantine(table(s, d, "customer"), ["c_acctbal"]).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("P15_non_negative", "SELECT CASE WHEN c_acctbal IS NULL THEN 'c_acctbal: missing' WHEN isnan(c_acctbal) OR isinf(c_acctbal) THEN 'c_acctbal: not finite' WHEN c_acctbal < 0 THEN 'c_acctbal: negative' END AS reject_reason, count(*) AS n FROM customer GROUP BY 1")
def _(s, d):
    return prepare.quarantine(table(s, d, "customer"), ["c_acctbal"], non_negative=True).groupBy("reject_reason").agg(F.count("*").alias("n"))


# --- joins -------------------------------------------------------------------------------------------------------

@query("J1_labels_of_documents", "SELECT d.doc_id, lang, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", "quality", "toxic")


@query("J2_align_models", f"WITH {sql.SCORED} SELECT a.row_id, a.y, a.svm_pred, b.rf_pred FROM scored a JOIN scored b ON a.row_id = b.row_id")
def _(s, d):
    base = scored(s, d)
    return base.select("row_id", "y", "svm_pred").join(base.select("row_id", "rf_pred"), "row_id")


@query("J3_reproject", f"WITH {sql.FLOWS} SELECT row_id, price, tax FROM flows WHERE row_id IN (SELECT row_id FROM {sql.ranked('flows', 42)} JOIN {sql.quota('flows', 1000)} USING (label) WHERE place < q)")
def _(s, d):
    f = flows(s, d)
    return split.reprojected(f, split.sample(f, 1000, "row_id", "label", 42), ["price", "tax"], "row_id")


@query("J4_remainder", f"WITH {sql.FLOWS} SELECT label, count(*) AS n FROM flows WHERE row_id NOT IN (SELECT row_id FROM {sql.ranked('flows', 42)} JOIN {sql.quota('flows', 1000)} USING (label) WHERE place < q) GROUP BY label")
def _(s, d):
    f = flows(s, d)
    return split.remainder(f, split.sample(f, 1000, "row_id", "label", 42), "row_id").groupBy("label").agg(F.count("*").alias("n"))


@query("J7_model_pairs", f"WITH {sql.LONG} SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, count_if(a.pred = b.pred)::BIGINT AS agree FROM long a JOIN long b ON a.row_id = b.row_id AND a.model < b.model GROUP BY 1, 2")
def _(s, d):
    return agreement.long_pairs(long_scored(s, d))


@query("J8_alignment_audit", f"WITH {sql.SCORED}, raw AS (SELECT row_id, label FROM flows) SELECT count(*) AS n, count_if(raw.row_id IS NULL OR raw.label <> scored.y)::BIGINT AS mismatches FROM scored LEFT JOIN raw ON scored.row_id = raw.row_id")
def _(s, d):
    raw = flows(s, d).select("row_id", "label")
    return scored(s, d).join(raw, "row_id", "left").agg(F.count("*").alias("n"), count_if(F.col("label").isNull() | (F.col("label") != F.col("y"))).alias("mismatches"))


# --- aggregates --------------------------------------------------------------------------------------------------

def _profile_sql(source: str, with_: str, columns: list[str], id_col: str, strings: list[str], label: str, category: str) -> str:
    rest = ", ".join(c for c in columns if c != id_col)
    parts = [
        f"SELECT 'table' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM {source}",
        f"SELECT 'table', 'columns', {len(columns)}::DOUBLE",
        f"SELECT 'table', 'duplicates', (count(*) - count(DISTINCT ({rest})))::DOUBLE FROM {source}",
        *(f"SELECT * FROM (SELECT 'nulls', '{c}', count_if({c} IS NULL)::DOUBLE AS v FROM {source}) WHERE v > 0" for c in columns),
        *(f"SELECT 'cardinality', '{c}', count(DISTINCT {c})::DOUBLE FROM {source}" for c in strings),
        f"SELECT 'label', {label}::VARCHAR, count(*)::DOUBLE FROM {source} GROUP BY {label}",
        f"SELECT 'label_pct', {label}::VARCHAR, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM {source}), 2) FROM {source} GROUP BY {label}",
        f"SELECT 'category', {category}, count(*)::DOUBLE FROM {source} GROUP BY {category}",
    ]
    return f"{with_} " + " UNION ALL ".join(parts)


FLOW_COLUMNS = ["row_id", *POOL, "status", "flag", "label", "category"]


@query("A1_profile", _profile_sql("flows", f"WITH {sql.FLOWS}", FLOW_COLUMNS, "row_id", ["status", "flag", "category"], "label", "category"))
def _(s, d):
    return profile.profile(flows(s, d), "row_id", "label", "category")


@query("A1_profile_events", _profile_sql("ev", "WITH ev AS (SELECT event_id, user_id, value, event_type, props, (event_type = 'error')::INT AS label FROM events)", ["event_id", "user_id", "value", "event_type", "props", "label"], "event_id", ["event_type", "props"], "label", "event_type"))
def _(s, d):
    ev = table(s, d, "events").select("event_id", "user_id", "value", "event_type", "props", (F.col("event_type") == "error").cast("int").alias("label"))
    return profile.profile(ev, "event_id", "label", "event_type")


@query("A3_spread", f"WITH {sql.FLOWS}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, var_samp({c}) AS v, count(DISTINCT {c}) AS n_distinct FROM flows" for c in POOL) + ") SELECT name, round(v, 4) AS variance, n_distinct, NOT (n_distinct <= 1 OR v <= 1e-5) AS kept FROM r")
def _(s, d):
    return select.spread(flows(s, d), POOL).withColumn("variance", F.round("variance", 4))


@query("A4_moments", f"WITH {sql.FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(skewness({c}), 4) AS skew FROM flows" for c in NUMERIC))
def _(s, d):
    m = prepare.moments(flows(s, d), NUMERIC)
    return m.withColumns({c: F.round(c, 4) for c in ("mean", "std", "skew")})


@query("A5_prevalence", f"WITH {sql.FLOWS} SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM flows)::DOUBLE AS share FROM flows GROUP BY label")
def _(s, d):
    return profile.prevalence(flows(s, d), "label")


_SEEDED = f"{sql.LONG}, seeded AS (SELECT model, abs(hash_seed) % 5 AS seed, y, pred FROM (SELECT *, ('0x' || substr(md5('seed:' || row_id), 1, 6))::BIGINT AS hash_seed FROM long)), runs AS (SELECT model, seed, (count_if(y = pred) / count(*)::DOUBLE) AS accuracy, (count_if(y = 0 AND pred = 1) / count_if(y = 0)::DOUBLE) AS fpr FROM seeded GROUP BY model, seed), tall AS (SELECT model, seed, 'accuracy' AS metric, accuracy AS value FROM runs UNION ALL SELECT model, seed, 'fpr', fpr FROM runs)"


def _seed_runs(s, d):
    seed = (F.conv(F.substring(F.md5(F.concat(F.lit("seed:"), F.col("row_id")).cast("binary")), 1, 6), 16, 10).cast("long") % 5).alias("seed")
    runs = long_scored(s, d).groupBy("model", seed).agg((count_if(F.col("y") == F.col("pred")) / F.count("*")).alias("accuracy"), (count_if((F.col("y") == 0) & (F.col("pred") == 1)) / count_if(F.col("y") == 0)).alias("fpr"))
    return summaries.metrics_long(runs, ["model", "seed"], ["accuracy", "fpr"])


@query("A6_over_seeds", f"WITH {_SEEDED} SELECT model, metric, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS std_sample, round(stddev_pop(value), 6) AS std_pop FROM tall GROUP BY model, metric")
def _(s, d):
    return summaries.over_seeds(_seed_runs(s, d), ["model", "metric"])


@query("A10_benchmark_pivot", f"WITH {_SEEDED}, m AS (SELECT model, metric, round(avg(value), 6) AS mean FROM tall GROUP BY model, metric) SELECT model, max(CASE WHEN metric = 'accuracy' THEN mean END) AS accuracy, max(CASE WHEN metric = 'fpr' THEN mean END) AS fpr FROM m GROUP BY model")
def _(s, d):
    return summaries.over_seeds(_seed_runs(s, d), ["model", "metric"]).groupBy("model").pivot("metric", ["accuracy", "fpr"]).agg(F.first("mean"))


_HALF_COLUMNS = ["row_id", "quantity", "status", "label", "category"]


def _half_sql(name: str, part: int) -> str:
    return _profile_sql(name, "", _HALF_COLUMNS, "row_id", ["status", "category"], "label", "category").strip()


@query("A2_compare", f"WITH {sql.FLOWS}, h0 AS (SELECT {', '.join(_HALF_COLUMNS)} FROM flows WHERE is_open = 0), h1 AS (SELECT {', '.join(_HALF_COLUMNS)} FROM flows WHERE is_open = 1), p0 AS ({_half_sql('h0', 0)}), p1 AS ({_half_sql('h1', 1)}) SELECT coalesce(p0.section, p1.section) AS section, coalesce(p0.name, p1.name) AS name, p0.value AS first, p1.value AS second FROM p0 FULL JOIN p1 ON p0.section = p1.section AND p0.name = p1.name")
def _(s, d):
    f = flows(s, d)
    a, b = (f.where(F.col("is_open") == k).select(*_HALF_COLUMNS) for k in (0, 1))
    return profile.compare(a, b, "row_id", "label", "category")


@query("A7_compact", f"WITH {_SEEDED} SELECT model, metric, count(value) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0.0), 4) AS std_sample, round(stddev_pop(value), 4) AS std_pop FROM tall GROUP BY model, metric")
def _(s, d):
    return summaries.over_seeds(_seed_runs(s, d), ["model", "metric"], digits=4)


_SIZED = f"{sql.LONG}, runs AS (SELECT model, split_part(row_id, ':', 4)::INT * 500 AS n_train, split_part(row_id, ':', 3)::INT % 3 AS feature_set, ('0x' || substr(md5('seed:' || row_id), 1, 6))::BIGINT % 5 AS seed, count_if(y = pred) / count(*)::DOUBLE AS accuracy FROM long GROUP BY ALL)"


def _sized_runs(s, d):
    parts = F.split("row_id", ":")
    seed = F.conv(F.substring(F.md5(F.concat(F.lit("seed:"), F.col("row_id")).cast("binary")), 1, 6), 16, 10).cast("long") % 5
    return long_scored(s, d).groupBy("model", (parts[3].cast("int") * 500).alias("n_train"), (parts[2].cast("int") % 3).alias("feature_set"), seed.alias("seed")).agg((count_if(F.col("y") == F.col("pred")) / F.count("*")).alias("value"))


@query("A8_learning_curve", f"WITH {_SIZED} SELECT model, n_train, count(*) AS n, round(avg(accuracy), 6) AS mean, round(coalesce(stddev_samp(accuracy), 0.0), 6) AS std_sample, round(stddev_pop(accuracy), 6) AS std_pop FROM runs GROUP BY model, n_train")
def _(s, d):
    return summaries.over_seeds(_sized_runs(s, d), ["model", "n_train"])


@query("A9_grid_cells", f"WITH {_SIZED} SELECT model, n_train, feature_set, count(*) AS n, round(avg(accuracy), 6) AS mean, round(coalesce(stddev_samp(accuracy), 0.0), 6) AS std_sample, round(stddev_pop(accuracy), 6) AS std_pop FROM runs GROUP BY ALL")
def _(s, d):
    return summaries.over_seeds(_sized_runs(s, d), ["model", "n_train", "feature_set"])


@query("A11_feature_spaces", f"WITH {_SIZED} SELECT model, feature_set, count(*) AS n, round(avg(accuracy), 4) AS mean, round(coalesce(stddev_samp(accuracy), 0.0), 4) AS std_sample, round(stddev_pop(accuracy), 4) AS std_pop FROM runs GROUP BY ALL")
def _(s, d):
    return summaries.over_seeds(_sized_runs(s, d), ["model", "feature_set"], digits=4)


@query("A12_majority", f"WITH {sql.SCORED} SELECT (svm_pred + rf_pred + qsvc_pred >= 2)::INT AS vote, y, count(*) AS n FROM scored GROUP BY ALL")
def _(s, d):
    return scored(s, d).groupBy(agreement.majority(*(F.col(f"{m}_pred") for m in MODELS)).alias("vote"), "y").agg(F.count("*").alias("n"))


@query("A13_selection_frequency", "SELECT l_returnflag AS name, count(DISTINCT l_linenumber % 5) AS folds, round(count(DISTINCT l_linenumber % 5) / 5.0::DOUBLE, 4) AS frequency FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    picks = table(s, d, "lineitem").groupBy((F.col("l_linenumber") % 5).alias("fold")).agg(F.collect_set("l_returnflag").alias("names"))
    return select.selection_frequency(picks, 5)


@query("A14_run_counts", "SELECT count(*) AS runs, count_if(o_orderstatus = 'F')::BIGINT AS succeeded, count_if(o_orderstatus <> 'F')::BIGINT AS failed FROM orders")
def _(s, d):
    return summaries.run_counts(table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")))


# --- order statistics and ranks ----------------------------------------------------------------------------------

@query("W3_order_statistic", f"WITH {sql.LONG}, {sql.cumulative('neg_long', 'model').replace('per AS', 'neg_long AS (SELECT * FROM long WHERE y = 0), per AS', 1)} SELECT model, round(max(CASE WHEN neg_below <= all_neg - 10 AND all_neg - 10 < neg_below + neg THEN score END), 6) AS tenth_highest FROM cum GROUP BY model")
def _(s, d):
    c = metrics.cumulative(long_scored(s, d).where("y = 0"), ["model"])
    hit = (F.col("neg_below") <= F.col("all_neg") - 10) & (F.col("all_neg") - 10 < F.col("neg_below") + F.col("neg"))
    return c.groupBy("model").agg(F.round(F.max(F.when(hit, F.col("score"))), 6).alias("tenth_highest"))


@query("W4_suffix_counts", f"WITH {sql.LONG}, c AS (SELECT model, (floor(score * 100) / 100.0::DOUBLE) AS score, count_if(y = 0) AS neg FROM long GROUP BY 1, 2) SELECT model, score, (sum(neg) OVER (PARTITION BY model ORDER BY score DESC))::BIGINT AS at_least FROM c")
def _(s, d):
    coarse = long_scored(s, d).withColumn("score", F.floor(F.col("score") * 100) / F.lit(100.0))
    return metrics.cumulative(coarse, ["model"]).select("model", "score", (F.col("all_neg") - F.col("neg_below")).alias("at_least"))


@query("W6_average_ranks", f"WITH {sql.FLOWS} SELECT row_id, 'quantity' AS name, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0::DOUBLE AS rank FROM flows")
def _(s, d):
    return select.average_ranks(flows(s, d), ["quantity"], "row_id")


_GRID = "WITH g AS (SELECT l_suppkey % 7 AS grp, l_linenumber AS grid_pos, l_tax AS c, avg(l_discount) AS f1 FROM lineitem GROUP BY ALL)"


def _grid(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 7).alias("grp"), F.col("l_linenumber").alias("grid_pos"), F.col("l_tax").alias("c")).agg(F.avg("l_discount").alias("f1"))


@query("W7_candidate", f"{_GRID}, r AS (SELECT grp, c, round(f1, 3) AS f1, grid_pos FROM g) SELECT grp, c, f1 FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, c) AS k FROM r) WHERE k = 1")
def _(s, d):
    return summaries.best_candidate(_grid(s, d).withColumn("f1", F.round("f1", 3)), ["grp"]).select("grp", "c", "f1")


@query("W8_grid_argmax_unrounded", "WITH g AS (SELECT l_suppkey % 7 AS grp, l_linenumber AS grid_pos, max(l_discount) AS f1 FROM lineitem GROUP BY ALL) SELECT grp, grid_pos FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, grid_pos) AS k FROM g) WHERE k = 1")
def _(s, d):
    g = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("grp"), F.col("l_linenumber").alias("grid_pos")).agg(F.max("l_discount").alias("f1"))
    return summaries.best_of_grid(g, ["grp"]).select("grp", "grid_pos")


@query("W5_threshold_rank", f"WITH {sql.LONG} SELECT model, rank, nominal_rank FROM ({sql.thresholds('long', 'model', 0.02)})")
def _(s, d):
    return metrics.thresholds(long_scored(s, d), ["model"], 0.02).select("model", "rank", "nominal_rank")


@query("W9_grid_argmax", "WITH g AS (SELECT l_suppkey % 7 AS grp, l_linenumber AS grid_pos, avg(l_discount) AS f1 FROM lineitem GROUP BY ALL) SELECT grp, grid_pos FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(f1, 4) DESC, grid_pos) AS k FROM g) WHERE k = 1")
def _(s, d):
    g = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("grp"), F.col("l_linenumber").alias("grid_pos")).agg(F.avg("l_discount").alias("f1"))
    return summaries.best_of_grid(g, ["grp"], 4).select("grp", "grid_pos")


_P = "p AS (SELECT l_suppkey % 5 AS family, l_partkey % 11 AS name, avg(l_discount) / 2 AS p FROM lineitem GROUP BY 1, 2)"


@query("W10_holm", f"WITH {_P}, s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p) AS step FROM p) SELECT family, name, round(max(step) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s")
def _(s, d):
    p = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("family"), (F.col("l_partkey") % 11).alias("name")).agg((F.avg("l_discount") / 2).alias("p"))
    return inference.holm(p, ["family"]).select("family", "name", "p_holm")


@query("W11_percentiles", f"WITH {sql.LONG} SELECT model, round(quantile_cont(score, 0.025), 6) AS lower, round(quantile_cont(score, 0.975), 6) AS upper, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS se FROM long GROUP BY model")
def _(s, d):
    got = inference.large_interval(long_scored(s, d), ["model"], "score")
    return got.select("model", *(F.round(c, 6).alias(c) for c in ("lower", "upper", "mean", "se")))


# --- sets, samples, partitions -----------------------------------------------------------------------------------

@query("S1_dedup_documents", "SELECT min(doc_id) AS doc_id, text, lang, source, n_chars FROM documents GROUP BY text, lang, source, n_chars")
def _(s, d):
    docs = table(s, d, "documents")
    return prepare.dedup(docs, "doc_id")


@query("S1_dedup_report", "SELECT count(*) AS rows_before, count(*) - count(DISTINCT (text, lang, source, n_chars)) AS removed, round(100.0::DOUBLE * (count(*) - count(DISTINCT (text, lang, source, n_chars))) / count(*), 2) AS pct_removed FROM documents")
def _(s, d):
    return prepare.dedup_report(table(s, d, "documents"), "doc_id")


@query("S2_stratified_sample", f"WITH {sql.FLOWS} SELECT row_id, label FROM {sql.ranked('flows', 42)} JOIN {sql.quota('flows', 1000)} USING (label) WHERE place < q")
def _(s, d):
    return split.sample(flows(s, d), 1000, "row_id", "label", 42).select("row_id", "label")


BOUNDED = {"train": 100, "validation": 50, "test": 100}


def _partitions_sql(sizes: dict[str, int] | None = None) -> str:
    """Consecutive quotas of what each split leaves."""
    sizes = sizes or SIZES
    parts, names = [sql.FLOWS, f"r AS {sql.ranked('flows', 42)}", "left0 AS (SELECT label, count(*) AS c, 0::BIGINT AS start FROM flows GROUP BY label)"], list(sizes)
    for i, (name, n) in enumerate(sizes.items()):
        parts.append(f"x{i} AS (SELECT *, {n}.0::DOUBLE * c / sum(c) OVER () AS x, floor({n}.0::DOUBLE * c / sum(c) OVER ())::BIGINT AS f FROM left{i})")
        parts.append(f"q{i} AS (SELECT label, c, start, (f + (row_number() OVER (ORDER BY x - f DESC, label) <= {n} - sum(f) OVER ())::BIGINT)::BIGINT AS q FROM x{i})")
        parts.append(f"left{i + 1} AS (SELECT label, c - q AS c, start + q AS start FROM q{i})")
    picks = " UNION ALL ".join(f"SELECT row_id, label, '{name}' AS split FROM r JOIN q{i} USING (label) WHERE place >= start AND place < start + q" for i, name in enumerate(names))
    return f"WITH {', '.join(parts)} {picks}"


@query("S3_partitions", _partitions_sql())
def _(s, d):
    return split.partitions(flows(s, d), SIZES, "row_id", "label", 42).select("row_id", "label", "split")


@query("J5_overlaps", f"WITH a AS ({_partitions_sql()}) SELECT row_id, count(DISTINCT split) AS splits FROM a GROUP BY row_id HAVING count(DISTINCT split) > 1")
def _(s, d):
    return split.overlaps(split.partitions(flows(s, d), SIZES, "row_id", "label", 42), "row_id")


@query("S4_bounded", _partitions_sql(BOUNDED))
def _(s, d):
    return split.bounded_partitions(flows(s, d), *BOUNDED.values(), "row_id", "label", 42).select("row_id", "label", "split")


@query("S5_two_samples", f"WITH {sql.FLOWS}, a AS (SELECT * FROM flows WHERE is_open = 1), b AS (SELECT * FROM flows WHERE is_open = 0) SELECT 'train' AS part, row_id FROM {sql.ranked('a', 42)} JOIN {sql.quota('a', 300)} USING (label) WHERE place < q UNION ALL SELECT 'test', row_id FROM {sql.ranked('b', 42)} JOIN {sql.quota('b', 200)} USING (label) WHERE place < q")
def _(s, d):
    f = flows(s, d)
    a, b = split.sample(f.where("is_open = 1"), 300, "row_id", "label", 42), split.sample(f.where("is_open = 0"), 200, "row_id", "label", 42)
    return a.select(F.lit("train").alias("part"), "row_id").unionByName(b.select(F.lit("test").alias("part"), "row_id"))


@query("S6_then_remainder", f"WITH {sql.FLOWS}, first AS (SELECT row_id FROM {sql.ranked('flows', 42)} JOIN {sql.quota('flows', 100)} USING (label) WHERE place < q), rest AS (SELECT * FROM flows WHERE row_id NOT IN (SELECT row_id FROM first)) SELECT row_id FROM {sql.ranked('rest', 43)} JOIN {sql.quota('rest', 50)} USING (label) WHERE place < q")
def _(s, d):
    f = flows(s, d)
    rest = split.remainder(f, split.sample(f, 100, "row_id", "label", 42), "row_id")
    return split.sample(rest, 50, "row_id", "label", 43).select("row_id")


@query("S9_cv_subsample", f"WITH {sql.FLOWS} SELECT row_id, label FROM {sql.ranked('flows', 42)} JOIN {sql.quota('flows', 5000)} USING (label) WHERE place < q")
def _(s, d):
    return split.sample(flows(s, d), 5000, "row_id", "label", 42).select("row_id", "label")


@query("S7_validation_split", f"WITH {sql.FLOWS}, sizes AS (SELECT label, count(*) AS size FROM flows GROUP BY label) SELECT row_id, CASE WHEN place < ceil(0.2::DOUBLE * size) THEN 'validation' ELSE 'train' END AS split FROM {sql.ranked('flows', 42)} JOIN sizes USING (label)")
def _(s, d):
    return split.fraction_split(flows(s, d), 0.2, "row_id", "label", 42).select("row_id", "split")


@query("S8_folds", f"WITH {sql.FLOWS} SELECT row_id, (place % 5)::INT AS fold FROM {sql.ranked('flows', 42)}")
def _(s, d):
    return split.folds(flows(s, d), 5, "row_id", "label", 42).select("row_id", "fold")


@query("S10_union_predictions", f"WITH {sql.LONG} SELECT model, count(*) AS n, sum(pred)::BIGINT AS alarms FROM long GROUP BY model")
def _(s, d):
    base = scored(s, d)
    frames = [base.select("row_id", F.lit(m).alias("model"), F.col(f"{m}_pred").alias("pred")) for m in MODELS]
    return summaries.union_all(frames).groupBy("model").agg(F.count("*").alias("n"), F.sum("pred").alias("alarms"))


def _poisson_sql(resamples: int) -> str:
    u, total, p, steps = sql.uniform("'boot'", "resample", "row_id"), 0.0, math.exp(-1.0), []
    for k in range(1, 8):
        total += p
        steps.append(total)
        p /= k
    w = " + ".join(f"({u} >= {x!r}::DOUBLE)::INT" for x in steps)
    sums = " UNION ALL ".join(f"SELECT resample, sum(w)::BIGINT AS n, '{m}' AS model, sum(w * ({m}_pred = y)::INT)::BIGINT AS right FROM rw GROUP BY resample" for m in MODELS)
    return f"WITH {sql.SCORED}, rw AS MATERIALIZED (SELECT resample, y, svm_pred, rf_pred, qsvc_pred, {w} AS w FROM scored, (SELECT unnest(range({resamples}))::INT AS resample)) {sums.replace('AS right', 'AS \"right\"')}"


@query("S11_poisson_bootstrap", _poisson_sql(20))
def _(s, d):
    return inference.poisson_counts(scored(s, d), 20)


@query("S12_landmarks", f"SELECT vec_id FROM embeddings ORDER BY {sql.uniform(repr('7'), 'vec_id')}, vec_id LIMIT 16")
def _(s, d):
    return split.landmarks(table(s, d, "embeddings").select("vec_id"), 16, "vec_id", 7)


@query("W13_prefix", f"WITH {sql.FLOWS} SELECT label, count(*) AS n, min(row_id) AS least FROM {sql.ranked('flows', 42)} WHERE place < 250 GROUP BY label")
def _(s, d):
    return split.ranked(flows(s, d), "row_id", "label", 42, {0: 250, 1: 250}).where("place < 250").groupBy("label").agg(F.count("*").alias("n"), F.min("row_id").alias("least"))


# --- preparation and selection -----------------------------------------------------------------------------------

@query("F2_standard_scores", f"WITH {sql.FLOWS}, m AS (SELECT avg(quantity) AS qm, stddev_pop(quantity) AS qs, avg(discount) AS dm, stddev_pop(discount) AS ds FROM flows) SELECT row_id, round((quantity - qm) / qs, 6) AS quantity, round((discount - dm) / ds, 6) AS discount FROM flows, m")
def _(s, d):
    f = flows(s, d).select("row_id", "quantity", "discount")
    return prepare.Scaler(f, ["quantity", "discount"], skewed=float("inf")).transform(f).select("row_id", F.round("quantity", 6).alias("quantity"), F.round("discount", 6).alias("discount"))


def _prepared_sql() -> str:
    """Standard scores fitted on the training part, of logarithms for skewed columns that are never negative, and the training part's values of status."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, avg(ln(1 + {c})) AS lm_{c}, stddev_pop(ln(1 + {c})) AS ls_{c}, skewness({c}) > 1.5 AND min({c}) >= 0 AS h_{c}" for c in POOL)
    scaled = ", ".join(f"round(CASE WHEN h_{c} THEN (ln(1 + {c}) - lm_{c}) / CASE WHEN ls_{c} = 0 THEN 1 ELSE ls_{c} END ELSE ({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END END, 6) AS {c}" for c in POOL)
    hot = ", ".join(f"(status = '{v}')::INT::DOUBLE AS \"status={v}\"" for v in ("F", "O"))
    return f"""WITH {sql.FLOWS}, sizes AS (SELECT label, count(*) AS size FROM flows GROUP BY label), dealt AS (SELECT r.*, place < ceil(0.2::DOUBLE * size) AS held FROM {sql.ranked('flows', 42)} r JOIN sizes USING (label)),
m AS (SELECT {stats} FROM dealt WHERE NOT held) SELECT row_id, label, {scaled}, {hot} FROM dealt, m WHERE held"""


@query("F1_prepare", _prepared_sql())
def _(s, d):
    dealt = split.fraction_split(flows(s, d), 0.2, "row_id", "label", 42)
    _, test = prepare.prepare(dealt.where("split = 'train'"), dealt.where("split = 'validation'"), POOL, ["status"], ("row_id", "label"))
    return test.withColumns({c: F.round(c, 6) for c in POOL})


@query("F3_angles", f"WITH {sql.FLOWS}, r AS (SELECT min(price) AS lo, max(price) AS hi, min(tax) AS tl, max(tax) AS th FROM flows) SELECT row_id, round(least(greatest((price - lo) / (hi - lo) * {math.pi!r}::DOUBLE, 0), {math.pi!r}::DOUBLE), 6) AS price, round(least(greatest((tax - tl) / (th - tl) * {math.pi!r}::DOUBLE, 0), {math.pi!r}::DOUBLE), 6) AS tax FROM flows, r")
def _(s, d):
    f = flows(s, d).select("row_id", "price", "tax")
    return prepare.AngleScaler(f, ["price", "tax"]).transform(f).select("row_id", F.round("price", 6).alias("price"), F.round("tax", 6).alias("tax"))


def _information_sql(source: str = "flows", prefix: str = "") -> str:
    """CTEs long, ends, n, t and b (name, mi) over a source, all with a prefix."""
    p, melt = prefix, " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS x, label AS y FROM {source}" for c in POOL)
    return f"""{p}long AS ({melt}), {p}ends AS (SELECT name, min(x) AS lo, max(x) AS hi FROM {p}long GROUP BY name),
{p}n AS (SELECT name, CASE WHEN hi > lo THEN least(15, floor((x - lo) / (hi - lo) * 16)) ELSE 0 END AS bin, y, count(*)::DOUBLE AS n FROM {p}long JOIN {p}ends USING (name) GROUP BY ALL),
{p}t AS (SELECT name, n / sum(n) OVER (PARTITION BY name) * ln(n * sum(n) OVER (PARTITION BY name) / (sum(n) OVER (PARTITION BY name, bin) * sum(n) OVER (PARTITION BY name, y))) AS term FROM {p}n),
{p}b AS MATERIALIZED (SELECT name, round(greatest(0.0, sum(term)), 6) AS mi FROM {p}t GROUP BY name)"""


def _binned_sql() -> str:
    return f"WITH {sql.FLOWS}, {_information_sql()} SELECT name, mi FROM b"


def _order_sql(prefix: str = "", source: str = "flows") -> str:
    """CTEs r, rho (a, b, rho, both ways) and ord (name, mi, pos) after those of _information_sql."""
    p, ranks = prefix, ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in POOL)
    one = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM {p}r" for a in sorted(POOL) for b in sorted(POOL) if a < b)
    return f"""{p}r AS MATERIALIZED (SELECT {ranks} FROM {source}), {p}one AS MATERIALIZED ({one}),
{p}rho AS (SELECT a, b, abs(coalesce(CASE WHEN isnan(rho) THEN 0 ELSE rho END, 0)) AS rho FROM {p}one UNION ALL SELECT b, a, abs(coalesce(CASE WHEN isnan(rho) THEN 0 ELSE rho END, 0)) FROM {p}one),
{p}ord AS MATERIALIZED (SELECT name, mi, row_number() OVER (ORDER BY mi DESC, name DESC) AS pos FROM {p}b)"""


def _pruned_sql(prefix: str = "", limit: float = select.STRICT) -> str:
    """CTEs k0 to k5: the names kept so far, in order."""
    p, parts = prefix, [f"{prefix}k0 AS (SELECT []::VARCHAR[] AS kept)"]
    for i in range(1, len(POOL) + 1):
        follows = f"(SELECT count(*) FROM {p}rho x WHERE x.a = o.name AND list_contains(k.kept, x.b) AND x.rho > {limit}) > 0"
        parts.append(f"{p}k{i} AS MATERIALIZED (SELECT CASE WHEN o.name IS NULL OR {follows} THEN k.kept ELSE list_append(k.kept, o.name) END AS kept FROM {p}k{i - 1} k LEFT JOIN {p}ord o ON o.pos = {i})")
    return ", ".join(parts)


def _picked_sql(k: int, quotient: bool = False, prefix: str = "", among: str | None = None) -> str:
    """CTEs p1 to pk: the names picked so far, in order."""
    p, parts = prefix, []
    pool = f"{p}ord" if among is None else f"(SELECT o.* FROM {p}ord o, {among} WHERE list_contains(kept, o.name))"
    worth = "o.mi / (avg(x.rho) + 1e-5)" if quotient else "o.mi - avg(x.rho)"
    parts.append(f"{p}p1 AS MATERIALIZED (SELECT [name] AS picked FROM {pool} ORDER BY pos LIMIT 1)")
    for i in range(2, k + 1):
        step = f"SELECT q.picked, o.name FROM {p}p{i - 1} q, {pool} o, {p}rho x WHERE NOT list_contains(q.picked, o.name) AND x.a = o.name AND list_contains(q.picked, x.b) GROUP BY q.picked, o.name, o.mi, o.pos ORDER BY {worth} DESC, o.pos LIMIT 1"
        parts.append(f"{p}s{i} AS MATERIALIZED ({step}), {p}p{i} AS MATERIALIZED (SELECT list_append(picked, name) AS picked FROM {p}s{i} UNION ALL SELECT picked FROM {p}p{i - 1} WHERE NOT EXISTS (SELECT 1 FROM {p}s{i}))")
    return ", ".join(parts)


@query("F6_binned_information", _binned_sql())
def _(s, d):
    return select.binned_information(flows(s, d), POOL, "label")


@query("W1_information_order", f"WITH b AS ({_binned_sql()}) SELECT name, mi, row_number() OVER (ORDER BY mi DESC, name DESC)::INT AS place FROM b QUALIFY place <= 15")
def _(s, d):
    top = select.by_information(select.binned_information(flows(s, d), POOL, "label")).limit(15).collect()  # one row a feature
    return s.createDataFrame([(r.name, r.mi, k + 1) for k, r in enumerate(top)], "name string, mi double, place int")


@query("F5_near_constant", f"WITH {sql.FLOWS}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, var_samp({c}) AS v, count(DISTINCT {c}) AS k FROM flows" for c in POOL) + ") SELECT name FROM r WHERE k > 1 AND v > 1e-5")
def _(s, d):
    return select.spread(flows(s, d), POOL).where("kept").select("name")


_SELECTION = f"WITH {sql.FLOWS}, {_information_sql()}, {_order_sql()}"


@query("F8_pruning", f"{_SELECTION}, {_pruned_sql()} SELECT (u.place - 1)::INT AS place, kept[u.place] AS name, mi FROM k{len(POOL)}, (SELECT unnest(range(1, len(kept) + 1)) AS place FROM k{len(POOL)}) u JOIN ord ON ord.name = kept[u.place]")
def _(s, d):
    f = flows(s, d)
    mi = {r.name: r.mi for r in select.binned_information(f, POOL, "label").collect()}
    kept, _ = select.prune(mi, select.rho_table(select.spearman(f, POOL).collect()))
    return s.createDataFrame([(k, n, mi[n]) for k, n in enumerate(kept)], "place int, name string, mi double")


@query("F9_mrmr", f"{_SELECTION}, {_picked_sql(4)}, {_picked_sql(4, True).replace('p1', 'v1').replace('p2', 'v2').replace('p3', 'v3').replace('p4', 'v4').replace('s2', 'w2').replace('s3', 'w3').replace('s4', 'w4')} SELECT 'difference' AS rule, unnest(range(len(picked)))::INT AS place, unnest(picked) AS name FROM p4 UNION ALL SELECT 'quotient', unnest(range(len(picked)))::INT, unnest(picked) FROM v4")
def _(s, d):
    f = flows(s, d)
    mi = {r.name: r.mi for r in select.binned_information(f, POOL, "label").collect()}
    rho = select.rho_table(select.spearman(f, POOL).collect())
    return s.createDataFrame([(rule, k, n) for rule, q in (("difference", False), ("quotient", True)) for k, n in enumerate(select.mrmr(mi, rho, 4, q))], "rule string, place int, name string")


@query("F11_stability")
def _(s, d):
    rows = select.stability(flows(s, d), POOL, "label", "row_id", 3)
    return s.createDataFrame([(r["name"], r["folds"], r["frequency"]) for r in rows], "name string, folds int, frequency double")


@query("F10_selection_binned", f"{_SELECTION}, {_pruned_sql()}, {_picked_sql(4, among=f'k{len(POOL)}')} SELECT place, p.name, mi FROM (SELECT unnest(range(len(picked)))::INT AS place, unnest(picked) AS name FROM p4) p JOIN ord USING (name)")
def _(s, d):
    got = select.select_features(flows(s, d), POOL, "label", "row_id", 4, binned=True)
    return s.createDataFrame([(k, n, float(got["mi"][n])) for k, n in enumerate(got["selected"])], "place int, name string, mi double")


def _stability_sql(k: int, folds: int = 5) -> str:
    parts, picks = [], []
    for f in range(folds):
        p = f"f{f}_"
        parts += [f"{p}rows AS (SELECT * FROM dealt WHERE fold <> {f})", _information_sql(f"{p}rows", p), _order_sql(p, f"{p}rows"), _pruned_sql(p), _picked_sql(k, prefix=p, among=f"{p}k{len(POOL)}")]
        picks.append(f"SELECT unnest(picked) AS name FROM {p}p{k}")
    return f"WITH {sql.FLOWS}, dealt AS MATERIALIZED (SELECT *, place % {folds} AS fold FROM {sql.ranked('flows', 42)}), {', '.join(parts)} SELECT name, count(*)::INT AS folds, round(count(*) / {folds}.0::DOUBLE, 4) AS frequency FROM ({' UNION ALL '.join(picks)}) GROUP BY name"


@query("F11_stability_binned", _stability_sql(3))
def _(s, d):
    rows = select.stability(flows(s, d), POOL, "label", "row_id", 3, binned=True)
    return s.createDataFrame([(r["name"], r["folds"], r["frequency"]) for r in rows], "name string, folds int, frequency double")


@query("F6_neighbour_information")
def _(s, d):
    return select.by_information(select.neighbour_information(flows(s, d), POOL, "label", "row_id"))


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NUMERIC)


@query("F7_spearman", f"WITH {sql.FLOWS}, r AS (SELECT {_RANKS} FROM flows) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM r" for a in sorted(NUMERIC) for b in sorted(NUMERIC) if a < b))
def _(s, d):
    return select.spearman(flows(s, d), NUMERIC)


@query("F10_selection")
def _(s, d):
    got = select.select_features(flows(s, d), POOL, "label", "row_id", 4)
    return s.createDataFrame([(k, n, float(got["mi"][n])) for k, n in enumerate(got["selected"])], "place int, name string, mi double")


# --- kernels -----------------------------------------------------------------------------------------------------

def _angles(s, d) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate(ANGLES)))
    return prepare.AngleScaler(e, ANGLES).transform(e)


def _states_sql() -> str:
    ends = ", ".join(f"min(embedding[{k + 1}]::DOUBLE) AS lo{k}, max(embedding[{k + 1}]::DOUBLE) AS hi{k}" for k in range(4))
    pi = f"{math.pi!r}::DOUBLE"
    xs = ", ".join(f"least(greatest((embedding[{k + 1}]::DOUBLE - lo{k}) / (hi{k} - lo{k}) * {pi}, 0), {pi}) AS x{k}" for k in range(4))
    phis = []
    for j in range(16):
        bit = [(j >> k) & 1 for k in range(4)]
        terms = [f"2 * x{k}" for k in range(4) if bit[k]] + [f"2 * ({pi} - x{k}) * ({pi} - x{k + 1})" for k in range(3) if bit[k] ^ bit[k + 1]]
        phis.append(" + ".join(terms) or "0.0::DOUBLE")
    sign = kernel._signs(4)
    mixed = lambda v: ", ".join("(" + " ".join(f"{'+' if s > 0 else '-'} {v}[{k + 1}]" for k, s in enumerate(r)) + ") / 4" for r in sign)
    return f"""ends AS (SELECT {ends} FROM embeddings), xs AS (SELECT vec_id, {xs} FROM embeddings, ends),
phis AS (SELECT vec_id, [{', '.join(phis)}] AS phi FROM xs), first AS (SELECT vec_id, phi, [cos(p) / 4 FOR p IN phi] AS c, [sin(p) / 4 FOR p IN phi] AS s FROM phis),
mix AS (SELECT vec_id, phi, [{mixed('c')}] AS p, [{mixed('s')}] AS m FROM first),
psi AS (SELECT vec_id, [p[i] * cos(phi[i]) - m[i] * sin(phi[i]) FOR i IN range(1, 17)] AS re, [p[i] * sin(phi[i]) + m[i] * cos(phi[i]) FOR i IN range(1, 17)] AS im FROM mix)"""


@query("K2_states", f"WITH {_states_sql()} SELECT vec_id, round(re[1], 6) AS re0, round(im[6], 6) AS im5, round(list_sum([a * a FOR a IN re]) + list_sum([a * a FOR a IN im]), 6) AS norm FROM psi")
def _(s, d):
    e = kernel.embed(_angles(s, d), ANGLES, fast=False)
    norm = F.aggregate("re", F.lit(0.0), lambda t, x: t + x * x) + F.aggregate("im", F.lit(0.0), lambda t, x: t + x * x)
    return e.select("vec_id", F.round(F.col("re")[0], 6).alias("re0"), F.round(F.col("im")[5], 6).alias("im5"), F.round(norm, 6).alias("norm"))


_MARKS = f"marks AS (SELECT vec_id AS mark, re AS r2, im AS i2 FROM psi ORDER BY {sql.uniform(repr('7'), 'vec_id')}, vec_id LIMIT 16)"
_DOTS = "(list_dot_product(re, r2) + list_dot_product(im, i2)) AS a, (list_dot_product(re, i2) - list_dot_product(im, r2)) AS b"


@query("K4_kernel_rows", f"WITH {_states_sql()}, {_MARKS}, k AS (SELECT vec_id, mark, {_DOTS} FROM psi, marks) SELECT vec_id, mark, round(least(greatest(a * a + b * b, 0), 1), 5) AS k FROM k")
def _(s, d):
    e = kernel.embed(_angles(s, d), ANGLES)
    return kernel.kernel_rows(e, split.landmarks(e, 16, "vec_id", 7), "vec_id").withColumn("k", F.round("k", 5))


@query("J6_kernel_entries", f"WITH {_states_sql()}, {_MARKS.replace('LIMIT 16', 'LIMIT 64')}, k AS (SELECT p.vec_id AS i, mark AS j, {_DOTS} FROM psi p JOIN marks q ON true WHERE p.vec_id IN (SELECT mark FROM marks)) SELECT i, j, round(least(greatest(a * a + b * b, 0), 1), 5) AS k FROM k")
def _(s, d):
    # All pairs of a sample, whose size is the feature.
    marks = split.landmarks(kernel.embed(_angles(s, d), ANGLES), 64, "vec_id", 7)
    return kernel.kernel_rows(marks, marks, "vec_id").select(F.col("vec_id").alias("i"), F.col("mark").alias("j"), F.round("k", 5).alias("k"))


@query("K7_explicit_map", f"WITH {_states_sql()}, {_MARKS}, k AS (SELECT vec_id, mark, {_DOTS} FROM psi, marks) SELECT vec_id, round(sum(a * a + b * b), 4) AS k_sum FROM k GROUP BY vec_id")
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    m = kernel.mapped(_angles(s, d), ANGLES).select("vec_id", vector_to_array("features").alias("f"))
    marks = split.landmarks(m, 16, "vec_id", 7).select(F.col("f").alias("g"))
    total = marks.agg(F.array(*(F.sum(F.col("g")[i]) for i in range(256))).alias("t"))
    dot = F.aggregate(F.zip_with("f", "t", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return m.crossJoin(F.broadcast(total)).select("vec_id", F.round(dot, 4).alias("k_sum"))  # rows by one row of sums


@query("K8_nystrom")
def _(s, d):
    sample = split.landmarks(_angles(s, d), 100, "vec_id", 7)
    x = np.array([[r[a] for a in ANGLES] for r in sample.orderBy("vec_id").collect()])
    k = kernel.fidelity(kernel.states(x))
    rows = [kernel.nystrom_errors(k, m) for m in (5, 10, 20, 50, 100) if m <= len(k)]
    return s.createDataFrame([(r["m"], r["frobenius"], r["spectral"], r["condition"]) for r in rows], "m int, frobenius double, spectral double, condition double")


@query("K11_entry_invariants", f"WITH {_states_sql()}, {_MARKS}, k AS (SELECT p.vec_id AS i, mark AS j, {_DOTS} FROM psi p JOIN marks q ON true WHERE p.vec_id IN (SELECT mark FROM marks)), e AS (SELECT i, j, least(greatest(a * a + b * b, 0), 1) AS k FROM k) SELECT count(*) AS entries, round(max(CASE WHEN e.i = e.j THEN abs(e.k - 1) END), 6) AS diagonal, round(max(abs(e.k - f.k)), 6) AS asymmetry, sum(CASE WHEN f.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS unpaired, round(min(e.k), 6) AS low, round(max(e.k), 6) AS high FROM e LEFT JOIN e f ON e.i = f.j AND e.j = f.i")
def _(s, d):
    e = kernel.embed(_angles(s, d), ANGLES)
    marks = split.landmarks(e, 16, "vec_id", 7)
    entries = kernel.kernel_rows(marks, marks, "vec_id").select(F.col("vec_id").alias("i"), F.col("mark").alias("j"), "k")
    return kernel.entry_invariants(entries)


@query("K5_gram", f"WITH {_states_sql()}, {_MARKS}, k AS (SELECT p.vec_id AS i, mark AS j, {_DOTS} FROM psi p JOIN marks q ON true WHERE p.vec_id IN (SELECT mark FROM marks)) SELECT i, j, round(least(greatest(a * a + b * b, 0), 1), 5) AS k FROM k")
def _(s, d):
    marks = split.landmarks(kernel.embed(_angles(s, d), ANGLES), 16, "vec_id", 7)
    return kernel.kernel_rows(marks, marks, "vec_id").select(F.col("vec_id").alias("i"), F.col("mark").alias("j"), F.round("k", 5).alias("k"))


@query("K12_cross_check")
def _(s, d):
    x = np.array([[r[a] for a in ANGLES] for r in split.landmarks(_angles(s, d), 50, "vec_id", 7).orderBy("vec_id").collect()])  # 50 landmarks
    psi = kernel.states(x)
    f, k = kernel.explicit_map(psi), kernel.fidelity(psi)
    got = kernel.invariants(k)
    return s.createDataFrame([("explicit map", float(np.abs(f @ f.T - k).max())), ("diagonal", got["diagonal"]), ("asymmetry", got["asymmetry"]), ("least eigenvalue", got["least_eigenvalue"])], "item string, value double")


# --- metrics, curves, thresholds ---------------------------------------------------------------------------------

@query("E1_evaluate", f"WITH {sql.LONG}, c AS (SELECT model, {sql.CELLS} FROM long GROUP BY model), {sql.cumulative('long', 'model')}, a AS (SELECT model, {sql.auc()} FROM cum GROUP BY model) SELECT model, tn, fp, fn, tp, {sql.rates(6)}, auc FROM c JOIN a USING (model)")
def _(s, d):
    return metrics.evaluate(long_scored(s, d), ["model"])


def _report_sql() -> str:
    cls = []
    for name, hit, wrong, missed in (("0", "tn", "fn", "fp"), ("1", "tp", "fp", "fn")):
        p, r = sql.rate(hit, f"{hit} + {wrong}"), sql.rate(hit, f"{hit} + {missed}")
        cls.append(f"SELECT model, '{name}' AS class, {p} AS p, {r} AS r, {hit} + {missed} AS support FROM c")
    f1 = "CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END"
    return f"""WITH {sql.LONG}, c AS (SELECT model, {sql.CELLS} FROM long GROUP BY model), k AS (SELECT *, {f1} AS f FROM ({' UNION ALL '.join(cls)})),
r AS (SELECT model, class, p, r, f, support FROM k UNION ALL SELECT model, 'macro', avg(p), avg(r), avg(f), sum(support) FROM k GROUP BY model
 UNION ALL SELECT model, 'weighted', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM k GROUP BY model)
SELECT model, class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM r"""


@query("E2_class_report", _report_sql())
def _(s, d):
    r = metrics.class_report(long_scored(s, d), ["model"])
    return r.select("model", "class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("E3_compact", f"WITH {sql.LONG}, c AS (SELECT model, {sql.CELLS} FROM long GROUP BY model), {sql.cumulative('long', 'model')}, a AS (SELECT model, {sql.auc(4)} FROM cum GROUP BY model) SELECT model, {sql.rates(4)}, auc FROM c JOIN a USING (model)")
def _(s, d):
    return metrics.evaluate(long_scored(s, d), ["model"], digits=4).drop("tn", "fp", "fn", "tp")


@query("E5_single_class", f"WITH {sql.LONG} SELECT model, NULL::DOUBLE AS auc, NULL::DOUBLE AS pauc FROM long WHERE y = 0 GROUP BY model")
def _(s, d):
    one = long_scored(s, d).where("y = 0")
    return metrics.auc(one, ["model"]).join(metrics.partial_auc(one, ["model"]), "model")


@query("E4_auc", f"WITH {sql.LONG}, {sql.cumulative('long', 'model')} SELECT model, {sql.auc()} FROM cum GROUP BY model")
def _(s, d):
    return metrics.auc(long_scored(s, d), ["model"])


@query("E6_partial_auc", f"WITH {sql.LONG}, {sql.cumulative('long', 'model')} SELECT model, {sql.pauc()} FROM cum GROUP BY model")
def _(s, d):
    return metrics.partial_auc(long_scored(s, d), ["model"])


@query("E7_roc", f"WITH {sql.LONG}, coarse AS (SELECT model, y, round(score, 3) AS score FROM long), {sql.cumulative('coarse', 'model')} SELECT model, score AS threshold, all_neg - neg_below AS fp, all_pos - pos_below AS tp, round((all_neg - neg_below) / all_neg::DOUBLE, 6) AS fpr, round((all_pos - pos_below) / all_pos::DOUBLE, 6) AS tpr FROM cum")
def _(s, d):
    r = metrics.roc(long_scored(s, d).withColumn("score", F.round("score", 3)), ["model"])
    return r.withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


def _operational_sql() -> str:
    parts = []
    for t in (0.01, 0.02):
        parts.append(f"SELECT model, target_fpr, threshold FROM ({sql.thresholds('cal', 'model', t)})")
    return f"""WITH {sql.LONG}, halves AS (SELECT *, {sql.uniform("'half'", 'row_id')} < 0.5 AS in_cal FROM long), cal AS (SELECT * FROM halves WHERE in_cal), test AS (SELECT * FROM halves WHERE NOT in_cal),
t AS ({' UNION ALL '.join(parts)}), judged AS (SELECT model, y, target_fpr, threshold, (score >= threshold)::INT AS pred FROM test JOIN t USING (model)),
c AS (SELECT model, target_fpr, threshold, {sql.CELLS} FROM judged GROUP BY ALL), {sql.cumulative('test', 'model')}, a AS (SELECT model, {sql.auc(4)}, {sql.pauc(4)} FROM cum GROUP BY model)
SELECT model, target_fpr, threshold, tn, fp, fn, tp, {sql.rates(4)}, auc, pauc FROM c JOIN a USING (model)"""


@query("E8_operational", _operational_sql())
def _(s, d):
    halves = long_scored(s, d).withColumn("in_cal", uniform("half", F.col("row_id")) < 0.5)
    return metrics.operational(halves.where("in_cal"), halves.where("not in_cal"), ["model"])


@query("E9_threshold", f"WITH {sql.LONG} SELECT * FROM ({sql.thresholds('long', 'model', 0.01)})")
def _(s, d):
    return metrics.thresholds(long_scored(s, d), ["model"], 0.01)


@query("E10_both_thresholds", f"WITH {sql.LONG} SELECT * FROM ({sql.thresholds('long', 'model', 0.01)}) UNION ALL SELECT * FROM ({sql.thresholds('long', 'model', 0.02)})")
def _(s, d):
    return metrics.thresholds(long_scored(s, d), ["model"], 0.01, 0.02)


# --- calibration -------------------------------------------------------------------------------------------------

@query("G1_brier", f"WITH {sql.LONG} SELECT model, round(avg((score - y) * (score - y)), 6) AS brier FROM long GROUP BY model")
def _(s, d):
    return calibrate.brier(long_scored(s, d), ["model"])


_EDGES = calibrate.edges(10)
_BIN = "CASE " + " ".join(f"WHEN score < '{e!r}'::DOUBLE THEN {k}" for k, e in enumerate(_EDGES[1:-1])) + " ELSE 9 END"
_RELIABLE = f"WITH {sql.LONG}, g AS (SELECT model, {_BIN} AS bin, count(*) AS n, avg(score) AS mp, avg(y) AS fp FROM long GROUP BY 1, 2)"


@query("G2_ece", f"{_RELIABLE} SELECT model, round(sum(abs(mp - fp) * n) / sum(n), 6) AS ece FROM g GROUP BY model")
def _(s, d):
    return calibrate.ece(long_scored(s, d), ["model"])


@query("G3_reliability", f"{_RELIABLE}, e AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{_EDGES[k]!r}'::DOUBLE, '{_EDGES[k + 1]!r}'::DOUBLE)" for k in range(10)) + ") t(bin, lo, hi)), m AS (SELECT DISTINCT model FROM long) SELECT model, bin, lo, hi, coalesce(n, 0)::BIGINT AS n, round(mp, 6) AS mean_predicted, round(fp, 6) AS fraction_positive FROM (SELECT * FROM m CROSS JOIN e) LEFT JOIN g USING (model, bin)")
def _(s, d):
    r = calibrate.reliability(long_scored(s, d), ["model"])
    return r.withColumns({c: F.round(c, 6) for c in ("mean_predicted", "fraction_positive")})


def _platt_sql(source: str, steps: int = 14) -> str:
    """CTEs c0 to c14 (slope, intercept): Newton's steps of the penalised logistic curve over a source (x, t)."""
    parts = ["c0 AS (SELECT 0.0::DOUBLE AS slope, 0.0::DOUBLE AS intercept)"]
    for k in range(1, steps + 1):
        rows = f"SELECT slope, intercept, x, t, 1 / (1 + exp(-(slope * x + intercept))) AS p FROM {source}, c{k - 1}"
        sums = f"SELECT any_value(slope) AS s, any_value(intercept) AS i, sum((p - t) * x) + any_value(slope) AS g0, sum(p - t) AS g1, sum(p * (1 - p) * x * x) + 1 AS a, sum(p * (1 - p) * x) AS b, sum(p * (1 - p)) + 1e-12 AS d FROM ({rows})"
        parts.append(f"c{k} AS MATERIALIZED (SELECT s - (d * g0 - b * g1) / (a * d - b * b) AS slope, i - (a * g1 - b * g0) / (a * d - b * b) AS intercept FROM ({sums}))")
    return ", ".join(parts)


_AUDIT = f"""WITH {sql.SCORED}, halves AS (SELECT y, rf_score AS score, {sql.uniform("'half'", 'row_id')} < 0.5 AS in_cal FROM scored), fitted AS (SELECT score AS x, y::DOUBLE AS t FROM halves WHERE in_cal), {_platt_sql('fitted')},
long AS (SELECT CASE WHEN in_cal THEN 'validation' ELSE 'test' END AS part, 'raw' AS kind, y, score FROM halves UNION ALL SELECT CASE WHEN in_cal THEN 'validation' ELSE 'test' END, 'calibrated', y, 1 / (1 + exp(-(slope * score + intercept))) FROM halves, c14),
g AS (SELECT part, kind, {_BIN} AS bin, count(*) AS n, avg(score) AS mp, avg(y) AS fp, sum((score - y) * (score - y)) AS sq FROM long GROUP BY 1, 2, 3)
SELECT part, kind, round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(mp - fp) * n) / sum(n), 6) AS ece FROM g GROUP BY part, kind"""


@query("G4_audit", _AUDIT)
def _(s, d):
    halves = scored(s, d).select("row_id", "y", F.col("rf_score").alias("score")).withColumn("in_cal", uniform("half", F.col("row_id")) < 0.5)
    return calibrate.audit(halves.where("in_cal"), halves.where("not in_cal"))


# --- paired inference --------------------------------------------------------------------------------------------

def _pair_counts(a: str, b: str) -> str:
    ra, rb = f"{a}_pred = y", f"{b}_pred = y"
    return f"SELECT '{a}' AS model_a, '{b}' AS model_b, count_if({ra} AND {rb})::BIGINT AS both_right, count_if({ra} AND NOT {rb})::BIGINT AS b, count_if(NOT {ra} AND {rb})::BIGINT AS c, count_if(NOT {ra} AND NOT {rb})::BIGINT AS both_wrong, count_if({a}_pred = {b}_pred)::BIGINT AS agree, count(*) AS n FROM scored"


_PAIRS = f"WITH {sql.SCORED}, p AS ({' UNION ALL '.join(_pair_counts(a, b) for a, b in agreement.PAIRS)})"


@query("H1_mcnemar", f"{_PAIRS} SELECT model_a, model_b, both_right, b, c, both_wrong, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1.0, 2) / (b + c)::DOUBLE END, 6) AS statistic FROM p")
def _(s, d):
    return inference.mcnemar(scored(s, d))


@query("H3_bootstrap")
def _(s, d):
    return inference.bootstrap(scored(s, d))


def _weights_sql() -> str:
    """Cumulative Poisson probabilities, each step one more."""
    total, p, steps = 0.0, math.exp(-1.0), []
    for k in range(1, 8):
        total += p
        steps.append(total)
        p /= k
    u = sql.uniform("'boot'", "resample", "row_id")
    return " + ".join(f"({u} >= {x!r}::DOUBLE)::INT" for x in steps)


def _paired_sql(resamples: int) -> str:
    each = " UNION ALL ".join(f"SELECT resample, '{m}' AS model, y, w, {m}_pred AS pred, greatest(0, least(511, floor({m}_score * 512)::INT)) AS bin FROM rw" for m in MODELS)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, x.metric, x.v - z.v AS difference FROM tall x JOIN tall z ON x.resample = z.resample AND x.metric = z.metric AND x.model = '{a}' AND z.model = '{b}'" for a, b in agreement.PAIRS)
    tall = " UNION ALL ".join(f"SELECT resample, model, '{k}' AS metric, {v} AS v FROM sums" for k, v in (("accuracy", "(tp + neg - fp) / (pos + neg)::DOUBLE"), ("f1", "2 * tp / greatest(tp + pos + fp, 1)::DOUBLE"), ("fpr", "fp / greatest(neg, 1)::DOUBLE"), ("auc", "area / greatest(pos * neg, 1)::DOUBLE")))
    return f"""WITH {sql.SCORED}, rw AS MATERIALIZED (SELECT resample, y, {', '.join(f'{m}_pred, {m}_score' for m in MODELS)}, {_weights_sql()} AS w FROM scored, (SELECT unnest(range({resamples}))::INT AS resample)),
bins AS (SELECT resample, model, bin, sum(w * y)::BIGINT AS pos, sum(w * (1 - y))::BIGINT AS neg, sum(w * y * pred)::BIGINT AS tp, sum(w * (1 - y) * pred)::BIGINT AS fp FROM ({each}) GROUP BY ALL),
below AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY resample, model ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lower_neg FROM bins),
sums AS MATERIALIZED (SELECT resample, model, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(pos * (lower_neg + neg / 2.0::DOUBLE)) AS area FROM below GROUP BY ALL), tall AS MATERIALIZED ({tall}),
i AS (SELECT model_a, model_b, metric, avg(difference) AS mean, stddev_pop(difference) AS se, quantile_cont(difference, 0.025) AS lo, quantile_cont(difference, 0.975) AS hi FROM ({pairs}) GROUP BY ALL),
o AS (SELECT *, CASE WHEN metric = 'fpr' THEN -hi ELSE lo END AS low, CASE WHEN metric = 'fpr' THEN -lo ELSE hi END AS high FROM i)
SELECT model_a, model_b, metric, round(mean, 6) AS mean, round(se, 6) AS se, round(lo, 6) AS lower, round(hi, 6) AS upper,
  CASE WHEN low >= -0.01 AND high <= 0.01 THEN 'EQUIVALENT' WHEN low > 0.01 THEN 'SUPERIOR' WHEN high < -0.01 THEN 'INFERIOR' WHEN low < 0 AND high > 0 THEN 'SPANS_ZERO' ELSE 'BORDERLINE' END AS verdict FROM o"""


@query("H3_poisson_bootstrap", _paired_sql(inference.RESAMPLES))
def _(s, d):
    got = inference.poisson_bootstrap(scored(s, d))
    return got.select("model_a", "model_b", "metric", *(F.round(c, 6).alias(c) for c in ("mean", "se", "lower", "upper")), "verdict")


# The complementary error function: its series up to 3, a continued fraction beyond.
_TAIL = """CASE WHEN x < 3 THEN 1 - 2 / sqrt(pi()) * list_sum([pow(-1.0::DOUBLE, k) * pow(x, 2 * k + 1) / (gamma(k + 1.0::DOUBLE) * (2 * k + 1)) FOR k IN range(0, 60)])
  ELSE exp(-x * x) / sqrt(pi()) / list_reduce(list_concat([x], [60.0::DOUBLE - k FOR k IN range(0, 60)]), lambda a, k: x + (k / 2) / a) END"""


@query("H4_paired_report", f"{_PAIRS}, t AS (SELECT model_a, model_b, b + c AS differ, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1.0, 2) / (b + c)::DOUBLE END, 6) AS statistic FROM p), e AS (SELECT *, sqrt(statistic / 2) AS x FROM t), q AS (SELECT model_a, model_b, statistic, CASE WHEN differ = 0 THEN 1.0::DOUBLE ELSE {_TAIL} END AS p FROM e), s AS (SELECT *, least(1.0, (4 - row_number() OVER (ORDER BY p, model_a DESC, model_b DESC)) * p) AS step FROM q) SELECT model_a, model_b, statistic, round(p, 8) AS p, round(max(step) OVER (ORDER BY p, model_a DESC, model_b DESC ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s")
def _(s, d):
    rows = inference.mcnemar_tests(scored(s, d))
    return s.createDataFrame([(r["model_a"], r["model_b"], float(r["statistic"]), round(float(r["p"]), 8), float(r["p_holm"])) for r in rows], "model_a string, model_b string, statistic double, p double, p_holm double")


# --- agreement and policy ----------------------------------------------------------------------------------------

@query("D1_pairs", f"{_PAIRS} SELECT model_a, model_b, n, agree, n - agree AS disagree, both_right, both_wrong, b AS only_a_right, c AS only_b_right, round(agree / n::DOUBLE, 6) AS agreement, round(b / (n - agree)::DOUBLE, 6) AS a_right_if_differ, round(c / (n - agree)::DOUBLE, 6) AS b_right_if_differ FROM p")
def _(s, d):
    return agreement.pairs(scored(s, d))


_SAME = "svm_pred = rf_pred AND rf_pred = qsvc_pred"


@query("D2_unanimity", f"WITH {sql.SCORED} SELECT count(*) AS n, count_if({_SAME})::BIGINT AS unanimous, count_if({_SAME} AND svm_pred = y)::BIGINT AS unanimous_right, count_if({_SAME} AND svm_pred <> y)::BIGINT AS unanimous_wrong, count_if({_SAME} AND svm_pred = 0)::BIGINT AS all_0, count_if({_SAME} AND svm_pred = 1)::BIGINT AS all_1 FROM scored")
def _(s, d):
    return agreement.unanimity(scored(s, d))


@query("D3_on_disagreement", f"WITH {sql.SCORED}, w AS (SELECT * FROM scored WHERE NOT ({_SAME})), r AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, count(*) AS n, count_if({m}_pred = y)::BIGINT AS hits FROM w" for m in MODELS) + ") SELECT model, n, hits AS \"right\", row_number() OVER (ORDER BY hits DESC, model) AS place, round(hits / n::DOUBLE, 6) AS accuracy FROM r")
def _(s, d):
    return agreement.on_disagreement(scored(s, d))


_CELLS3 = f"WITH {sql.SCORED}, c AS (SELECT (svm_pred <> y)::INT AS svm_wrong, (rf_pred <> y)::INT AS rf_wrong, (qsvc_pred <> y)::INT AS qsvc_wrong, count(*) AS n FROM scored GROUP BY 1, 2, 3)"


@query("D4_error_cells", f"{_CELLS3} SELECT * FROM c")
def _(s, d):
    return agreement.error_cells(scored(s, d))


@query("D4_error_overlaps", f"{_CELLS3} SELECT " + ", ".join(f"sum(n * {m}_wrong)::BIGINT AS {m}_errors" for m in MODELS) + ", " + ", ".join(f"sum(n * {a}_wrong * {b}_wrong)::BIGINT AS {a}_{b}_errors" for a, b in agreement.PAIRS) + ", " + ", ".join(f"coalesce(sum(CASE WHEN svm_wrong + rf_wrong + qsvc_wrong = {k} THEN n END), 0)::BIGINT AS {x}" for k, x in ((0, "all_right"), (2, "exactly_one_right"), (3, "all_wrong"))) + " FROM c")
def _(s, d):
    return agreement.error_overlaps(scored(s, d))


@query("D5_majority_worth", f"WITH {sql.SCORED}, w AS (SELECT count(*) AS n, count_if((svm_pred + rf_pred + qsvc_pred >= 2)::INT = y) AS v, count_if(svm_pred = y) AS svm, count_if(rf_pred = y) AS rf, count_if(qsvc_pred = y) AS qsvc FROM scored) SELECT n, round(v / n::DOUBLE, 6) AS majority, round(svm / n::DOUBLE, 6) AS svm, round(rf / n::DOUBLE, 6) AS rf, round(qsvc / n::DOUBLE, 6) AS qsvc, CASE WHEN svm >= greatest(rf, qsvc) THEN 'svm' WHEN rf >= qsvc THEN 'rf' ELSE 'qsvc' END AS best_model, round((v - greatest(svm, rf, qsvc)) / n::DOUBLE, 6) AS majority_minus_best FROM w")
def _(s, d):
    return agreement.majority_worth(scored(s, d))


@query("D6_small_table", f"WITH {sql.SCORED}, scored100 AS (SELECT * FROM scored ORDER BY row_id LIMIT 100), p AS ({' UNION ALL '.join(_pair_counts(a, b).replace('FROM scored', 'FROM scored100') for a, b in agreement.PAIRS)}) SELECT model_a, model_b, n, agree, both_wrong, round(agree / n::DOUBLE, 6) AS agreement FROM p")
def _(s, d):
    return agreement.pairs(tables.first_rows(scored(s, d), "row_id", 100)).select("model_a", "model_b", "n", "agree", "both_wrong", "agreement")


_DECIDED = f"{sql.SCORED}, v AS (SELECT *, svm_pred + rf_pred + qsvc_pred AS votes FROM scored), decided AS (SELECT *, (votes >= 2)::INT AS final, CASE votes WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS threat, votes IN (1, 2) AS review, votes::VARCHAR || '/3' AS tally FROM v)"


@query("V1_policy", f"WITH {_DECIDED} SELECT threat, final, review, tally, count(*) AS n, sum(y)::BIGINT AS attacks FROM decided GROUP BY ALL")
def _(s, d):
    return policy.summary(policy.decide(scored(s, d), [f"{m}_pred" for m in MODELS]))


# The rules as published, told in plain comparisons.
_SIMULATED = """WITH f AS (SELECT l_quantity * 4 AS sttl, l_extendedprice * 25 AS sload, l_suppkey % 600 AS smean, l_extendedprice AS sbytes FROM lineitem),
n AS (SELECT *, (sttl > 100)::INT + (sload > 1000000)::INT + (smean > 300)::INT AS signals FROM f),
m AS (SELECT *, (signals >= 1)::INT AS svm_pred, (signals >= 2)::INT AS rf_pred, (signals >= 2)::INT AS qsvc_pred,
  CASE WHEN signals >= 2 THEN least(0.97::DOUBLE, 0.62::DOUBLE + signals * 0.1::DOUBLE) WHEN signals = 1 THEN 0.61::DOUBLE ELSE greatest(0.04::DOUBLE, 0.88::DOUBLE - sbytes * 3e-6::DOUBLE) END AS svm_p,
  CASE WHEN signals >= 2 THEN least(0.98::DOUBLE, 0.68::DOUBLE + signals * 0.08::DOUBLE) WHEN signals = 1 THEN 0.44::DOUBLE ELSE greatest(0.03::DOUBLE, 0.91::DOUBLE - sbytes * 3e-6::DOUBLE) END AS rf_p,
  CASE WHEN signals >= 2 THEN least(0.94::DOUBLE, 0.58::DOUBLE + signals * 0.1::DOUBLE) WHEN signals = 1 THEN 0.39::DOUBLE ELSE greatest(0.06::DOUBLE, 0.85::DOUBLE - sbytes * 3e-6::DOUBLE) END AS qsvc_p FROM n),
v AS (SELECT *, svm_pred + rf_pred + qsvc_pred AS votes FROM m)
SELECT signals, votes, (votes >= 2)::INT AS final, CASE votes WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS threat, votes IN (1, 2) AS review, count(*) AS n,
  round(min(svm_p), 4) AS svm_low, round(max(svm_p), 4) AS svm_high, round(min(rf_p), 4) AS rf_low, round(max(rf_p), 4) AS rf_high, round(min(qsvc_p), 4) AS qsvc_low, round(max(qsvc_p), 4) AS qsvc_high
FROM v GROUP BY ALL"""


@query("V3_simulated", _SIMULATED)
def _(s, d):
    f = table(s, d, "lineitem").select((F.col("l_quantity") * 4).alias("sttl"), (F.col("l_extendedprice") * 25).alias("sload"), (F.col("l_suppkey") % 600).alias("smean"), F.col("l_extendedprice").alias("sbytes"))
    got = policy.simulated_votes(f, {c: c for c in f.columns})
    ends = [F.round(f_(f"{m}_probability"), 4).alias(f"{m}_{n}") for m in MODELS for n, f_ in (("low", F.min), ("high", F.max))]
    return got.groupBy("signals", "votes", "final", "threat", "review").agg(F.count("*").alias("n"), *ends)


@query("V4_user_threshold", f"WITH {sql.SCORED} SELECT (rf_score >= 0.6::DOUBLE)::INT AS alarm, y, count(*) AS n FROM scored GROUP BY ALL")
def _(s, d):
    return scored(s, d).groupBy(policy.at_threshold(F.col("rf_score"), 0.6).alias("alarm"), "y").agg(F.count("*").alias("n"))


@query("V2_stream_triage", "WITH v AS (SELECT date_trunc('hour', ts) AS window_start, (event_type = 'error')::INT + coalesce((value > 50.0)::INT, 0) + coalesce((json_extract_string(props, '$.k')::INT >= 50)::INT, 0) AS votes FROM events) SELECT window_start, CASE votes WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS threat, count(*) AS n FROM v GROUP BY ALL")
def _(s, d):
    from ..streaming import triage

    return triage.alert_rates(triage.decided(table(s, d, "events")))


@query("V2_alert_streaks", """WITH v AS (SELECT DISTINCT ON (event_id, ts) user_id, ts, (event_type = 'error')::INT + coalesce((value > 50.0)::INT, 0) + coalesce((json_extract_string(props, '$.k')::INT >= 50)::INT, 0) AS votes FROM events),
a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER u + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM v WHERE votes > 0 AND user_id IS NOT NULL WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS streak FROM a)
SELECT user_id, min(ts) AS streak_start, max(ts) + INTERVAL 2 HOUR AS streak_end, count(*) AS n FROM b GROUP BY user_id, streak HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def _(s, d):
    """The stream itself: streaks that the watermark has closed, appended to a folder."""
    from ..streaming import triage

    stream = triage.alert_streaks(triage.decided(triage.read_events(s, d)))
    got = triage.run_to_folder(stream, f"{shared_folder(s)}/streaks-{uuid.uuid4().hex}")
    return got.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("streak_start", "streak_end")), "n")


# --- models (values are of the library; rows are checked) --------------------------------------------------------

def _labelled(s, d):
    return flows(s, d).withColumnRenamed("label", "y").select("row_id", "y", *POOL)


def _dealt(s, d):
    """All flows with `split`. They are dealt anew first: a table of few files would leave draws and fits to few tasks."""
    f = _labelled(s, d)
    parts = max(s.sparkContext.defaultParallelism, math.ceil(f.count() / ROWS_A_TASK))
    return split.fraction_split(f.repartition(parts, "row_id"), 0.2, "row_id", "y", 42)


def _whole_split(s, d):
    """All flows, four fifths to fit on and a fifth to judge on."""
    dealt = _dealt(s, d)
    return dealt.where("split = 'train'").drop("split"), dealt.where("split = 'validation'").drop("split")


def _model_query(name: str, columns: list[str]):
    def run(s, d):
        with jobs.held(_dealt(s, d).select("row_id", "y", *columns, "split")) as own:
            fitted = models.FITTERS[name](own.where("split = 'train'").drop("split"), columns)
            got = models.evaluate_once(fitted, own.where("split = 'validation'"))
        return s.createDataFrame([(name, got["n"], got["accuracy"], got["f1"], got["fpr"], got["auc"])], "model string, n long, accuracy double, f1 double, fpr double, auc double")

    return run


QUERIES["M1_forest"] = _model_query("rf", POOL)
QUERIES["M2_boosting"] = _model_query("hgb", POOL)
QUERIES["M3_rbf_svm"] = _model_query("svm", NUMERIC)
QUERIES["M4_kernel_svm"] = _model_query("qsvc", NUMERIC)


@query("M5_cross_validate")
def _(s, d):
    # Above 5,000 rows the protocol's own subsample (S9).
    rows = models.cross_validate("rf", _whole_split(s, d)[0], NUMERIC, "row_id")
    return s.createDataFrame([(r["grid_pos"], r["params"], r["auc"]) for r in rows], "grid_pos int, params string, auc double")


def _protocol(s, d):
    """The protocol's partitions, whose sizes are its own; scaled down alike for a table with fewer rows."""
    f = _labelled(s, d)
    return split.partitions(f, jobs.protocol_sizes(f.count()), "row_id", "y", 42)


@query("M6_tune")
def _(s, d):
    with jobs.held(_protocol(s, d)) as p:
        _, cells = models.tune("svm", p.where("split = 'train'"), p.where("split = 'tune'"), NUMERIC)
    return s.createDataFrame([(c["grid_pos"], float(c["params"]["c"]), str(c["params"]["gamma"]), float(c["f1"])) for c in cells], "grid_pos int, c double, gamma string, f1 double")


@query("M7_tune_and_refit")
def _(s, d):
    f = _labelled(s, d)
    return jobs.tuned(f, NUMERIC, ["rf", "svm", "qsvc"], "row_id", sizes=jobs.protocol_sizes(f.count()))


@query("M10_kernel_c")
def _(s, d):
    with jobs.held(_protocol(s, d)) as p:
        cells, best = jobs.tune_kernel_c(p.where("split = 'train'"), p.where("split = 'tune'"), NUMERIC)
    return s.createDataFrame([(float(c["c"]), float(c["f1"]), c is best) for c in cells], "c double, f1 double, best boolean")


@query("M11_scores")
def _(s, d):
    train, test = _whole_split(s, d)
    with jobs.held(train) as own:
        fitted = models.forest(own, POOL)
    return models.checked_scores(fitted.transform(test)).select("row_id", "y", "score", "pred")


@query("M12_platt", f"WITH {sql.SCORED}, fitted AS (SELECT rf_score AS x, y::DOUBLE AS t FROM scored), {_platt_sql('fitted')} SELECT round(slope, 5) AS slope, round(intercept, 5) AS intercept FROM c14")
def _(s, d):
    base = scored(s, d).select("y", F.col("rf_score").alias("score"))
    curve = calibrate.Platt(base)
    return s.createDataFrame([(round(curve.slope, 5), round(curve.intercept, 5))], "slope double, intercept double")


@query("M13_engine")
def _(s, d):
    parts = split.bounded_partitions(flows(s, d), *BOUNDED.values(), "row_id", "label", 42).withColumnRenamed("label", "y")
    with jobs.held(parts) as own:
        part = {n: own.where(F.col("split") == n).select("row_id", "y", *NUMERIC) for n in BOUNDED}
        engine = models.Engine(part["train"], part["validation"], NUMERIC)
    done = engine.transform(parts.where("split = 'test'").select("row_id", "y", *NUMERIC))
    return done.select("row_id", "y", *(f"{m}_{k}" for m in MODELS for k in ("score", "pred", "probability")), "votes", "final", "threat", "review", "tally")


SETS = {"numeric": NUMERIC, "no_tax": NUMERIC[:3], "pool": POOL}


@query("X2_full_data")
def _(s, d):
    """Two models by two feature spaces on all rows."""
    rows = []
    with jobs.held(_dealt(s, d)) as dealt:
        own, judge = dealt.where("split = 'train'").drop("split"), dealt.where("split = 'validation'").drop("split")
        for set_name in ("numeric", "pool"):
            for m in ("rf", "svm"):
                got = models.evaluate_once(models.FITTERS[m](own, SETS[set_name]), judge)
                rows.append((set_name, m, got["n"], got["accuracy"], got["f1"], got["fpr"], got["auc"]))
    return s.createDataFrame(rows, "feature_set string, model string, n long, accuracy double, f1 double, fpr double, auc double")


@query("X3_experiment")
def _(s, d):
    f = _labelled(s, d)
    sizes = jobs.protocol_sizes(f.count())
    return jobs.experiment(f, {k: SETS[k] for k in ("numeric", "no_tax")}, ["rf", "svm", "qsvc"], {k: sizes[k] for k in ("train", "test")}, "row_id", "y", jobs.SEEDS)


@query("X4_restricted_kernel")
def _(s, d):
    return jobs.restricted_kernel(_labelled(s, d), NUMERIC, "row_id")


@query("X5_learning_curves")
def _(s, d):
    f = _labelled(s, d)
    sizes = jobs.protocol_sizes(f.count())
    curve = tuple(max(20, n * sizes["train"] // jobs.PROTOCOL["train"]) for n in jobs.CURVE)
    return jobs.learning_curves(f, NUMERIC, ["rf", "svm", "qsvc"], "row_id", sizes=curve, test=sizes["test"])


@query("X6_tuning")
def _(s, d):
    f = _labelled(s, d)
    return jobs.tuning(f, NUMERIC, ["qsvc", "svm", "rf"], "row_id", sizes=jobs.protocol_sizes(f.count(), jobs.TUNING))


@query("X7_operational_benchmark")
def _(s, d):
    f = _labelled(s, d)
    return jobs.benchmark(f, {"numeric": NUMERIC}, ["rf", "svm", "qsvc"], "row_id", sizes=jobs.protocol_sizes(f.count()))


@query("X8_feature_spaces")
def _(s, d):
    f = _labelled(s, d)
    return jobs.benchmark(f, SETS, ["rf", "hgb", "svm"], "row_id", sizes=jobs.protocol_sizes(f.count()))


@query("X9_kernel_scaling")
def _(s, d):
    return jobs.kernel_scaling(split.landmarks(_angles(s, d), 200, "vec_id", 7).orderBy("vec_id"), ANGLES)


@query("X16_timed_kernels")
def _(s, d):
    return jobs.timed_kernels(_angles(s, d), ANGLES, "vec_id").drop("seconds", "projected")


@query("F12_two_pools", f"{_SELECTION}, {_pruned_sql()}, {_picked_sql(4, among=f'k{len(POOL)}')}, z_b AS MATERIALIZED (SELECT * FROM b WHERE name <> 'discount'), {_order_sql('z_')}, {_pruned_sql('z_')}, {_picked_sql(4, prefix='z_', among=f'z_k{len(POOL)}')} SELECT 'all_features' AS run, unnest(range(len(picked)))::INT AS place, unnest(picked) AS name FROM p4 UNION ALL SELECT 'excluded', unnest(range(len(picked)))::INT, unnest(picked) FROM z_p4")
def _(s, d):
    got = jobs.two_pools(flows(s, d), POOL, ("discount",), "label", "row_id", binned=True)
    return s.createDataFrame([(run, k, n) for run, r in got.items() for k, n in enumerate(r["selected"])], "run string, place int, name string")


_LONGER = {"pairs": ("n", "agree", "disagree", "both_right", "both_wrong", "only_a_right", "only_b_right", "agreement", "a_right_if_differ", "b_right_if_differ")}


def _disagreement_sql() -> str:
    def tall(section: str, subject: str, source: str, columns: tuple[str, ...]) -> str:
        return " UNION ALL ".join(f"SELECT '{section}' AS section, {subject} AS subject, '{c}' AS measure, \"{c}\"::DOUBLE AS value FROM ({source})" for c in columns)

    overlaps = (*(f"{m}_errors" for m in MODELS), *(f"{a}_{b}_errors" for a, b in agreement.PAIRS), "all_right", "exactly_one_right", "all_wrong")
    parts = [
        tall("pairs", "model_a || '-' || model_b", ORACLE_SQL["D1_pairs"], _LONGER["pairs"]),
        tall("unanimity", "'all'", ORACLE_SQL["D2_unanimity"], ("n", "unanimous", "unanimous_right", "unanimous_wrong", "all_0", "all_1")),
        tall("on disagreement", "model", ORACLE_SQL["D3_on_disagreement"], ("n", "right", "place", "accuracy")),
        tall("error cells", "concat(svm_wrong, rf_wrong, qsvc_wrong)", ORACLE_SQL["D4_error_cells"], ("svm_wrong", "rf_wrong", "qsvc_wrong", "n")),
        tall("error overlaps", "'all'", ORACLE_SQL["D4_error_overlaps"], overlaps),
        tall("majority", "'vote'", ORACLE_SQL["D5_majority_worth"], ("n", "majority", "svm", "rf", "qsvc", "majority_minus_best")),
    ]
    return " UNION ALL ".join(parts)


@query("X20_disagreement", _disagreement_sql())
def _(s, d):
    with jobs.held(scored(s, d)) as own:
        got = jobs.disagreement(own).collect()  # some eighty figures
    return s.createDataFrame(got, "section string, subject string, measure string, value double")


# --- cost models -------------------------------------------------------------------------------------------------

_SIZES = "s AS (SELECT p_size AS n, count(*) AS m FROM part GROUP BY p_size)"


def _sizes(s, d):
    return table(s, d, "part").groupBy(F.col("p_size").alias("n")).agg(F.count("*").alias("m"))


_DRY = """WITH s AS (SELECT DISTINCT p_size * 80 AS n_train FROM part),
c AS (SELECT n_train, n_train * (127.9301::DOUBLE / 20000) AS e, 0.0084::DOUBLE * pow(n_train / 500.0::DOUBLE, 2) AS tk, 0.1681::DOUBLE * (n_train / 500.0::DOUBLE) AS k, 0.0063::DOUBLE * pow(n_train / 500.0::DOUBLE, 2) AS f, 0.0753::DOUBLE AS p FROM s)
SELECT n_train, round(e, 3) AS embed_s, round(tk, 4) AS train_kernel_s, round(k, 3) AS test_kernel_s, round(f, 3) AS fit_s, round(p, 3) AS predict_s, round(e + tk + k + f + p, 2) AS total_s, round(20000::DOUBLE * n_train * 8 / 1048576, 2) AS test_matrix_mb FROM c"""


@query("X10_dry_run", _DRY)
def _(s, d):
    sizes = table(s, d, "part").select((F.col("p_size") * 80).alias("n_train")).distinct()
    return projection.dry_run(sizes, projection.DRY_RUN)


@query("X11_matrix_memory", f"WITH {_SIZES}, b AS (SELECT n, m, n::BIGINT * m AS entries FROM s) SELECT n, m, entries, entries * 8 AS bytes, round(entries * 8 / 1024.0::DOUBLE, 4) AS kb, round(entries * 8 / 1048576.0::DOUBLE, 4) AS mb, round(entries * 8 / 1073741824.0::DOUBLE, 6) AS gb FROM b")
def _(s, d):
    return _sizes(s, d).withColumns(projection.matrix_memory(F.col("n"), F.col("m")))


@query("X12_quadratic", f"WITH {_SIZES} SELECT n, m, round(m * pow(1000.0::DOUBLE / n, 2), 4) AS seconds FROM s")
def _(s, d):
    return _sizes(s, d).withColumn("seconds", F.round(projection.quadratic(F.col("n"), F.col("m"), F.lit(1000.0)), 4))


_RUNS = "r AS (SELECT l_suppkey % 3 AS series, l_linenumber * 50 AS n, avg(l_quantity) * l_linenumber AS seconds FROM lineitem GROUP BY l_suppkey % 3, l_linenumber)"


def _runs(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 3).alias("series"), F.col("l_linenumber")).agg(F.avg("l_quantity").alias("q")).select("series", (F.col("l_linenumber") * 50).alias("n"), (F.col("q") * F.col("l_linenumber")).alias("seconds"))


@query("X13_stop_rules", f"WITH {_RUNS}, l AS (SELECT *, lag(n) OVER w AS ln, lag(seconds) OVER w AS ls FROM r WINDOW w AS (PARTITION BY series ORDER BY n)), p AS (SELECT *, ls * pow(n / ln::DOUBLE, 2) AS projected FROM l), t AS (SELECT *, coalesce(ls > 120 OR projected > 180, false) AS stop FROM p) SELECT series, n, round(seconds, 4) AS seconds, round(projected, 4) AS projected, bool_or(stop) OVER (PARTITION BY series ORDER BY n) AS skipped FROM t")
def _(s, d):
    return projection.stop_rules(_runs(s, d)).withColumns({"seconds": F.round("seconds", 4), "projected": F.round("projected", 4)})


_FULL = f"WITH {_RUNS}, last AS (SELECT series, arg_max(seconds, n) AS sec, max(n) AS n FROM r GROUP BY series), k AS (SELECT series, kernel, rows, columns, sec / (n::DOUBLE * n) * (rows::DOUBLE * columns) / 86400 AS days, rows::DOUBLE * columns * 8 / 1073741824.0::DOUBLE AS gib FROM last, (VALUES ('train', 82332::BIGINT, 82332::BIGINT), ('test', 82332::BIGINT, 175341::BIGINT)) v(kernel, rows, columns))"


# Rows of the published training and test parts.
@query("X14_full_scale", f"{_FULL} SELECT series, kernel, round(days, 6) AS days, round(gib, 6) AS gib FROM k")
def _(s, d):
    return projection.full_scale(_runs(s, d), 82332, 175341)


# Three series whose largest sizes are 350, 200 and 50.
_COMPLETED = f"WITH {_RUNS}, done AS (SELECT * FROM r WHERE n <= 350 - 150 * series), last AS (SELECT series, max(n) AS largest, arg_max(seconds, n) AS seconds FROM done GROUP BY series)"


@query("X15_recommend", f"{_COMPLETED}, a AS (SELECT *, CASE WHEN largest >= 200 AND seconds <= 120 THEN [200, 50, 100] WHEN largest >= 100 THEN [100, 50, 100] ELSE [50, 25, 50] END AS s FROM last) SELECT series, largest, round(seconds, 4) AS seconds, s[1] AS n_train, s[2] AS n_validation, s[3] AS n_test, s[1] <= 200 AND s[2] <= 50 AND s[3] <= 100 AS within_ceilings FROM a")
def _(s, d):
    return projection.recommend(_runs(s, d).where("n <= 350 - 150 * series")).withColumn("seconds", F.round("seconds", 4))


@query("X17_state_memory", f"WITH {_SIZES} SELECT n, 2 * n::DOUBLE * pow(2.0, 4) * 16 + 8 * n::DOUBLE * n + 10485760 AS bytes_4, 2 * n::DOUBLE * pow(2.0, 10) * 16 + 8 * n::DOUBLE * n + 10485760 AS bytes_10 FROM s")
def _(s, d):
    return _sizes(s, d).select("n", projection.state_memory(F.col("n"), F.lit(4)).alias("bytes_4"), projection.state_memory(F.col("n"), F.lit(10)).alias("bytes_10"))
