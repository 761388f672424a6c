"""Shared parts of the oracle's SQL (DuckDB): the adapters and the cumulative counts."""

from __future__ import annotations

from ..sources.tables import MODEL_WEIGHTS, MODELS

FLOWS = """flows AS (SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, l_quantity AS quantity, l_extendedprice AS price,
  l_discount AS discount, l_tax AS tax, (l_linestatus = 'O')::INT AS is_open, l_linestatus AS status, l_returnflag AS flag, (l_returnflag = 'R')::INT AS label, l_returnflag AS category FROM lineitem)"""


def uniform(*parts: str) -> str:
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


SCORED = FLOWS + ", scores AS (SELECT row_id, label AS y, category, " + ", ".join(f"{w}::DOUBLE * label + {1 - w!r}::DOUBLE * {uniform(repr(m), 'row_id')} AS {m}_score" for m, w in MODEL_WEIGHTS.items()) + " FROM flows), scored AS (SELECT *, " + ", ".join(f"({m}_score >= 0.5)::INT AS {m}_pred" for m in MODELS) + " FROM scores)"
LONG = SCORED + ", long AS (" + " UNION ALL ".join(f"SELECT row_id, y, '{m}' AS model, {m}_score AS score, {m}_pred AS pred FROM scored" for m in MODELS) + ")"


def cumulative(source: str, keys: str, score: str = "score", y: str = "y") -> str:
    """CTEs per and cum over a source with the given key columns."""
    by = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    past = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""per AS (SELECT {lead}{score} AS score, sum({y})::BIGINT AS pos, sum(1 - {y})::BIGINT AS neg FROM {source} GROUP BY {lead}{score}),
cum AS (SELECT {lead}score, pos, neg, coalesce(sum(pos) OVER ({by} ORDER BY score {past}), 0)::BIGINT AS pos_below, coalesce(sum(neg) OVER ({by} ORDER BY score {past}), 0)::BIGINT AS neg_below,
  (sum(pos) OVER ({by}))::BIGINT AS all_pos, (sum(neg) OVER ({by}))::BIGINT AS all_neg FROM per)"""


def count_if(c: str) -> str:
    return f"count_if({c})::BIGINT"


CELLS = f"{count_if('y = 0 AND pred = 0')} AS tn, {count_if('y = 0 AND pred = 1')} AS fp, {count_if('y = 1 AND pred = 0')} AS fn, {count_if('y = 1 AND pred = 1')} AS tp"


def rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


PRECISION, RECALL = rate("tp", "tp + fp"), rate("tp", "tp + fn")


def rates(digits: int) -> str:
    f1 = f"CASE WHEN ({PRECISION}) + ({RECALL}) = 0 THEN 0.0::DOUBLE ELSE 2 * ({PRECISION}) * ({RECALL}) / (({PRECISION}) + ({RECALL})) END"
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in (("accuracy", rate("tp + tn", "tn + fp + fn + tp")), ("precision", PRECISION), ("recall", RECALL), ("f1", f1), ("fpr", rate("fp", "fp + tn"))))


def auc(digits: int = 6) -> str:
    return f"round(sum(pos * (neg_below + neg / 2.0)) / nullif(max(all_pos) * max(all_neg), 0), {digits}) AS auc"


def pauc(digits: int = 6, m: float = 0.02) -> str:
    x1, y1, x0, y0 = "(all_neg - neg_below) / all_neg::DOUBLE", "(all_pos - pos_below) / all_pos::DOUBLE", "(all_neg - neg_below - neg) / all_neg::DOUBLE", "(all_pos - pos_below - pos) / all_pos::DOUBLE"
    cut = f"({y0} + ({y1} - {y0}) * ({m}::DOUBLE - {x0}) / ({x1} - {x0}))"
    piece = f"CASE WHEN {x0} >= {m}::DOUBLE THEN 0.0 WHEN {x1} <= {m}::DOUBLE THEN ({x1} - {x0}) * ({y0} + {y1}) / 2 ELSE ({m}::DOUBLE - {x0}) * ({y0} + {cut}) / 2 END"
    least = 0.5 * m * m
    return f"round(0.5 * (1 + (sum({piece}) - {least!r}::DOUBLE) / ({m}::DOUBLE - {least!r}::DOUBLE)), {digits}) AS pauc"


def thresholds(source: str, keys: str, target: float) -> str:
    """A full SELECT of the threshold rows of a source's negatives."""
    return f"""WITH neg_only AS (SELECT * FROM {source} WHERE y = 0), {cumulative('neg_only', keys)},
marked AS (SELECT *, floor({target}::DOUBLE * all_neg)::BIGINT AS k, all_neg - neg_below AS ge FROM cum),
ok AS (SELECT {keys}, max(all_neg) AS negatives, max(k) AS budget, min(CASE WHEN ge <= k AND k >= 1 THEN score END) AS threshold,
  arg_min(ge, score) FILTER (WHERE ge <= k AND k >= 1) AS false_positives, arg_min(neg_below, score) FILTER (WHERE ge <= k AND k >= 1) AS below,
  max(CASE WHEN neg_below <= all_neg - k AND all_neg - k < neg_below + neg THEN score END) AS nominal_threshold FROM marked GROUP BY {keys})
SELECT {keys}, {target}::DOUBLE AS target_fpr, negatives, budget, threshold, false_positives, false_positives / negatives::DOUBLE AS achieved_fpr, below + 1 AS rank,
  negatives - budget + 1 AS nominal_rank, nominal_threshold, threshold <> nominal_threshold AS tie_adjusted FROM ok"""


def ranked(source: str, seed: int, label: str = "label") -> str:
    u = uniform(f"'{seed}'", "row_id")
    return f"(SELECT *, (row_number() OVER (PARTITION BY {label} ORDER BY {u}, row_id) - 1)::BIGINT AS place FROM {source})"


def quota(source: str, n: int, label: str = "label") -> str:
    """label and q: n shared among labels by largest remainder, ties to the smaller label."""
    return f"""(SELECT {label}, f + (row_number() OVER (ORDER BY x - f DESC, {label}) <= {n} - sum(f) OVER ())::BIGINT AS q FROM
  (SELECT {label}, {n}.0::DOUBLE * count(*) / (SELECT count(*) FROM {source}) AS x, floor({n}.0::DOUBLE * count(*) / (SELECT count(*) FROM {source}))::BIGINT AS f FROM {source} GROUP BY {label}))"""
