"""Line dedup by a log-template tree, in DataFrame operations alone.

A line's tokens are its parts between spaces; a token with a digit is a variable field. The tree has
a fixed depth: lines of one leaf agree in their number of tokens and in their LEADING first tokens.
A node's template keeps the token that more than half of its lines have at a place and generalises
the other places; a line belongs to it if at least SIMILAR of its tokens are the template's own.
A leaf may hold several templates: the lines that do not fit are dealt to new nodes, each by the token
that most of them share but not all (the first such place on ties), SPLITS times; so a template is
found whatever other lines share its leaf. Besides, lines that differ in variable fields only are one
template, whatever their node. A template found in at least MIN_DOCS different texts recurs, and its
lines are dropped from every document. Lines without a token stay.

Copies of one text count as one text, so copies do not make each other's lines recur. A null text
has no lines and nothing left; an empty one has one empty line, which stays. Rows are kept as they
are, repeated or not; a null doc_id is kept; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import splittable
from .shared import cut, read

LEADING, MIN_DOCS, SIMILAR, SPLITS, FIELD = 3, 5, 0.6, 2, "<*>"


def _fields(tokens: Column) -> Column:
    """Tokens with variable fields in place of those that have a digit."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def lines_of(texts: DataFrame) -> DataFrame:
    """(tkey, pos, leaf, line) of the lines of texts (tkey, text) that have a token. Only leading tokens are looked at yet, and lines stay strings, which are small to shuffle."""
    lines = texts.select("tkey", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    cut_up = lines.withColumn("raw", F.array_remove(F.split("line", " ", -1), "")).where(F.size("raw") > 0)
    return cut_up.select("tkey", "pos", F.xxhash64(F.size("raw"), _fields(F.slice("raw", 1, LEADING))).alias("leaf"), "line")


def _cells(shapes: DataFrame) -> DataFrame:
    """(node, p, token, c): how many lines of a node have a token at a place."""
    return shapes.select("node", "c", F.posexplode("tokens").alias("p", "token")).groupBy("node", "p", "token").agg(F.sum("c").alias("c"))


def _templates(shapes: DataFrame) -> DataFrame:
    """(node, template)."""
    places = _cells(shapes).groupBy("node", "p").agg(F.max(F.struct("c", "token")).alias("top"), F.sum("c").alias("all"))
    places = places.select("node", "p", F.when(F.col("top.c") * 2 > F.col("all"), F.col("top.token")).otherwise(FIELD).alias("token"))
    return places.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "token"))), lambda x: x["token"]).alias("template"))


def _dealt(rest: DataFrame) -> DataFrame:
    """rest (node, shape, tokens, c) in new nodes; shapes that share no such token with another stay out."""
    total = rest.groupBy("node").agg(F.sum("c").alias("total"))
    shared = _cells(rest).where((F.col("token") != FIELD) & (F.col("c") > 1)).join(total, "node").where("c < total").select("node", "p", "token", F.col("c").alias("n"))
    places = rest.select("node", "shape", F.posexplode("tokens").alias("p", "token")).join(shared, ["node", "p", "token"])
    best = places.groupBy("node", "shape").agg(F.max_by(F.struct("p", "token"), F.struct("n", -F.col("p"))).alias("by"))
    return rest.join(best, ["node", "shape"]).select(F.xxhash64("node", "by.p", "by.token").alias("node"), "shape", "tokens", "c")


def groups_of(near: DataFrame, similar: float = SIMILAR, splits: int = SPLITS) -> DataFrame:
    """(shape, node): the template of each different line of near (leaf, shape, tokens), if it fits one."""
    # Equal lines of a leaf count once, with their number.
    shapes = near.groupBy(F.col("leaf").alias("node"), "shape").agg(F.first("tokens").alias("tokens"), F.count("*").alias("c"))
    own = F.size(F.filter(F.zip_with("tokens", "template", lambda a, b: (a == b) & (b != FIELD)), lambda x: x))
    out = None
    for k in range(splits + 1):
        judged = shapes.join(_templates(shapes), "node").withColumn("fits", own >= F.ceil(F.lit(similar) * F.size("tokens") - 1e-9))
        judged = cut(judged.select("node", "shape", "tokens", "c", "fits"), f"judged-{k}")
        got = judged.where("fits").select("shape", "node")
        out = got if out is None else out.unionByName(got)
        if k < splits:
            shapes = _dealt(judged.where("not fits"))
    return out


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """tkey (md5 of a text) and the places of its lines that recur, for texts that have any."""
    given = docs.where("text is not null")
    lines = lines_of(given.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey"), "text"))
    hashed = lines_of(given.select(F.xxhash64("text").alias("tkey"), "text"))
    leaves = hashed.groupBy("leaf").agg(F.count("*").alias("lines"), F.min("tkey").alias("a"), F.max("tkey").alias("b")).where((F.col("lines") >= min_docs) & (F.col("a") != F.col("b"))).select("leaf")
    # Copies of a text are one: their lines are the same rows.
    near = splittable(lines, leaves, "leaf").groupBy("leaf", "tkey", "pos").agg(F.first("line").alias("line"))
    near = near.select("leaf", "tkey", "pos", _fields(F.array_remove(F.split("line", " ", -1), "")).alias("tokens"))
    near = cut(near.withColumn("shape", F.xxhash64("leaf", F.array_join("tokens", " "))), "lines")

    often = lambda filed: filed.select("group", "tkey").distinct().groupBy("group").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs).select("group")
    seen = near.select("tkey", "pos", "shape").withColumn("group", F.col("shape"))
    filed = cut(near.select("tkey", "pos", "shape").join(groups_of(near, similar), "shape").withColumnRenamed("node", "group"), "filed")
    gone = splittable(seen, often(seen), "group").select("tkey", "pos").unionByName(splittable(filed, often(filed), "group").select("tkey", "pos"))
    return gone.groupBy("tkey").agg(F.collect_set("pos").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_lines, n_dropped and kept_text, one row for each of docs."""
    texts = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey"))
    found = texts.join(recurring_lines(docs, min_docs, similar), "tkey", "left")
    lines = F.split("text", "\n", -1)
    # The slices between dropped lines, so that a line is looked at once however many are dropped.
    edges = F.concat(F.array(F.lit(-1)), F.array_sort("dropped"), F.array(F.size(lines)))
    found = found.withColumns({"lines": lines, "edges": edges})
    parts = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.slice("lines", F.get("edges", i - 1) + 2, F.get("edges", i) - F.get("edges", i - 1) - 1))
    kept = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(parts), "\n"))
    return found.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_recurring_lines(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _sql() -> str:
    parts = [f"""texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
split AS (SELECT text, string_split(text, chr(10)) AS ls FROM texts),
lines AS (SELECT text, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM split),
parsed AS (SELECT text, pos, [CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END FOR t IN string_split(line, ' ') IF t <> ''] AS tokens FROM lines),
near AS MATERIALIZED (SELECT * FROM parsed WHERE len(tokens) > 0),
shapes0 AS MATERIALIZED (SELECT [len(tokens)::VARCHAR] || tokens[1:{LEADING}] AS node, tokens, count(*) AS c FROM near GROUP BY tokens)"""]
    cells = "SELECT node, p, token, sum(c) AS c FROM (SELECT node, c, unnest(range(len(tokens))) AS p, unnest(tokens) AS token FROM {0}) GROUP BY ALL"
    for k in range(SPLITS + 1):
        parts.append(f"""places{k} AS (SELECT node, p, CASE WHEN max(c) * 2 > sum(c) THEN arg_max(token, c) ELSE '{FIELD}' END AS token FROM ({cells.format(f'shapes{k}')}) GROUP BY node, p),
templates{k} AS (SELECT node, list(token ORDER BY p) AS template FROM places{k} GROUP BY node),
judged{k} AS MATERIALIZED (SELECT node, tokens, c, len([i FOR i IN range(1, len(tokens) + 1) IF tokens[i] = template[i] AND template[i] <> '{FIELD}']) >= ceil({SIMILAR}::DOUBLE * len(tokens) - 1e-9) AS fits FROM shapes{k} JOIN templates{k} USING (node))""")
        if k < SPLITS:
            parts.append(f"""rest{k} AS MATERIALIZED (SELECT node, tokens, c FROM judged{k} WHERE NOT fits),
shared{k} AS (SELECT * FROM ({cells.format(f'rest{k}')}) JOIN (SELECT node, sum(c) AS total FROM rest{k} GROUP BY node) USING (node) WHERE token <> '{FIELD}' AND c > 1 AND c < total),
best{k} AS (SELECT node, tokens, arg_max([p::VARCHAR, token], [s.c, -p]) AS step FROM (SELECT node, tokens, unnest(range(len(tokens))) AS p, unnest(tokens) AS token FROM rest{k}) JOIN shared{k} s USING (node, p, token) GROUP BY node, tokens),
shapes{k + 1} AS MATERIALIZED (SELECT node || step AS node, tokens, c FROM rest{k} JOIN best{k} USING (node, tokens))""")
    fitting = " UNION ALL ".join(f"SELECT node, tokens FROM judged{k} WHERE fits" for k in range(SPLITS + 1))
    return f"""WITH {', '.join(parts)},
filed AS (SELECT text, pos, node FROM near JOIN ({fitting}) USING (tokens)),
exact AS (SELECT tokens FROM near GROUP BY tokens HAVING count(DISTINCT text) >= {MIN_DOCS}),
general AS (SELECT node FROM filed GROUP BY node HAVING count(DISTINCT text) >= {MIN_DOCS}),
gone AS (SELECT text, pos FROM near WHERE tokens IN (SELECT tokens FROM exact) UNION SELECT text, pos FROM filed WHERE node IN (SELECT node FROM general)),
per_text AS (SELECT text, count(*) AS n_dropped, list(pos) AS dropped FROM gone GROUP BY text)
SELECT doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN dropped IS NULL THEN coalesce(d.text, '') ELSE array_to_string([l FOR l, i IN string_split(d.text, chr(10)) IF NOT list_contains(dropped, i - 1)], chr(10)) END) AS kept_sha256
FROM documents d LEFT JOIN per_text ON d.text = per_text.text"""


SQL = _sql()
