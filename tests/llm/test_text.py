"""Decontamination, line templates, toxicity, language and mixing."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.llm import decontamination, language, line_templates, mixing, toxicity


def prose(rnd, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def bench(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, cosine string")


def test_decontamination(spark, docs, odd_rows):
    rnd = random.Random(1)
    items = [(k, prose(rnd, rnd.randint(16, 50))) for k in range(20)]
    rows, want = [], set()
    for k in range(120):
        text = prose(rnd, rnd.randint(30, 300))
        if k % 4 == 0:
            i, item = items[k // 4 % 20]
            w = item.split()
            if k % 8 == 0:  # a paraphrase: a fifth of the words replaced
                for j in rnd.sample(range(len(w) - 4), len(w) // 5):
                    w[j] = prose(rnd, 1)
            text = f"{text} {' '.join(w).upper()}. {prose(rnd, 40)}"
            want.add((k, i))
        rows.append((k, text))
    rows += [(i if i is None else i + 1000, t) for i, t in odd_rows]
    found = decontamination.leaks(docs(rows), bench(spark, [*items, (77, None), (78, ""), (79, "too short"), (None, items[0][1])]))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == want
    assert all(r.share >= 0.6 and 0 <= r.nearness <= 1 for r in got.values())
    kept = docs(rows).join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    assert kept.count() == len(rows) - len(want)


def test_decontamination_by_many_items(spark, docs):
    """Copies of thousands of items are found, verbatim or with a fifth of the words replaced, and items of light words among heavy ones."""
    rnd = random.Random(5)
    vocabulary = [prose(rnd, 1) for _ in range(20_000)]
    pick = lambda n: [vocabulary[int(20_000 * rnd.random() ** 2)] for _ in range(n)]
    items = [pick(rnd.randint(16, 50)) for _ in range(2000)]
    rows, want = [], set()
    for k in range(2000):
        w = list(items[k])
        if k % 2:
            for j in rnd.sample(range(len(w) - 5), len(w) // 5):
                w[j] = pick(1)[0]
        rows.append((k, " ".join([*pick(rnd.randint(20, 60)), *w, *pick(40)])))
        want.add((k, k))
    rows += [(5000 + k, " ".join(pick(200))) for k in range(200)]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(rows), bench(spark, [(k, " ".join(w)) for k, w in enumerate(items)])).collect()}
    assert got == want


def test_decontamination_of_nothing(spark, docs):
    assert decontamination.leaks(docs([]), bench(spark, [(1, "some words of a short item here")])).count() == 0
    assert decontamination.leaks(docs([(1, "a b c")]), bench(spark, [])).count() == 0


def test_common_subsequences():
    rnd = random.Random(0)
    for _ in range(50):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(1, 30))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.Pattern(np.array(a)).common(b) == t[-1, -1]


def test_passage_matrix_is_factorised(spark, docs):
    """The space holds what a dense decomposition of the same matrix holds."""
    rnd = random.Random(2)
    items = [(k, prose(rnd, 30, "abc")) for k in range(4)]
    rows = [(k, prose(rnd, 150, "abc")) for k in range(20)]
    number = {}
    for _, t in items:
        for w in t.split():
            number.setdefault(w, len(number))
    own = [decontamination.Item(i, t, number) for i, t in items]
    coded = decontamination.code(docs(rows), number).persist()
    idf = decontamination.inverse_frequencies(coded, len(number), own)
    basis = decontamination.latent_space(coded, own, idf, rank=8)
    assert np.abs(basis.T @ basis - np.eye(basis.shape[1])).max() < 1e-4
    dense = np.zeros((0, len(idf)))
    for r in coded.collect():
        for word, of, value in decontamination.passages(iter([np.frombuffer(r.ids, "<i4")]), idf):
            m = np.zeros((of.max() + 1, len(idf)))
            m[of, word] = value
            dense = np.concatenate([dense, m])
    assert np.linalg.norm(dense @ basis) ** 2 > 0.6 * np.sum(np.linalg.svd(dense)[1][:8] ** 2)


def brute_lines(texts):
    """The rule of line_templates, plainly."""
    m = line_templates
    lines, exact, members = {}, {}, {}
    for t in set(texts) - {None}:
        for p, line in enumerate(t.split("\n")):
            if tokens := tuple(m.FIELD if any(c in "0123456789" for c in w) else w for w in line.split(" ") if w):
                lines[t, p] = tokens
                exact.setdefault(tokens, set()).add(t)
    nodes = {}
    for k, w in lines.items():
        nodes.setdefault((len(w), w[: m.LEADING]), []).append(k)
    for _ in range(m.SPLITS + 1):
        after = {}
        for node, ks in nodes.items():
            n, rest = len(lines[ks[0]]), []
            counts = [Counter(lines[k][p] for k in ks) for p in range(n)]
            template = [next((t for t, c in own.items() if c * 2 > len(ks)), m.FIELD) for own in counts]
            for k in ks:
                if sum(a == b != m.FIELD for a, b in zip(lines[k], template, strict=True)) >= m.SIMILAR * n - 1e-9:
                    members.setdefault(node, []).append(k)
                else:
                    rest.append(k)
            counts = [Counter(lines[k][p] for k in rest) for p in range(n)]
            for k in rest:
                some = [(counts[p][t], -p, t) for p, t in enumerate(lines[k]) if t != m.FIELD and 1 < counts[p][t] < len(rest)]
                if some:
                    after.setdefault((node, max(some)[1:]), []).append(k)
        nodes = after
    gone = {k for k, w in lines.items() if len(exact[w]) >= m.MIN_DOCS}
    for ks in members.values():
        if len({t for t, _ in ks}) >= m.MIN_DOCS:
            gone.update(ks)
    return {t: "\n".join(x for p, x in enumerate(t.split("\n")) if (t, p) not in gone) for t in set(texts) - {None}}


def test_line_templates_that_share_a_leaf(spark, docs):
    """Several templates of one leaf, short lines, and many dropped lines of one long text."""
    rnd = random.Random(12)
    rows = []
    for k in range(120):
        lines = [f"Click here to view the profile of {prose(rnd, 1)}", f"Click here to leave a note for {prose(rnd, 1)}", f"Click here to {prose(rnd, 5)}", "Read more", "Share", prose(rnd, 12)]
        rnd.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    rows.append((900, "\n".join(f"Share\nown line {prose(rnd, 9)}" for _ in range(3000))))
    want = brute_lines([t for _, t in rows])
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs(rows)).collect()}
    assert {k: r.kept_text for k, r in got.items()} == {k: want[t] for k, t in rows}
    assert got[900].n_dropped == 3000 and got[900].kept_text.count("\n") == 2999
    assert not any(w in got[k].kept_text for k in range(120) for w in ("profile", "leave a note", "Read more", "Share"))


def test_line_templates(spark, docs, odd_rows):
    rnd = random.Random(3)
    rows = []
    for k in range(40):
        lines = [prose(rnd, rnd.randint(1, 9), "ab") for _ in range(6)]
        if k % 3 == 0:
            lines.insert(2, f"Copyright by Some {prose(rnd, 1)} {1990 + k} all rights reserved")
        if k % 4 == 0:
            lines.append("Read more about this topic")
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, rows[0][1]) for k in range(8)] + [(i if i is None else i + 1000, t) for i, t in odd_rows]
    want = brute_lines([t for _, t in rows])
    got = line_templates.drop_recurring_lines(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        options = {want[t] if t is not None else "" for t in texts[r.doc_id]}
        assert r.kept_text in options
        assert (r.n_lines == 0) == (None in texts[r.doc_id] and r.kept_text == "" and r.n_lines == 0)
    assert sum("Copyright" in r.kept_text for r in got) == 0
    assert line_templates.drop_recurring_lines(docs([])).count() == 0


def test_fold():
    assert toxicity.fold("1D10T ídiot i.d.i.o.t іdiot Wоrthless tr@sh") == "idiot idiot idiot idiot worthless trash"


def test_matcher_masks_exceptions():
    m = toxicity.Matcher({"trash": 2.0, "trashy": 3.0}, ["trash can"])
    assert m("put it in the trash can now") == []
    assert [w for _, w in m("trash talk, trashy talk, untrash")] == ["trash", "trashy"]
    assert toxicity.Matcher({}, [])("trash") == []


def test_toxicity(spark, docs, odd_rows):
    rnd = random.Random(4)
    bad, rows, labels = ["zorgle", "blimfat", "qux7er"], [], []
    for k in range(300):
        w = prose(rnd, rnd.randint(20, 80)).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(i if i is None else i + 1000, t) for i, t in odd_rows]
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None), (1001, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert all(r.predicted == 0 for r in got if r.doc_id is None or r.doc_id >= 1000)
    none = toxicity.toxicity(docs(rows), lab.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.toxicity(docs([]), lab).count() == 0


def test_toxicity_of_frequent_words_and_near_copies(spark, docs):
    """A toxic word stays an entry when its contexts recur and near copies hold it; the copies' other words do not become entries."""
    rnd = random.Random(6)
    common = [prose(rnd, 1) for _ in range(40)]
    copied = [prose(rnd, 1, "uvwxyz") + "uvwxyz"[k % 6] * 3 for k in range(60)]
    rows, labels = [], []
    for k in range(1500):
        w = [rnd.choice(common) for _ in range(rnd.randint(20, 60))]
        if k % 3 == 1:
            w.insert(rnd.randrange(1, len(w)), "zorgle")
        elif k % 3 == 2:
            w = [prose(rnd, 1) if rnd.random() < 0.1 else x for x in copied]
            w.insert(30, "zorgle")
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 3 > 0)))
    weights, _, _ = toxicity.learn(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("zorgle".startswith(e) for e in weights)
    assert not any(w.startswith(e) for e in weights for w in copied)
    held = {k for k, _ in labels if k % 3 == 1}
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert all(r.predicted == 1 for r in toxicity.toxicity(docs(rows), lab).collect() if r.doc_id in held)


def test_language(spark, docs, odd_rows):
    rnd = random.Random(5)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "éèàbc"}
    rows = [(k, prose(rnd, 40, letters[lang]), lang) for k, lang in enumerate(list(letters) * 40)]
    one = docs([(i, t) for i, t, _ in rows] + [(None if i is None else i + 1000, t) for i, t in odd_rows])
    lang = F.create_map(*(F.lit(x) for i, _, v in rows for x in (i, v)))
    got = language.language_id(one.withColumn("lang", lang[F.col("doc_id").cast("int")])).collect()
    truth = {i: v for i, _, v in rows}
    assert len(got) == len(rows) + len(odd_rows)
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1001, 1002, 1003, 1010, None}
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep_identified(spark, one, "")
    assert kept.columns == one.columns and kept.where("doc_id in (1001, 1002, 1003, 1010)").count() == 0
    assert {r.lang_pred for r in language.language_id(one.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_id(docs([])).count() == 0


def test_out_of_place_distance():
    known, ranks = np.array([10, 20, 30]), np.array([[0, 1, 2], [5, 5, 0]])
    assert language.distances(np.array([20, 10, 99]), known, ranks, 5).tolist() == [1 + 1 + 5, 5 + 4 + 5]


def test_mixing(spark, docs, odd_rows):
    rnd = random.Random(6)
    rows = [(k, prose(rnd, 30)) for k in range(1500)]
    base = docs(rows).withColumns({"source": F.when(F.col("doc_id") % 10 < 7, "big").when(F.col("doc_id") % 10 < 9, "small"), "lang": F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("en")})
    targets = {"source": {"big": 0.4, "small": 0.4, "none": 0.2}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"short": 1.0}}
    got = mixing.mix(base, targets, 0.3).persist()
    total = got.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    all_tokens = got.agg(F.sum("tokens")).first()[0]
    assert abs(total / all_tokens - 0.3) < 0.01
    raked = {r.source: r.s for r in got.groupBy("source").agg((F.sum(F.col("tokens") * F.col("weight")) / all_tokens).alias("s")).collect()}
    assert all(abs(raked[k] - v) < 1e-6 for k, v in targets["source"].items())
    assert abs(got.where("kept").count() / 1500 - 0.3) < 0.08
    odd = mixing.mix(docs(odd_rows))
    assert odd.count() == len(odd_rows)
    stage = mixing.keep_sampled(spark, docs(odd_rows), "")
    assert stage.columns == docs([]).columns and stage.count() <= len(odd_rows)
    assert mixing.mix(docs([])).count() == 0


@pytest.mark.parametrize("text", ["", "ß", "a" * 50])
def test_beginnings(text):
    assert all(4 <= len(b) <= toxicity.LONGEST for b in toxicity.beginnings(toxicity.fold(text)))


def test_surprise_bounds_the_binomial_tail():
    for share in (0.1, 0.33):
        for n in (3, 10, 40):
            for k in range(1, n + 1):
                tail = sum(math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k, n + 1))
                assert math.exp(-toxicity.surprise(k, n, share)) >= tail - 1e-12


def test_chance_words_are_no_entries(spark, docs):
    """Of texts whose labels are drawn by lot, no beginning becomes an entry, though many are in toxic texts alone."""
    rnd = random.Random(8)
    rows = [(k, prose(rnd, 60)) for k in range(400)]
    labels = [(k, int(rnd.random() < 0.15)) for k, _ in rows]
    weights, exceptions, _ = toxicity.learn(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not weights and not exceptions


def test_lexicon_against_brute_force(spark, docs):
    """Scores equal those of a plain search of every entry at every word."""
    rnd = random.Random(9)
    weights, exceptions = {"zorg": 2.0, "zorgle": 3.5, "blim": 1.5}, ["the zorgle", "blim cup"]
    pieces = ["zorg", "zorgle", "zorglemore", "the zorgle", "blim", "blim cup", "bl1m", "z-o-r-g", "unblim", "a", "plain"]
    rows = [(k, " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30)))) for k in range(200)] + [(900, None), (901, "")]
    want = {}
    for k, text in rows:
        folded = toxicity.fold(text or "")
        masked = [(m.start(), m.end()) for e in exceptions for m in re.finditer(f"(?={re.escape(e)})", folded) for m in [re.compile(re.escape(e)).match(folded, m.start())]]
        total = 0.0
        for m in re.finditer(r"[^\W_]+", folded):
            own = [e for e in weights if m[0].startswith(e)]
            if own and not any(a <= m.start() and m.start() + len(max(own, key=len)) <= b for a, b in masked):
                total += weights[max(own, key=len)]
        want[k] = total
    got = {r.doc_id: r for r in toxicity.score(docs(rows), weights, exceptions, [-1.0, 0.5, 0.25]).collect()}
    assert {k: round(r.weight, 9) for k, r in got.items()} == {k: round(v, 9) for k, v in want.items()}
