"""Vectors, Jaccard join and byte repeats against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.llm import groups, jaccard, repeats, vectors


def closure(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, label int, cls string, n string")


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + rng.normal(scale=0.05, size=(30, 16)), base[:10], np.repeat(base[:1], 40, axis=0) + rng.normal(scale=0.02, size=(40, 16))]).astype(np.float32)
    label = [i % 3 for i in range(60)] + [i % 3 for i in range(30)] + [i % 3 if i < 8 else None for i in range(10)] + [0] * 40
    rows = [(int(i), [float(v) for v in x[i]], label[i]) for i in range(len(x))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0, 2.0], 1), (None, rows[0][1], 0), rows[5], (906, [], 0)]
    got = vectors.near_vectors(vector_table(spark, rows)).collect()
    assert len(got) == len(rows)
    good = {i: (np.array(v, float) / np.linalg.norm(np.array(v, float)), lab) for i, v, lab in rows if i is not None and i < 900 and lab is not None}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.93]
    n, comp = Counter(k for p in links for k in p), closure([r[0] for r in rows if r[0] is not None], links)
    for r in got:
        want = (n[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id) if r.vec_id is not None else (0, None, None)
        assert (r.n_links, r.component_id, r.kept) == want
    for n in (1, 100, 10_000, 10**6, 10**9):
        projections, tables = vectors.plan_for(n)
        assert vectors.recall_at(0.93, projections, tables) > 0.99 and n * vectors.cell_shared(0.0) ** projections <= 1


def test_vectors_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=16) + rng.normal(scale=0.05, size=(50, 16))
    got = vectors.near_vectors(vector_table(spark, [(i, [float(v) for v in r], 1) for i, r in enumerate(x)])).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    assert [r.n_links for r in sorted(got)] == want.tolist()


def test_empty_tables(spark, docs):
    assert vectors.near_vectors(vector_table(spark, [])).count() == 0
    assert jaccard.jaccard_join(docs([])).count() == 0
    assert repeats.digest(repeats.drop_repeats(docs([]))).count() == 0


def test_shingles_of_few_words():
    """A slice of texts may hold fewer words than a shingle."""
    one, two, none, again = jaccard.shingle_sets(["word", "two words", None, "word"])
    assert len(one) == len(two) == 1 and len(none) == 0 and one[0] == again[0] != two[0]
    assert jaccard.shingle_sets(["word"])[0] == one[0] and jaccard.shingle_sets(["two words", ""])[0] == two[0]


def shingles(text):
    w = jaccard.WORD.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_jaccard(rows):
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            sets[i] |= {frozenset(shingles(t))} - {frozenset()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if any(len(s & t) >= 0.8 * len(s | t) for s in sets[a] for t in sets[b])]
    return Counter(k for p in links for k in p), closure(ids, links)


def corpus(seed, n_groups=6, size=9):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    rows, i = [], 0
    for _ in range(n_groups):
        base = [word() for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, size)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = word()
            rows.append((i, " ".join(own)))
            i += 1
    rows += [(i + k, " ".join(word() for _ in range(50))) for k in range(20)]
    return rows


@pytest.mark.parametrize(("leaf", "chunk"), [(256, 512), (2, 3)])
def test_jaccard(spark, docs, odd_rows, leaf, chunk):
    rows = corpus(3)
    rows += rows[:3] + [(i + 1000 if i is not None else None, t) for i, t in odd_rows]
    n, comp = brute_jaccard(rows)
    got = jaccard.jaccard_join(docs(rows), leaf=leaf, chunk=chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.class_id) == ((n[r.doc_id], comp[r.doc_id]) if r.doc_id is not None else (0, None))
    assert 1 - (1 - jaccard.run_recall()) ** jaccard.runs_for() >= jaccard.TARGET_RECALL


def test_stage_keeps_one(spark, docs):
    rows = corpus(5)
    _, comp = brute_jaccard(rows)
    got = jaccard.keep_one_of_each(spark, docs(rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(comp.values()))
    assert got.columns == docs([]).columns


def test_components(spark):
    rnd = random.Random(1)
    chain = [(k, k + 1) for k in range(200)]
    rnd.shuffle(chain)
    edges = chain + [(1000, 1001), (1001, 1000), (5000, 5000)] + [(2000, 2000 + k) for k in range(1, 50)]
    got = {r.id: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[k] == 0 for k in range(201)) and got[1001] == 1000 and got[2049] == 2000 and 5000 not in got


def brute_repeats(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        raw = np.frombuffer(b, np.uint8)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(spark, docs, odd_rows, hot):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    shared, periodic = text(700), "ab" * 900
    rows = [(k, text(rnd.randint(0, 300)) + shared[rnd.randint(0, 200) :] + text(rnd.randint(0, 500))) for k in range(12)]
    rows += [(50, periodic), (51, text(100) + periodic[:1000]), (52, "x" * 1500), (53, shared), (53, shared), (54, text(2000)), (55, shared[:399]), (56, shared[:400]), (57, shared * 3)]
    rows += [(i if i is None else i + 100, t if t is None or len(t) < 5000 else t[:3000]) for i, t in odd_rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [tuple(r) for r in repeats.digest(repeats.drop_repeats(docs(rows), hot)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)


def test_long_text_is_read_in_strides(monkeypatch):
    monkeypatch.setattr(repeats, "STRIDE", 500)
    raw = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    first, n, _ = repeats.minimisers(raw)
    assert n.sum() == 5000 - 399 and first[0] == 0


def test_two_stage_order():
    rnd = random.Random(4)
    data = bytes(rnd.choice(b"abc") for _ in range(3000))
    order = repeats.two_stage(data, np.array([0, 1200]), np.array([600, 2000]))
    places = [*range(600), *range(1200, 2000)]
    assert sorted(order.tolist()) == places
    keys = [data[p : p + 400] for p in order.tolist()]
    assert keys == sorted(keys)
