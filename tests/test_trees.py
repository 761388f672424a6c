"""Trees against plain growers, spread fits against those on rows at hand, sweeps against separate fits."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.operators import jobs, landmarks, metrics, models, split, svm, sweeps, trees


def made_rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.3) > 0).astype(np.int64)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = made_rows()
    df = spark.createDataFrame([(f"r{k:04d}", int(t), *map(float, v)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "row_id string, y int, a double, b double, c double, d double, e double")
    return df, list("abcde")


def plain_forest(bins, y, keys, number, depth, leaf, seed):
    """The splits of one tree by node, each found by trying every cut on the node's own rows."""
    w = trees.weights(keys, seed, number)
    out, level, named = {}, {(): np.flatnonzero(w > 0)}, {(): 0}
    count = 1
    for _ in range(depth):
        after = {}
        for path in sorted(level, key=lambda p: named[p]):
            rows = level[path]
            n, s = w[rows].sum(), (w * y)[rows].sum()
            if path and not (0 < s < n and n >= 2 * leaf):
                continue
            best = None
            for c in trees.drawn_columns(seed, number, [named[path]], bins.shape[1], int(bins.shape[1] ** 0.5))[0]:
                for cut in range(trees.BINS):
                    go = bins[rows, c] <= cut
                    ln, ls = w[rows[go]].sum(), (w * y)[rows[go]].sum()
                    rn, rs = n - ln, s - ls
                    if min(ln, rn) < leaf:
                        continue
                    worth = (ls**2 + (ln - ls) ** 2) / ln + (rs**2 + (rn - rs) ** 2) / rn
                    if best is None or worth > best[0] * (1 + 1e-13):
                        best = worth, int(c), cut, rows[go], rows[~go]
            if best is None or best[0] <= (s**2 + (n - s) ** 2) / n * (1 + 1e-12):
                continue
            out[named[path]] = best[1:3]
            for side, part in ((0, best[3]), (1, best[4])):
                named[(*path, side)] = count
                count += 1
                after[(*path, side)] = part
        level = after
    return out


def splits(tree):
    return {k: (c, tree.cut[k]) for k, c in enumerate(tree.column) if c >= 0}


@pytest.mark.parametrize("leaf", [1, 4])
def test_forest_is_the_plain_one(leaf):
    x, y = made_rows(300)
    bins, keys = trees.binned(x, trees.quantile_edges(x, trees.BINS)), np.arange(300).astype(np.uint64)
    made = trees.local_forest(bins, y, keys, range(4), 6, leaf, 7)
    for t, tree in enumerate(made):
        got = splits(tree)
        assert len(got) > 5 and got == plain_forest(bins, y, keys, t, 6, leaf, 7)
        w, at = trees.weights(keys, 7, t), trees.walk(bins, tree.arrays())
        for node in set(at.tolist()):
            own = at == node
            if w[own].sum():
                assert tree.value[node] == pytest.approx((w * y)[own].sum() / w[own].sum())
    # Fewer levels or trees are the beginning of more.
    few = trees.local_forest(bins, y, keys, range(1, 3), 3, leaf, 7)
    assert [trees.walk(bins, t.arrays()).tolist() for t in few] == [trees.walk(bins, t.arrays(3)).tolist() for t in made[1:3]]
    assert abs(np.mean([trees.weights(np.arange(20_000).astype(np.uint64), 1, t).mean() for t in range(3)]) - 1) < 0.02


def plain_boosted(bins, y, rounds, rate, depth):
    """Trees as {path: split} and the values of their leaves, split leaf by leaf on the leaf's own rows."""
    raw = np.full(len(y), np.log(y.sum() / (len(y) - y.sum())))
    out = []
    for _ in range(rounds):
        g, h = (v / trees.SCALE for v in trees.slopes(raw, y))

        def best(rows, g=g, h=h):
            found = None
            for c in range(bins.shape[1]):
                for cut in range(trees.BOOSTING_BINS):
                    go = bins[rows, c] <= cut
                    a, b = rows[go], rows[~go]
                    if min(len(a), len(b)) < trees.LEAF_ROWS or min(h[a].sum(), h[b].sum()) < trees.LEAF_CURVATURE:
                        continue
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = gain, c, cut, a, b
            return found

        leaves, heap, taken, k = {(): np.arange(len(y))}, [], {}, 0
        if (f := best(leaves[()])) and depth:
            heap = [(-f[0], k, (), f)]
        while heap and len(leaves) < trees.MOST_LEAVES:
            _, _, path, f = heapq.heappop(heap)
            taken[path] = f[1:3]
            del leaves[path]
            for side, rows in ((0, f[3]), (1, f[4])):
                leaves[(*path, side)] = rows
                if len(path) + 1 < depth and (nxt := best(rows)):
                    k += 1
                    heapq.heappush(heap, (-nxt[0], k, (*path, side), nxt))
        values = {p: -rate * g[r].sum() / h[r].sum() for p, r in leaves.items()} if taken else {}
        for p, r in leaves.items():
            raw[r] += values.get(p, 0.0)
        out.append((taken, values))
    return out


def as_paths(tree):
    taken, values, todo = {}, {}, [(0, ())]
    while todo:
        node, path = todo.pop()
        if tree.column[node] < 0:
            values[path] = tree.value[node]
        else:
            taken[path] = tree.column[node], tree.cut[node]
            todo += [(tree.left[node] + s, (*path, s)) for s in (0, 1)]
    return taken, values if taken else {}


@pytest.mark.parametrize(("depth", "leaves"), [(3, 31), (10, 31), (10, 6)])
def test_boosted_trees_are_the_plain_ones(depth, leaves, monkeypatch):
    monkeypatch.setattr(trees, "MOST_LEAVES", leaves)
    monkeypatch.setattr(trees.Growing.__init__, "__defaults__", (leaves,))
    x, y = made_rows(400, 3)
    bins = trees.binned(x, trees.quantile_edges(x, trees.BOOSTING_BINS))
    chains = [trees.Chain(4, 0.2, depth), trees.Chain(2, 0.2, depth)]
    trees.local_boosted(bins, y, chains)
    for got, (taken, values) in zip(chains[0].trees, plain_boosted(bins, y, 4, 0.2, depth), strict=True):
        own, at = as_paths(got)
        assert own == taken and set(at) == set(values)
        assert all(at[p] == pytest.approx(values[p], abs=1e-6) for p in at)
    assert [as_paths(t) for t in chains[1].trees] == [as_paths(t) for t in chains[0].trees[:2]]


@pytest.mark.parametrize("parts", [1, 5])
def test_spread_fits_are_the_local_ones(table, parts, monkeypatch):
    df, columns = table
    df = df.repartition(parts)
    rows = df.select(F.xxhash64(*df.columns).alias("key"), "y", *columns).collect()
    x, y, keys = np.array([[r[c] for c in columns] for r in rows]), np.array([r.y for r in rows]), np.array([r.key for r in rows], np.int64).view(np.uint64)
    monkeypatch.setattr(trees, "table_edges", lambda d, c, bins: trees.quantile_edges(x, bins))
    monkeypatch.setattr(trees, "PASS_BYTES", 20_000)  # several passes a level
    edges, made = trees.forest(df, columns, "y", 6, 5, 1, 11, parts)
    bins = trees.binned(x, edges)
    assert [as_paths(t) for t in made] == [as_paths(t) for t in trees.local_forest(bins, y, keys, range(6), 5, 1, 11)]
    far, near = ([trees.Chain(3, 0.1, 4), trees.Chain(2, 0.3, 2)] for _ in range(2))
    edges = trees.boosted(df, columns, "y", far, parts)
    trees.local_boosted(trees.binned(x, edges), y, near)
    assert [[as_paths(t) for t in c.trees] for c in far] == [[as_paths(t) for t in c.trees] for c in near]


def test_table_edges(spark):
    df = spark.createDataFrame([(float(k % 7), float(k), None if k % 3 else 1.0, float("nan") if k % 2 else 5.0) for k in range(2000)], "a double, b double, c double, d double")
    a, b, c, d = trees.table_edges(df, list("abcd"), 32)
    assert a.tolist() == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and len(b) == 31 and len(c) == 0 and len(d) == 0
    assert np.abs(np.diff(np.searchsorted(b, np.arange(2000)).cumsum()[:0])).sum() == 0
    assert trees.table_edges(df.limit(0), ["a"], 32)[0].tolist() == []


def test_trees_score_and_take_odd_tables(spark, table):
    df, columns = table
    for fitted in (models.forest(df, columns, trees=20), models.boosting(df, columns, rounds=15)):
        got = models.evaluate_once(fitted, df)
        assert got["n"] == 600 and got["accuracy"] > 0.8 and got["auc"] > 0.9
        assert fitted.transform(df.limit(0)).count() == 0
        assert set(fitted.transform(df).columns) == {*df.columns, "score", "pred"}
        holes = df.withColumn("a", F.when(F.col("row_id") < "r0300", F.lit(None)).otherwise(F.col("a")))
        assert fitted.transform(holes).where("score IS NULL OR isnan(score)").count() == 0
    one = df.where("y = 1")
    assert {r.score for r in models.forest(one, columns, trees=3).transform(one).collect()} == {1.0}
    assert models.boosting(one, columns, rounds=2).transform(one).where("pred = 0").count() == 0
    grid = [{"trees": 5, "depth": 3}, {"trees": 9, "depth": None, "leaf": 3}, {"trees": 3, "depth": 6}]
    cells = models.forests(df, columns, "y", grid)
    alone = [models.forests(df, columns, "y", [p])[0] for p in grid]
    assert [[r.score for r in f.transform(df).orderBy("row_id").collect()] for f in cells] == [[r.score for r in f.transform(df).orderBy("row_id").collect()] for f in alone]


def test_a_sweep_is_its_separate_fits(spark, table):
    df, columns = table
    cells = {"rf": {"trees": 7, "depth": 4}, "svm": {"c": 5.0, "gamma": 0.3}, "qsvc": {"c": 2.0}, "hgb": {"rounds": 4, "rate": 0.3, "depth": 3}}
    names, sets = ["rf", "svm", "qsvc", "hgb"], {"all": columns, "two": ["b", "a"]}
    got = jobs.learning_curves(df, sets, names, "row_id", sizes=(60, 150), test=200, seeds=(1, 2), cells=cells).collect()
    assert len(got) == 2 * 2 * 2 * 4 and all(r.status == "ok" and r.n == 200 for r in got)
    for r in got:
        if (r.seed, r.n_train, r.feature_set) != (2, 150, "two"):
            continue
        dealt = split.partitions(df, {"train": 150, "test": 200}, "row_id", "y", r.seed).cache()
        train, test = split.sample(dealt.where("split = 'train'"), r.n_train, "row_id", "y", r.seed), dealt.where("split = 'test'")
        own = sets[r.feature_set]
        rows = train.select(F.xxhash64("row_id").alias("key"), "y", *own).orderBy("key").collect()
        x, y, keys = np.array([[v[c] for c in own] for v in rows]), np.array([v.y for v in rows]), np.array([v.key for v in rows], np.int64).view(np.uint64)
        if r.model in ("svm", "qsvc"):
            fitted = models.FITTERS[r.model](train, own, **cells[r.model])
            want = models.evaluate_once(fitted, test)
            assert abs(want["auc"] - r.auc) < 2e-3 and abs(want["accuracy"] - r.accuracy) <= 0.01
        else:
            score = sweeps.CELLS[r.model](x, y, keys, [cells[r.model]], r.seed)[0]
            judged = test.select("y", *own).collect()
            p, pred = score(np.array([[v[c] for c in own] for v in judged]))
            assert np.mean(pred == np.array([v.y for v in judged])) == pytest.approx(r.accuracy, abs=1e-6)
    for seed in (1, 2):
        assert sorted(split.partitions_by_seed(df, {"train": 150, "test": 200}, "row_id", "y", (2, 1)).where(f"seed = {seed}").select("row_id", "split").collect()) == sorted(split.partitions(df, {"train": 150, "test": 200}, "row_id", "y", seed).select("row_id", "split").collect())


def test_local_machines_are_the_spread_ones(table):
    df, columns = table
    rows = df.select("y", *columns).collect()
    x, y = np.array([[r[c] for c in columns] for r in rows]), np.array([r.y for r in rows])
    features = landmarks.local_landmarks(x, 0.2, most=30).features
    for (w, b), (v, c) in zip(svm.fit_local(x, y, features, [0.5, 20.0]), svm.fit(df.repartition(3), columns, "y", features, [0.5, 20.0], 3), strict=True):
        assert np.abs(w - v).max() < 1e-3 and abs(b - c) < 1e-3


def test_tuning_and_choice(spark, table):
    df, columns = table
    got = jobs.tuning(df, columns, ["rf", "svm"], "row_id", sizes={"train": 150, "tune": 100}, seeds=(1, 2, 3), grids={"rf": [{"trees": 5, "depth": 2}, {"trees": 9, "depth": 5}], "svm": [{"c": 1.0, "gamma": "scale"}]}).collect()
    assert {(r.model, r.grid_pos, r.seeds) for r in got} == {("rf", 0, 3), ("rf", 1, 3), ("svm", 0, 3)}
    assert sum(r.best for r in got) == 2 and max((r for r in got if r.model == "rf"), key=lambda r: r.f1_mean).best
    bench = jobs.benchmark(df, {"all": columns}, ["hgb", "absent"], "row_id", sizes={"train": 200, "tune": 100, "cal": 150, "test": 150}, seeds=(4,), grids={"hgb": [{"rounds": 1, "rate": 0.01, "depth": 1}, {"rounds": 20, "rate": 0.3, "depth": 4}]}).collect()
    assert [r.status for r in bench if r.model == "absent"] == ["failed: KeyError: 'absent'"] * 2
    assert all(r.status == "ok" and r.cells == 2 and "rounds\": 20" in r.params and r.tune_f1 > 0.8 and r.auc > 0.9 for r in bench if r.model == "hgb")
    # Of some 75 negatives a hundredth is less than one: no threshold, and no counts.
    assert [(r.threshold is None, r.tn + r.fp + r.fn + r.tp) for r in bench if r.model == "hgb"] == [(True, 0), (False, 150)]
    once = jobs.tuned(df, columns, ["rf", "absent"], "row_id", sizes={"train": 200, "tune": 100, "cal": 1, "test": 150}, seed=4, grids={"rf": [{"trees": 1, "depth": 1}, {"trees": 20, "depth": 6}]}).collect()
    assert [(r.model, r.status, r.n) for r in once] == [("rf", "ok", 150), ("absent", "failed: KeyError: 'absent'", 0)] and once[0].auc > 0.8 and '"depth": 6' in once[0].params
    with pytest.raises(RuntimeError, match="KeyError"):
        jobs.learning_curves(df, columns, ["absent"], "row_id", sizes=(50,), test=50, seeds=(1,))
    with pytest.raises(ValueError):
        jobs.learning_curves(df, columns, ["rf"], "row_id", sizes=(5000,), test=50, seeds=(1,))
    with pytest.raises(ValueError):
        sweeps.check_size(sweeps.MOST + 1)


def test_cross_validation_is_the_mean_of_its_folds(table):
    df, columns = table
    grid = [{"trees": 4, "depth": 3, "leaf": 1}, {"trees": 6, "depth": 5, "leaf": 2}]
    got = models.cross_validate("rf", df, columns, "row_id", grid=grid, k=3)
    dealt = split.folds(df, 3, "row_id", "y", 42)
    for pos, p in enumerate(grid):
        scores = []
        for f in range(3):
            rows = dealt.select((F.col("fold") != f).alias("train"), F.xxhash64("row_id").alias("key"), "y", *columns).orderBy("key").collect()
            x, y, keys, on = np.array([[v[c] for c in columns] for v in rows]), np.array([v.y for v in rows]), np.array([v.key for v in rows], np.int64).view(np.uint64), np.array([v.train for v in rows])
            s, _ = sweeps.forests(x[on], y[on], keys[on], [p], 42)[0](x[~on])
            made = df.sparkSession.createDataFrame([("m", int(a), float(b)) for a, b in zip(y[~on], s, strict=True)], "m string, y int, score double")
            scores.append(metrics.auc(made, ["m"]).first().auc)
        assert got[pos]["auc"] == pytest.approx(np.mean(scores), abs=1e-9)


def test_boosting_counts_equal_rows_once(spark, table):
    """Copies of rows are cells with numbers, and the trees are those on all rows; sums of large numbers stay exact."""
    df, columns = table
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(7))))
    chain, near = trees.Chain(3, 0.1, 4), trees.Chain(3, 0.1, 4)
    edges = trees.boosted(copies, columns, "y", [chain], 2)
    rows = df.select("y", *columns).collect()
    x, y = np.array([r[1:] for r in rows]), np.array([r.y for r in rows])
    trees.local_boosted(np.repeat(trees.binned(x, edges), 7, axis=0), np.repeat(y, 7), [near])
    assert [as_paths(t) for t in chain.trees] == [as_paths(t) for t in near.trees]
    found = trees.cells(copies, columns, "y", edges).agg(F.count("*"), F.sum("n")).first()
    assert found[0] <= 600 and found[1] == 4200
    n = np.array([1, 4095, 4096, (1 << 30) + 3], np.int64)
    got = trees.counted_cells(np.zeros((4, 1), np.uint8), np.array([0, 0, -1, 0]), np.zeros((1, 1), np.int64), 2, n, np.array([-3.0, 5.0, 1.0, 7.0]), np.ones(4))
    total = 1 + 4095 + (1 << 30) + 3
    assert got[:, 0, 0, 0].tolist() == [total, -3 + 5 * 4095 + 7 * ((1 << 30) + 3), total]


def test_rows_that_are_not_drawn_are_not_walked(monkeypatch):
    """A pass walks a tree with the rows that it drew alone, and counts what one over all rows counts."""
    rng = np.random.default_rng(6)
    bins, y, keys = rng.integers(0, 8, (5000, 3)), rng.integers(0, 2, 5000), rng.integers(0, 2**60, 5000).astype(np.uint64)
    made, walked = trees.local_forest(bins, y, keys, range(2), 2, 1, 42, 8), []
    monkeypatch.setattr(trees, "walk", lambda b, t, was=trees.walk: (walked.append(len(b)), was(b, t))[1])
    asked = {}
    for t, tree in enumerate(made):
        arrays = tree.arrays()
        asked[t] = (arrays, np.arange(len(arrays[0])), np.tile(np.arange(3), (len(arrays[0]), 1)))
    got = dict(trees.forest_counts(bins, y, keys, 42, asked, 8))
    for t, (arrays, number, columns) in asked.items():
        w = trees.weights(keys, 42, t)
        assert walked[t] == (w > 0).sum()
        want = trees.counted(bins, number[trees.walk(bins, arrays)], columns, 8, w, w * y)
        assert np.array_equal(got[t], want)
