"""Preparation, splitting, selection, kernels, cost models and sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.operators import kernel, models, neighbours, prepare, profile, projection, select, split
from sparkvane.sources import tables


def small(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"r{i:04d}", float(rng.lognormal(3, 1)), float(rng.normal()), int(i % 2), "ab"[i % 3 == 0], int(i % 5 < 2)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id string, heavy double, plain double, flag int, kind string, label int")


def test_fit_ignores_test_rows(spark):
    train, test = small(spark), small(spark, seed=4)
    wild = test.withColumns({"heavy": F.col("heavy") * 10000 + 99999, "plain": F.lit(1e9)})
    a, b = (prepare.Scaler(train, ["heavy", "plain"]) for _ in range(2))
    assert a.fit == b.fit and a.heavy == ["heavy"] and a.order() == ["heavy", "plain"]
    one, _ = prepare.prepare(train, test, ["heavy", "plain"], ["kind"], ("row_id",))
    two, _ = prepare.prepare(train, wild, ["heavy", "plain"], ["kind"], ("row_id",))
    assert one.orderBy("row_id").collect() == two.orderBy("row_id").collect()
    assert one.columns == ["row_id", "heavy", "plain", "kind=a", "kind=b"]


def test_unknown_category_is_all_zero(spark):
    train, test = small(spark), small(spark).withColumn("kind", F.lit("new"))
    _, got = prepare.prepare(train, test, [], ["kind"])
    assert got.agg(F.sum("`kind=a`"), F.sum("`kind=b`")).first() == (0.0, 0.0)


def test_angles(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, b double")
    s = prepare.AngleScaler(df, ["a", "b"])
    got = s.transform(spark.createDataFrame([(-5.0, 1.0), (5.0, 9.0), (50.0, 5.0)], "a double, b double")).collect()
    assert [(r.a, r.b) for r in got] == [(0.0, 0.0), (math.pi / 2, 0.0), (math.pi, 0.0)]
    for bad in ([], ["a"]):
        with pytest.raises(ValueError):
            prepare.AngleScaler(df.withColumn("a", F.lit(float("nan"))), bad)
    with pytest.raises(ValueError):
        prepare.AngleScaler(df.limit(0), ["a"])
    with pytest.raises(ValueError):
        s.transform(df.select("a"))


def test_dedup_keeps_the_first_and_differing_labels(spark):
    df = spark.createDataFrame([(2, "x", 0), (1, "x", 0), (3, "x", 1), (4, None, 1), (5, None, 1)], "id int, a string, label int")
    assert sorted(r.id for r in prepare.dedup(df, "id").collect()) == [1, 3, 4]
    assert prepare.dedup_report(df, "id").first().pct_removed == 40.0


def test_clean_category(spark):
    df = spark.createDataFrame([(None,), ("  a ",), ("",)], "c string")
    assert [r[0] for r in df.select(prepare.clean_category(F.col("c"))).collect()] == ["Normal", "a", ""]
    with pytest.raises(ValueError):
        prepare.features_and_target(df, "label", ())


def test_roles(spark):
    assert {r.name: r.role for r in profile.roles(small(spark)).collect()} == {"row_id": "categorical", "kind": "categorical", "heavy": "numeric", "plain": "numeric", "flag": "binary", "label": "binary"}
    assert profile.kernel_pool(small(spark), ("label",)) == ["flag", "heavy", "plain"]


def test_moments_are_bias_adjusted(spark):
    x = [1.0, 2.0, 3.0, 10.0]
    r = prepare.moments(spark.createDataFrame([(v,) for v in x], "x double"), ["x"]).first()
    m, s = np.mean(x), np.std(x)
    assert abs(r["skew"] - np.mean((np.array(x) - m) ** 3) / s**3 * math.sqrt(12) / 2) < 1e-9


@pytest.mark.parametrize("bad", [{"a": 1.0}, {"a": 1.0, "b": "x"}, {"a": 1.0, "b": None}, {"a": 1.0, "b": math.nan}, {"a": math.inf, "b": 0.0}, [1.0], [1.0, 2.0, 3.0]])
def test_bad_flows(bad):
    with pytest.raises(ValueError):
        prepare.check_flow(bad, ["a", "b"])


@pytest.mark.parametrize("good", [{"a": 1, "b": 2.0}, [1, 2.0], np.array([1.0, 2.0]), np.array([[1.0, 2.0]]), (1.0, 2.0)])
def test_good_flows(good):
    assert prepare.check_flow(good, ["a", "b"]) == [1.0, 2.0]


def test_negative_flow():
    assert prepare.check_flow([-1.0, 0.0], ["a", "b"]) == [-1.0, 0.0]
    with pytest.raises(ValueError):
        prepare.check_flow([-1.0, 0.0], ["a", "b"], non_negative=True)


def test_quarantine(spark):
    df = spark.createDataFrame([(1.0, "2"), (None, "2"), (math.nan, "1"), (1.0, "x"), (-1.0, "1")], "a double, b string")
    assert [r.reject_reason for r in prepare.quarantine(df.withColumn("b", F.expr("try_cast(b AS double)")), ["a", "b"], True).collect()] == [None, "a: missing", "a: not finite", "b: missing", "a: negative"]


def test_partitions(spark):
    df = small(spark)
    a = split.partitions(df, {"train": 100, "tune": 50, "test": 100}, "row_id", "label", 1)
    assert {r.split: r.n for r in a.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 100, "tune": 50, "test": 100}
    split.check_disjoint(a, "row_id")
    share = {r.split: r.s for r in a.groupBy("split").agg(F.avg("label").alias("s")).collect()}
    assert all(abs(s - 0.4) < 0.02 for s in share.values())
    again = split.partitions(df.repartition(7), {"train": 100, "tune": 50, "test": 100}, "row_id", "label", 1)
    key = lambda x: sorted((r.row_id, r.split) for r in x.collect())
    assert key(a) == key(again) != key(split.partitions(df, {"train": 100, "tune": 50, "test": 100}, "row_id", "label", 2))
    with pytest.raises(ValueError):
        split.partitions(df, {"train": 401}, "row_id", "label", 1)
    with pytest.raises(ValueError):
        split.bounded_partitions(df, 101, 50, 100, "row_id", "label", 1)
    with pytest.raises(RuntimeError):
        split.check_disjoint(a.unionByName(a.withColumn("split", F.lit("other"))), "row_id")


def test_fraction_split_takes_the_first_ranks(spark):
    """Of each label the first of the hash order, the fraction rounded up, whatever bin they end in; nothing and all are fractions, too."""
    df = spark.range(3001).selectExpr("concat('r', id) AS row_id", "CASE WHEN id < 7 THEN 2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS y")
    ranks = {r.row_id: (r.y, r.place) for r in split.ranked(df, "row_id", "y", 42).collect()}
    sizes = {v: sum(y == v for y, _ in ranks.values()) for v in (0, 1, 2)}
    for fraction in (0.0, 0.2, 0.37, 1.0):
        got = {r.row_id: r.split for r in split.fraction_split(df, fraction, "row_id", "y", 42).collect()}
        assert got == {k: "validation" if place < math.ceil(fraction * sizes[y]) else "train" for k, (y, place) in ranks.items()}


def test_folds_and_landmarks(spark):
    df = small(spark)
    f = split.folds(df, 5, "row_id", "label", 3).groupBy("fold", "label").count().collect()
    assert {(r.label, r["count"]) for r in f} == {(0, 48), (1, 32)}
    few, many = ({r.row_id for r in split.landmarks(df, m, "row_id", 3).collect()} for m in (5, 20))
    assert few < many and len(few) == 5


def test_quotas():
    assert split.quotas({0: 5, 1: 5}, 3) == {0: 2, 1: 1}
    with pytest.raises(ValueError):
        split.quotas({0: 1}, 2)


def test_selection(spark):
    rng = np.random.default_rng(0)
    y = np.arange(200) % 2
    high = 2 * y + rng.normal(0, 0.2, 200)
    rows = zip([str(i) for i in range(200)], y.tolist(), high.tolist(), (high + rng.normal(0, 0.01, 200)).tolist(), [0.0] * 200, (1.5 * y + rng.normal(0, 0.5, 200)).tolist(), strict=True)
    df = spark.createDataFrame(list(rows), "row_id string, y int, f_high double, f_twin double, f_constant double, f_indep double")
    got = select.select_features(df, ["f_high", "f_twin", "f_constant", "f_indep"], "y", "row_id", 2)
    kept = {"f_high", "f_twin"} & set(got["survivors"])
    assert "f_constant" not in got["mi"] and len(kept) == 1
    assert got["mi"][kept.pop()] == max(got["mi"].values())
    assert got["selected"][0] in ("f_high", "f_twin")
    assert select.select_features(df, ["f_constant"], "y", "row_id")["selected"] == []


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 7, 300)
    df = spark.createDataFrame([(str(i), float(x), float(x + y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "row_id string, a double, b double")
    import pandas as pd

    p = pd.DataFrame({"a": a, "b": a + b})
    assert abs(select.spearman(df, ["a", "b"]).first().rho - p.rank().corr().loc["a", "b"]) < 1e-6


def test_prune_and_mrmr():
    mi, rho = {"a": 0.5, "b": 0.5, "c": 0.4}, {("a", "b"): 0.95, ("b", "a"): 0.95, ("a", "c"): 0.9, ("c", "a"): 0.9, ("b", "c"): 0.1, ("c", "b"): 0.1}
    kept, dropped = select.prune(mi, rho)
    assert kept == ["b", "c"] and dropped[0]["name"] == "a" and dropped[0]["kept"] == "b"
    assert select.mrmr(mi, rho, 2) == ["b", "c"] and select.mrmr(mi, rho, 9, quotient=True)[0] == "b"


def test_kernel_invariants():
    rng = np.random.default_rng(0)
    a, b = kernel.states(rng.uniform(0, math.pi, (8, 4))), kernel.states(rng.uniform(0, math.pi, (3, 4)))
    k = kernel.fidelity(a)
    kernel.invariants(k)
    assert kernel.fidelity(a, b).shape == (8, 3)
    f, g = kernel.explicit_map(a), kernel.explicit_map(b)
    assert np.abs(f @ g.T - kernel.fidelity(a, b)).max() < 1e-12 and f.shape[1] == 256
    parts = np.concatenate(list(kernel.chunked_states(iter([rng.uniform(0, 3, (5, 4))]))))
    assert parts.shape == (5, 16)
    with pytest.raises(ValueError):
        kernel.fidelity(a, kernel.states(rng.uniform(0, 1, (2, 3))))
    for bad in (np.ones((2, 3)), np.ones(3), [[1, 0.3], [0.1, 1]], np.eye(3) * 0.8, [[1, 1.05], [1.05, 1]], [[1, -0.05], [-0.05, 1]], [[1, 0.9, 0], [0.9, 1, 0.9], [0, 0.9, 1]]):
        with pytest.raises(ValueError):
            kernel.invariants(bad)
    kernel.invariants([[1, 0.9, 0], [0.9, 1, 0.9], [0, 0.9, 1]], least=-0.3)
    for x, reps in ((np.zeros((2, 1)), 2), (np.zeros((2, 2)), 0)):
        with pytest.raises(ValueError):
            kernel.states(x, reps)
    kernel.invariants(kernel.sampled_kernel(k), diagonal=1, symmetry=1e-9)


def test_nystrom_is_exact_at_full_rank():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    assert kernel.nystrom_errors(x @ x.T, 10)["frobenius"] < 1e-8


def test_states_in_columns_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, math.pi, (6, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    slow = kernel.embed(df, list("abcd"), fast=False).orderBy("id").collect()
    fast = kernel.embed(df, list("abcd")).orderBy("id").collect()
    want = kernel.states(x)
    for rows in (slow, fast):
        assert np.abs(np.array([r.re for r in rows]) - want.real).max() < 1e-12
        assert np.abs(np.array([r.im for r in rows]) - want.imag).max() < 1e-12


def test_kernel_cache(spark, tmp_path):
    c = kernel.KernelCache(spark, str(tmp_path))
    e = spark.createDataFrame([(i, j, float(i == j)) for i in range(5) for j in range(5)], "i int, j int, k double")
    assert c.get("x", {"h": "1"}, 5, 5) is None
    c.put("x", e, {"h": "1"})
    assert c.get("x", {"h": "1"}, 5, 5).count() == 25
    assert c.get("x", {"h": "1"}, 4, 5) is None and c.get("x", {"h": "2"}, 5, 5) is None
    assert kernel.cache_key("a", {"n": 1}, 1, ["b", "a"], []) == kernel.cache_key("a", {"n": 1}, 1, ["a", "b"], [])


def test_projection(spark):
    assert projection.must_stop(None, None, 100) == (False, None)
    assert projection.must_stop(100, 121.5, 200)[0]
    assert projection.must_stop(100, 50, 200) == (True, 200)
    assert projection.must_stop(50, 10, 100) == (False, 40)
    for n, t in ((0, 1), (10, -1)):
        with pytest.raises(ValueError):
            projection.project_seconds(n, t, 10)
    runs = spark.createDataFrame([("s", 50, 9.384), ("s", 100, 37.6383), ("s", 200, 150.9296), ("s", 400, 600.0)], "series string, n int, seconds double")
    assert [r.skipped for r in projection.stop_rules(runs).orderBy("n").collect()] == [False, False, False, True]
    full = {r.kernel: r for r in projection.full_scale(runs.where("n <= 200"), 82332, 175341).collect()}
    assert abs(full["train"].days - 296.03) < 0.01 and abs(full["train"].gib - 50.50) < 0.01 and abs(full["test"].days - 630.45) < 0.01


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "id int, y_true int, pred int")
    tables.write_predictions(df, str(tmp_path / "p"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "p"))
    assert tables.check_predictions(back, ["y_true"], ["y_true", "pred"]).count() == 2
    for required, binary in ((["nope"], []), ([], ["id"])):
        with pytest.raises(ValueError):
            tables.check_predictions(back, required, binary)
    with pytest.raises(FileNotFoundError):
        tables.scan_csv(spark, str(tmp_path / "none"))
    tables.write_report({"a": 1}, tmp_path / "x" / "r.json")
    assert tables.report_or(tmp_path / "x" / "r.json", {}) == ({"a": 1}, True) and tables.report_or(tmp_path / "none", {"b": 2}) == ({"b": 2}, False)
    assert tables.scan_json(spark, str(tmp_path / "x" / "r.json")).first().a == 1
    assert tables.content_hash(df) == tables.content_hash(df.orderBy(F.desc("id"))) != tables.content_hash(df.where("id = 1"))


def test_models_and_bundle(spark, tmp_path):
    df = small(spark, 120).withColumn("y", F.col("label")).withColumn("plain", F.col("plain") + 3 * F.col("label")).select("row_id", "y", "heavy", "plain").persist()
    for name in ("rf", "qsvc"):
        got = models.evaluate_once(models.FITTERS[name](df, ["heavy", "plain"]), df)
        assert got["n"] == 120 and got["auc"] > 0.8
    m = models.save_pipeline(models.forest_stages(["heavy", "plain"], trees=5), df, str(tmp_path / "m"))
    same = models.load_pipeline(str(tmp_path / "m"))
    assert [r.prediction for r in m.transform(df).orderBy("row_id").collect()] == [r.prediction for r in same.transform(df).orderBy("row_id").collect()]
    with pytest.raises(ValueError):
        models.margin_or_probability(df)
    with pytest.raises(ValueError):
        models.checked_scores(spark.createDataFrame([], "score double"))


def test_neighbours_strictly_inside(spark):
    """The k-th neighbour is not counted, whatever the offset of the values; estimates keep what a feature tells."""
    rng = np.random.default_rng(0)
    for offset in (0.0, 1e6):
        x = offset + rng.normal(size=300)
        order = np.sort(x)
        gaps = np.abs(order[None, :] - x[:, None])
        radius = np.sort(gaps, axis=1)[:, 3]
        assert neighbours.inside(order, x, radius).tolist() == (gaps < radius[:, None]).sum(axis=1).tolist()
    y = (rng.random(4000) < 0.25).astype(int)
    for shift, want in ((0.5, 0.023), (1.0, 0.086)):
        assert abs(select.information(rng.normal(size=4000) + shift * y, y) - want) < 0.03
    assert select.information(rng.normal(size=4000) + 2.0 * y, y) > 0.2
    df = spark.createDataFrame([(str(k), float(v), int(c)) for k, (v, c) in enumerate(zip(rng.normal(size=4000) + 1.0 * y, y, strict=True))], "row_id string, x double, y int")
    assert abs(select.neighbour_information(df, ["x"], "y", "row_id").first().mi - 0.086) < 0.03


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_neighbours_across_ranges(spark, parts):
    """Over any number of ranges the estimate is that of all rows at once: ties, rare classes, nulls, classes of one."""
    rng = np.random.default_rng(parts)
    y = np.where(rng.random(900) < 0.9, 0, rng.integers(1, 4, 900)).astype(float)
    y[:2], y[2] = 7, 9
    a, b, c = rng.normal(size=900) + y, rng.integers(0, 4, 900) + (y > 1) * 1.0, np.full(900, 5.0)
    rows = [(f"r{k}", *(None if (k + j) % 50 == 7 else float(v) for j, v in enumerate(t)), None if k % 60 == 9 else float(y[k])) for k, t in enumerate(zip(a, b, c, strict=True))]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, c double, label double")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["name"]: r.mi for r in neighbours.neighbour_information(df, ["a", "b", "c"], "label", "row_id").collect()}
        assert neighbours.neighbour_information(df.limit(0), ["a"], "label", "row_id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    values = neighbours.moved(df, ["a", "b", "c"], "label", "row_id", 42).toPandas()
    for name, own in values.groupby("name"):
        assert got[name] == pytest.approx(neighbours.information(own["x"].to_numpy(), own["y"].to_numpy(), seed=None), abs=1e-9)
    assert got["a"] > 0.05
    n = np.array([1, 2, 15, 16, 17, 1000])
    want = [sum(1 / i for i in range(1, v)) - 0.5772156649015329 for v in n]
    assert np.abs(neighbours.digamma(n) - want).max() < 1e-11
    column = spark.createDataFrame([(int(v),) for v in n], "n long").select(neighbours.digamma_column(F.col("n")).alias("d")).toPandas()["d"]
    assert np.abs(np.sort(column) - np.sort(want)).max() < 1e-11


def test_complements_are_selections_outside_each_fold(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{k}", float(rng.integers(0, 5)), float(rng.normal()), 3.0 if k % 100 else 4.0, None if k % 9 == 4 else float(rng.integers(0, 50)), int(rng.integers(0, 2)), k % 3) for k in range(400)]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, c double, d double, y int, fold int")
    found = select.complements(df, ["a", "b", "c", "d"], "y", "fold", 3, True)
    near = neighbours.complement_information(df, ["a", "b"], "y", "row_id", "fold", 3, 5)
    for f, (kept, mi, rho) in found.items():
        own = df.where(F.col("fold") != f)
        assert sorted(kept) == sorted(r["name"] for r in select.spread(own, ["a", "b", "c", "d"]).where("kept").collect())
        assert mi == {r["name"]: r.mi for r in select.binned_information(own, ["a", "b", "c", "d"], "y").collect()}
        want = select.rho_table(select.spearman(own, ["a", "b", "c", "d"]).collect())
        assert rho.keys() == want.keys() and all(abs(rho[p] - want[p]) < 1e-9 for p in rho)
        assert near[f] == {r["name"]: pytest.approx(r.mi, abs=1e-9) for r in neighbours.neighbour_information(own, ["a", "b"], "y", "row_id", 5 + f).collect()}
    none = select.complements(df.limit(0), ["a", "b"], "y", "fold", 2, True)
    assert none[0][:2] == ([], {}) and set(none[0][2].values()) <= {0.0}


def test_ranges_are_of_a_size_and_estimates_do_not_tell_them(spark, monkeypatch):
    """More rows make more ranges, not larger ones; the estimate is that of all rows at once, rows that reach over several ranges included."""
    rng = np.random.default_rng(12)
    rows = [(f"r{k}", float(v), float(rng.integers(0, 3)), None if k % 40 == 3 else int(c)) for k, (v, c) in enumerate(zip(rng.normal(size=1500), np.where(np.arange(1500) % 300 < 2, 5, rng.integers(0, 2, 1500)), strict=True))]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, y int")
    seen = []
    asked = neighbours._questions
    monkeypatch.setattr(neighbours, "RANGE", 60)
    monkeypatch.setattr(neighbours, "_questions", lambda ranges, k: seen.append([s[0] for _, s in ranges]) or asked(ranges, k))
    got = {r["name"]: r.mi for r in neighbours.neighbour_information(df, ["a", "b"], "y", "row_id").collect()}
    assert all(len(sizes) == 25 and max(sizes) <= 80 for sizes in seen)
    values = neighbours.moved(df, ["a", "b"], "y", "row_id", 42).toPandas()
    for name, own in values.groupby("name"):
        assert got[name] == pytest.approx(neighbours.information(own["x"].to_numpy(), own["y"].to_numpy(), seed=None), abs=1e-9)


def test_rows_at_one_place_tell_nothing_of_the_label(spark, monkeypatch):
    """Where the random moves repeat, as among millions of rows of one value, a column without information has next to none."""
    monkeypatch.setattr(neighbours, "TINY", 1e-13)
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(f"r{k}", int(v), int(c)) for k, (v, c) in enumerate(zip(rng.integers(0, 2, 4000), rng.random(4000) < 0.25, strict=True))], "row_id string, x int, y int")
    assert neighbours.neighbour_information(df, ["x"], "y", "row_id").first().mi < 0.01


def test_stability_counts_equal_rows_once(spark):
    """Rows that agree in all features are one with their numbers by fold, and dealing by held ranks is that of folds()."""
    df = spark.createDataFrame([(f"r{k}", float(k % 7), float(k % 3), int(k % 2)) for k in range(2100)], "row_id string, a double, b double, y int")
    dealt = split.dealt(split.in_bins(df, "row_id", "y", 42), 5, "y")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, split.folds(df, 5, "row_id", "y", 42).select(*dealt.columns).collect()))
    got = select.combinations(dealt, ["a", "b"], F.lit(0), F.col("fold"), 5).collect()
    assert len(got) == 21 and sum(sum(r["_n"]) for r in got) == 2100
    assert all(len(r["_n"]) == 5 for r in got)
