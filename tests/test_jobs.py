"""The SVM solver, the sweeps and the stored reports."""

import json

import numpy as np
import pytest

from sparkvane.operators import jobs, landmarks, models, select, svm
from sparkvane.sources import tables


def ring(spark, n=400, seed=0):
    """Rows whose label tells the inside of a ring from its outside."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = ((x**2).sum(axis=1) < 1.2).astype(int)
    return x, y, spark.createDataFrame([(f"r{k:04d}", *map(float, r), int(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "row_id string, a double, b double, y int")


def test_svm_is_at_its_minimum_however_rows_are_dealt(spark):
    x, y, df = ring(spark)
    features = landmarks.local_landmarks(x, 0.5, most=40).features
    one, many = (svm.fit(df.repartition(p), ["a", "b"], "y", features, [0.5, 5.0], p) for p in (1, 20))
    phi, sign = np.concatenate([features(x), np.ones((len(x), 1))], axis=1), 2 * y - 1
    for c, (w, b), (w2, b2) in zip((0.5, 5.0), one, many, strict=True):
        objective = lambda v, c=c: 0.5 * v[:-1] @ v[:-1] + c * np.maximum(0, 1 - sign * (phi @ v)).sum()
        at = np.append(w, b)
        rng = np.random.default_rng(1)
        assert all(objective(at + rng.normal(size=len(at)) * s) > objective(at) * 0.999 for s in (1e-3, 1e-2, 0.1, 1.0) for _ in range(100))
        assert abs(objective(at) - objective(np.append(w2, b2))) < 1e-3 * objective(at)
        assert ((phi @ at > 0) == y).mean() > 0.93


def test_svm_predicts_and_takes_empty_tables(spark):
    x, y, df = ring(spark)
    fitted = models.rbf_svm(df, ["a", "b"], "y", c=5.0)
    got = fitted.transform(df).select("y", "pred", "score").collect()
    assert np.mean([r.y == r.pred for r in got]) > 0.95 and all((r.score > 0) == r.pred for r in got)
    assert fitted.transform(df.limit(0)).count() == 0
    assert models.kernel_svm(df, ["a", "b"], "y").transform(df).count() == 400
    cells = models.tune("qsvc", df, df, ["a", "b"])[1]
    assert [c["params"] for c in cells] == models.KERNEL_GRID and cells[-1]["f1"] > 0.8


def test_learning_curves_hold_every_run(spark):
    _, _, df = ring(spark)
    got = jobs.learning_curves(df, ["a", "b"], ["svm", "absent"], "row_id", sizes=(40, 120), test=100, seeds=(1, 2)).collect()
    assert sorted((r.seed, r.n_train, r.model) for r in got) == sorted((s, n, m) for s in (1, 2) for n in (40, 120) for m in ("svm", "absent"))
    assert all(r.status == "ok" and r.n == 100 and r.accuracy > 0.8 for r in got if r.model == "svm")
    assert all(r.status == "failed: KeyError: 'absent'" and r.accuracy is None for r in got if r.model == "absent")


def test_benchmark_freezes_its_thresholds(spark):
    _, _, df = ring(spark, 600)
    sizes = {"train": 150, "tune": 50, "cal": 200, "test": 150}
    got = jobs.benchmark(df, {"both": ["a", "b"], "one": ["a"]}, ["svm"], "row_id", sizes=sizes, seeds=(5,), targets=(0.05, 0.1)).collect()
    assert {(r.feature_set, r.target_fpr) for r in got} == {(s, t) for s in ("both", "one") for t in (0.05, 0.1)}
    assert all(r.status == "ok" and r.tn + r.fp + r.fn + r.tp == 150 and "c" in json.loads(r.params) for r in got)
    both = {r.target_fpr: r for r in got if r.feature_set == "both"}
    assert both[0.05].threshold >= both[0.1].threshold and both[0.1].recall > 0.5


def test_protocol_sizes():
    assert jobs.protocol_sizes(10**6) == jobs.PROTOCOL
    got = jobs.protocol_sizes(2700)
    assert got == {"train": 400, "tune": 100, "cal": 200, "test": 2000}


def test_timed_kernels_stop(spark, monkeypatch):
    _, _, df = ring(spark)
    monkeypatch.setattr(jobs.projection, "STOP_AHEAD", -1.0)
    got = jobs.timed_kernels(df, ["a", "b"], "row_id", (20, 40, 80)).collect()
    assert [r.skipped for r in got] == [False, True, True] and got[0].diagonal == 0 and got[2].seconds is None


def test_mrmr_against_the_plain_rule():
    rng = np.random.default_rng(4)
    for _ in range(50):
        names = [f"f{k}" for k in range(rng.integers(1, 8))]
        mi = {c: float(rng.random()) for c in names}
        rho = {(a, b): float(rng.random()) for a in names for b in names if a < b}
        rho |= {(b, a): v for (a, b), v in rho.items()}
        for quotient in (False, True):
            picked = []
            for _ in range(min(4, len(names))):
                left = sorted((c for c in names if c not in picked), key=lambda c: (mi[c], c), reverse=True)

                def worth(c, picked=picked, quotient=quotient):
                    if not picked:
                        return mi[c]
                    near = sum(rho[c, p] for p in picked) / len(picked)
                    return mi[c] / (near + 1e-5) if quotient else mi[c] - near

                picked.append(max(left, key=worth))
            got = select.mrmr(mi, rho, 4, quotient)
            assert got == picked
    # On ties the later name.
    assert select.mrmr({"a": 1.0, "b": 1.0, "c": 1.0}, {}, 3) == ["c", "b", "a"]


def test_stored_selection(tmp_path):
    path = tmp_path / "selection.json"
    with pytest.raises(FileNotFoundError):
        tables.stored_selection(str(path))
    path.write_text(json.dumps({"runs": {"all_features": {"selected_features": ["a", "b", "c", "d"]}, "TTL_excluded": {"selected_features": ["a", "e", "f"]}}}))
    assert tables.stored_selection(str(path)) == ["a", "b", "c", "d"]
    assert tables.stored_sets(str(path)) == (["a", "b", "c", "d"], ["a", "e", "f"])
    with pytest.raises(ValueError):
        tables.stored_selection(str(path), "TTL_excluded")


def test_disagreement_and_versions(spark):
    rows = [(str(k), k % 2, k % 2, k % 2 ^ (k < 5), k % 2 ^ (k < 3)) for k in range(40)]
    df = spark.createDataFrame([tuple(int(v) if isinstance(v, bool) else v for v in r) for r in rows], "row_id string, y int, svm_pred int, rf_pred int, qsvc_pred int")
    got = {(r.section, r.subject, r.measure): r.value for r in jobs.disagreement(df).collect()}
    assert got["pairs", "svm-rf", "disagree"] == 5 and got["unanimity", "all", "unanimous"] == 35 and got["majority", "vote", "svm"] == 1.0
    assert {r.name for r in jobs.versions(spark).collect()} >= {"python", "spark"}


@pytest.mark.parametrize("parts", [1, 7])
def test_landmark_features_are_the_kernel(spark, parts):
    """What the features miss of the kernel is what is stated, on all pairs of 500 rows; few landmarks are enough for a smooth kernel."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 4))
    x[100:140] = x[0]  # rows that repeat are one landmark
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(parts)
    want = landmarks.gaussian(x, x, 0.1)
    for error in (0.2, 0.01):
        got, near = landmarks.landmarks(df, list("abcd"), 0.1, error), landmarks.local_landmarks(x, 0.1, error)
        for f in (got, near):
            phi = f.features(x)
            left = want - phi @ phi.T
            assert np.trace(left) / 500 == pytest.approx(f.missed, abs=1e-9) and f.missed <= error
            assert np.abs(left).max() <= np.diag(left).max() + 1e-9 and np.linalg.eigvalsh(left).min() > -1e-8
            assert np.abs(phi @ phi.T - want)[:, 0].max() < 1  # and the landmarks' own values are exact
            own = f.features(f.points)
            assert np.abs(own @ own.T - landmarks.gaussian(f.points, f.points, 0.1)).max() < 1e-6
        assert abs(len(got.points) - len(near.points)) <= landmarks.STEP
    assert len(landmarks.local_landmarks(x, 0.1, 0.2).points) < len(near.points) < 256
    assert len(landmarks.landmarks(df, list("abcd"), 50.0, 0.01, 40).points) == 40
    assert len(landmarks.landmarks(df.limit(0), list("abcd"), 0.1).points) == 0 and landmarks.local_landmarks(x[:0], 0.1).features(x).shape == (500, 0)


def test_a_pass_gives_many_landmarks(spark, monkeypatch):
    """Rows of largest residual that lie close together do not make passes of few landmarks."""
    x, passes = np.random.default_rng(4).uniform(-1.7, 1.7, (4000, 4)), []
    was = landmarks.Factor.take
    monkeypatch.setattr(landmarks.Factor, "take", lambda *a: passes.append(was(*a)) or passes[-1])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = landmarks.landmarks(df.repartition(5), list("abcd"), 0.25)
    assert got.missed <= 0.01 and sum(passes) == len(got.points) and len(passes) <= len(got.points) / 16
    other = landmarks.landmarks(df.repartition(20), list("abcd"), 0.25)
    assert np.array_equal(got.points, other.points)


def test_mixed_features_are_fitted_alike(spark):
    """A fit that mixes its sums at the end is the one on the features, and so are its margins."""
    x = np.random.default_rng(5).normal(size=(300, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int").repartition(3)
    found = landmarks.local_landmarks(x, 0.5, most=40)
    maps = (found.features, svm.Mixed(found.kernel, found.inverse))
    (w, b), (v, c) = (svm.fit(df, ["a", "b"], "y", f, [1.0], 3)[0] for f in maps)
    assert np.abs(w - v).max() < 1e-6 and abs(b - c) < 1e-6
    plain, mixed = ([r.margin for r in svm.Machine(["a", "b"], f, w, b).transform(df).orderBy("a", "b").collect()] for f in maps)
    assert np.allclose(plain, mixed, atol=1e-9)


def test_equal_rows_are_fitted_once(spark, monkeypatch):
    """A machine on copies of rows is the one on all of them, and its passes read each different row once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    times = 1 + np.arange(120) % 5
    rows = [(float(a), float(b), int(t)) for (a, b), t in zip(x, y, strict=True)]
    df = spark.createDataFrame([r for r, n in zip(rows, times, strict=True) for _ in range(n)], "a double, b double, y int").repartition(3)
    seen = []
    fit = svm.fit
    monkeypatch.setattr(svm, "fit", lambda few, *a: seen.append((few.count(), few.agg({"_rows": "sum"}).first()[0])) or fit(few, *a))
    fitted = models.rbf_svm(df, ["a", "b"], "y", c=5.0)
    assert seen == [(120, int(times.sum()))]
    all_ = np.repeat(x, times, axis=0)
    mean, std = all_.mean(axis=0), all_.std(axis=0)
    scaled = (all_ - mean) / std
    (w, b) = svm.fit_local(scaled, np.repeat(y, times), fitted.model.features, [5.0])[0]
    assert np.abs(fitted.model.features(scaled) @ w + b - (fitted.model.features(scaled) @ fitted.model.weights + fitted.model.offset)).max() < 1e-2
