"""Thresholds, metrics, calibration and paired statistics on hand-made tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.operators import agreement, calibrate, inference, metrics, policy, projection, summaries


def negatives(spark, scores):
    return spark.createDataFrame([(0, float(s)) for s in scores], "y int, score double")


@pytest.mark.parametrize(
    ("scores", "target", "want"),
    [
        # 250 different scores, 3 percent: seven alarms from 244 on.
        (range(1, 251), 0.03, {"threshold": 244.0, "budget": 7, "false_positives": 7, "achieved_fpr": 0.028, "rank": 244, "tie_adjusted": False}),
        # Three of eight may alarm; the three sixes would make it five, so the sevens begin.
        ([3, 3, 5, 6, 6, 6, 7, 8], 0.4, {"threshold": 7.0, "tie_adjusted": True, "false_positives": 2, "rank": 7, "nominal_rank": 6, "nominal_threshold": 6.0}),
        # The smallest tables with a budget of one.
        (range(20), 0.05, {"rank": 20, "budget": 1}),
        (range(-40, 0), 0.025, {"threshold": -1.0}),
    ],
)
def test_threshold(spark, scores, target, want):
    got = metrics.derive_threshold(negatives(spark, scores), target)
    assert {k: got[k] for k in want} == want


def test_thresholds_against_brute_force(spark):
    rng = np.random.default_rng(8)
    targets = (0.004, 0.01, 0.03, 0.2)
    tables = {k: rng.integers(0, n, 700) / n for k, n in (("fine", 10_000), ("coarse", 40), ("two", 2))}
    df = spark.createDataFrame([(k, 0, float(v)) for k, s in tables.items() for v in s] + [("fine", 1, 5.0)], "model string, y int, score double")
    got = {(r.model, r.target_fpr): r for r in metrics.thresholds(df, ["model"], *targets).collect()}
    for k, s in tables.items():
        for t in targets:
            ok = [v for v in sorted(set(s)) if (s >= v).sum() <= math.floor(t * len(s))]
            want = ok[0] if ok and math.floor(t * len(s)) else None
            assert got[k, t].threshold == want and got[k, t].negatives == 700
            assert got[k, t].false_positives == (None if want is None else (s >= want).sum())


def test_operational_against_brute_force(spark):
    """Counts from distinct scores equal those of the rows; a row without a score counts nowhere."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 900)
    s = np.round(np.clip(0.3 * y + rng.random(900) * 0.7, 0, 1), 2)
    half = np.arange(900) % 2 == 0
    frame = lambda m: spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y[m], s[m], strict=True)], "model string, y int, score double")
    odd = spark.createDataFrame([("m", 1, float("nan")), ("m", 0, None)], "model string, y int, score double")
    got = {r.target_fpr: r for r in metrics.operational(frame(half), frame(~half).unionByName(odd), ["model"], (0.05, 0.1, 0.0001)).collect()}
    for t in (0.05, 0.1):
        neg = s[half & (y == 0)]
        cut = min(v for v in set(neg) if (neg >= v).sum() <= math.floor(t * len(neg)))
        p, q = s[~half] >= cut, y[~half] == 1
        assert (got[t].threshold, got[t].tn, got[t].fp, got[t].fn, got[t].tp) == (cut, (~p & ~q).sum(), (p & ~q).sum(), (~p & q).sum(), (p & q).sum())
        assert got[t].auc == metrics.auc(frame(~half), ["model"], digits=4).first().auc
    assert (got[0.0001].threshold, got[0.0001].tn, got[0.0001].tp) == (None, 0, 0)


@pytest.mark.parametrize(("scores", "target"), [([2, 4, 6, 8, 8, 8], 0.34), ([0.5] * 30, 0.1), (range(19), 0.05), (range(39), 0.025), (range(30), 0.0), (range(30), 1.0), ([float("inf")] * 60, 0.02), ([], 0.3)])
def test_threshold_refuses(spark, scores, target):
    with pytest.raises(ValueError):
        metrics.derive_threshold(negatives(spark, scores), target)


def test_threshold_refuses_labels(spark):
    with pytest.raises(ValueError):
        metrics.derive_threshold(spark.createDataFrame([(2, 0.5)] * 200, "y int, score double"), 0.1)


def scored_rows(spark):
    y, pred, score = [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 1, 0, 1, 1, 0, 1], [0.1, 0.2, 0.8, 0.3, 0.7, 0.9, 0.4, 0.85]
    return spark.createDataFrame([("m", *r) for r in zip(y, pred, score, strict=True)], "model string, y int, pred int, score double")


def test_evaluate(spark):
    r = metrics.evaluate(scored_rows(spark), ["model"]).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.fpr) == (0.75, 0.75, 0.75, 0.75, 0.25)
    assert (r.tn, r.fp, r.fn, r.tp) == (3, 1, 1, 3)
    assert r.auc == 14 / 16


def test_one_class_has_no_auc(spark):
    r = metrics.evaluate(scored_rows(spark).where("y = 0"), ["model"]).first()
    assert r.auc is None and r.recall == 0
    assert metrics.partial_auc(scored_rows(spark).where("y = 0"), ["model"]).first().pauc is None


def test_auc_and_partial_auc_against_brute_force(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 3000), rng.integers(0, 400, 3000) / 400
    s = np.where(y == 1, np.minimum(1, s + 0.2), s)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, s, strict=True)], "model string, y int, score double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(metrics.auc(df, ["model"]).first().auc - want) < 1e-6
    t = np.unique(s)[::-1]
    fpr, tpr = np.array([0, *[(neg >= x).mean() for x in t]]), np.array([0, *[(pos >= x).mean() for x in t]])
    grid = np.union1d(fpr[fpr <= 0.02], [0.02])
    area = np.trapezoid(np.interp(grid, *map(np.array, zip(*[(f, tpr[fpr == f].max()) for f in np.unique(fpr)], strict=True))), grid)
    # At equal false-positive rates the curve rises straight up, which adds no area.
    got = metrics.partial_auc(df, ["model"]).first().pauc
    assert abs(got - 0.5 * (1 + (area - 0.0002) / (0.02 - 0.0002))) < 0.03
    perfect = spark.createDataFrame([("m", 1, 2.0)] * 5 + [("m", 0, 1.0)] * 100, "model string, y int, score double")
    assert metrics.partial_auc(perfect, ["model"]).first().pauc == 1.0


def test_counts_at_a_threshold(spark):
    rows = [(0, 0.1)] * 27 + [(0, 0.6)] * 3 + [(1, 0.3)] * 8 + [(1, 0.5)] * 12
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, y int, score double").withColumn("pred", metrics.predict(F.col("score"), 0.5))
    r = metrics.evaluate(df, ["model"], digits=4).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.recall, r.fpr, r.precision, r.f1) == (27, 3, 8, 12, 0.6, 0.1, 0.8, 0.6857)


def test_ece(spark):
    good = [("m", i % 4 == 0, 0.25) for i in range(100)] + [("m", i % 4 != 0, 0.75) for i in range(100)]
    df = spark.createDataFrame([(m, int(y), p) for m, y, p in good], "model string, y int, score double")
    assert calibrate.ece(df, ["model"]).first().ece == 0
    assert calibrate.reliability(df, ["model"]).count() == 10
    bad = spark.createDataFrame([("m", 0, 0.9)] * 100, "model string, y int, score double")
    assert abs(calibrate.ece(bad, ["model"]).first().ece - 0.9) < 1e-9


def test_platt_is_monotonic_and_finite(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    df = spark.createDataFrame([(int(a), float(a + rng.normal())) for a in y], "y int, score double")
    c = calibrate.Platt(df)
    assert 0 < c.slope < 10
    p = [r[0] for r in df.orderBy("score").select(c.column(F.col("score"))).collect()]
    assert p == sorted(p) and 0 < p[0] < p[-1] < 1


#: y and the predictions of svm, rf and qsvc.
DOZEN = [(0, 0, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 1, 0), (0, 1, 1, 1), (1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 1, 1), (1, 0, 1, 1), (1, 1, 0, 0), (1, 0, 0, 0), (1, 1, 1, 0)]


def test_error_cells(spark):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(DOZEN)], "row_id string, y int, svm_pred int, rf_pred int, qsvc_pred int")
    cells = {(r.svm_wrong, r.rf_wrong, r.qsvc_wrong): r.n for r in agreement.error_cells(df).collect() if r.n}
    wrong = [tuple(int(p != y) for p in rest) for y, *rest in DOZEN]
    assert cells == Counter(wrong)
    o = agreement.error_overlaps(df).first()
    assert (o.svm_errors, o.rf_errors, o.qsvc_errors) == tuple(map(sum, zip(*wrong, strict=True)))
    assert (o.all_right, o.all_wrong, o.exactly_one_right) == tuple(sum(sum(w) == k for w in wrong) for k in (0, 3, 2))
    u = agreement.unanimity(df).first()
    same = [(y, p[0]) for y, *p in DOZEN if len(set(p)) == 1]
    assert (u.unanimous, u.unanimous_right, u.unanimous_wrong) == (len(same), sum(y == p for y, p in same), sum(y != p for y, p in same))
    assert agreement.majority_worth(df).first().majority == round(sum(int(sum(p) >= 2) == y for y, *p in DOZEN) / 12, 6)


def test_mcnemar_and_holm(spark):
    y, a, b = [0, 0, 1, 1, 0, 1, 0, 1], [0, 0, 1, 1, 0, 1, 1, 0], [0, 0, 0, 0, 1, 0, 0, 1]
    df = spark.createDataFrame([(str(i), *r, r[1]) for i, r in enumerate(zip(y, a, b, strict=True))], "row_id string, y int, svm_pred int, rf_pred int, qsvc_pred int")
    r = inference.mcnemar(df).where("model_a = 'svm' and model_b = 'rf'").first()
    assert {r.b, r.c} == {2, 4} and r.statistic == round(1 / 6, 6)
    assert inference.mcnemar(df).where("model_b = 'qsvc' and model_a = 'svm'").first().statistic == 0
    # Times 4, 3, 2, 1 in rising order, never falling, at most 1.
    p, want = {"a": 0.2, "b": 0.002, "c": 0.03, "d": 0.6}, {"a": 0.4, "b": 0.008, "c": 0.09, "d": 0.6}
    assert inference.holm_adjust(list(p.values())) == list(want.values())
    h = inference.holm(spark.createDataFrame([(1, k, v) for k, v in p.items()], "f int, name string, p double"), ["f"])
    assert {r.name: r.p_holm for r in h.collect()} == want
    assert abs(inference.chi2_tail(3.841459) - 0.05) < 1e-6


def test_bootstrap_bounds(spark):
    rows = [(str(i), i % 2, (i % 2) ^ (i < 10), (i % 2) ^ (i < 20), i % 2, 0.5, 0.5, 0.5) for i in range(100)]
    df = spark.createDataFrame([tuple(int(x) if isinstance(x, bool) else x for x in r) for r in rows], "row_id string, y int, svm_pred int, rf_pred int, qsvc_pred int, svm_score double, rf_score double, qsvc_score double")
    got = inference.bootstrap(df, 50).collect()
    assert len(got) == 12 and all(r.lower <= r.upper for r in got)
    r = next(r for r in got if (r.model_a, r.model_b, r.metric) == ("svm", "rf", "accuracy"))
    assert 0 < r["mean"] < 0.25


def test_orientation_of_verdicts(spark):
    df = spark.createDataFrame([("fpr", 0.03, 0.05, -1), ("f1", 0.03, 0.05, 1), ("f1", -0.001, 0.001, 1), ("f1", -0.05, 0.05, 1), ("f1", 0.005, 0.05, 1)], "m string, lower double, upper double, better int")
    assert [r[0] for r in df.select(inference.verdict()).collect()] == ["INFERIOR", "SUPERIOR", "EQUIVALENT", "SPANS_ZERO", "BORDERLINE"]


def test_policy(spark):
    rows = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    got = policy.decide(spark.createDataFrame(rows, "svm_pred int, rf_pred int, qsvc_pred int"), ["svm_pred", "rf_pred", "qsvc_pred"]).collect()
    for r in got:
        v = r.svm_pred + r.rf_pred + r.qsvc_pred
        assert (r.votes, r.final, r.threat, r.review, r.tally) == (v, int(v >= 2), ["LOW", "MEDIUM", "HIGH", "HIGH"][v], v in (1, 2), f"{v}/3")
        assert (r.reason is None) == (v in (0, 3))


def test_summaries(spark):
    df = spark.createDataFrame([("m", 0.8), ("m", 0.9), ("one", 0.5)], "model string, value double")
    got = {r.model: r for r in summaries.over_seeds(df, ["model"]).collect()}
    assert (got["m"]["mean"], got["m"].std_sample) == (0.85, 0.070711) and got["one"].std_sample == 0
    c = spark.createDataFrame([("g", 0.1, 0.82), ("g", 1.0, 0.88), ("g", 10.0, 0.85), ("t", 10.0, 0.5), ("t", 0.1, 0.5)], "g string, c double, f1 double")
    assert {r.g: r.c for r in summaries.best_candidate(c, ["g"]).collect()} == {"g": 1.0, "t": 0.1}


def test_bootstrap_is_paired(spark):
    """Equal models never differ; models that mostly agree differ as much as in resamples of the rows themselves."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    a = np.clip(0.4 * y + 0.6 * rng.random(400), 0, 1 - 1e-9)
    b = np.clip(a + rng.normal(0, 0.03, 400), 0, 1 - 1e-9)
    names = inference.MODELS
    rows = [(int(t), *(v for s in (p, q, p) for v in (float(s), int(s >= 0.5)))) for t, p, q in zip(y, a, b, strict=True)]
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"{m}_score double, {m}_pred int" for m in names))
    same = inference.resampled(df, names[0], names[2], 50).collect()
    assert len(same) == 200 and all(r.difference == 0 for r in same)
    got = {m: np.std([r.difference for r in inference.resampled(df, names[0], names[1], 400).collect() if r.metric == m]) for m in ("auc", "accuracy")}

    def area(t, s):
        return (s[t == 1][:, None] > s[t == 0]).mean()

    draws = [rng.integers(0, 400, 400) for _ in range(400)]
    assert abs(got["auc"] / np.std([area(y[k], a[k]) - area(y[k], b[k]) for k in draws]) - 1) < 0.2
    assert abs(got["accuracy"] / np.std([((a[k] >= 0.5) == y[k]).mean() - ((b[k] >= 0.5) == y[k]).mean() for k in draws]) - 1) < 0.2


def test_simulated_votes(spark):
    """Own flows, worked out by hand from the published limits and probabilities."""
    rows = [(0, 50.0, 0.0, 10.0, 20_000.0), (1, 101.0, 0.0, 300.0, 5.0), (2, 200.0, 2e6, 10.0, 5.0), (3, 200.0, 1_000_001.0, 301.0, 1e9), (4, 100.0, 1e6, 300.0, 1e6)]
    got = {r.k: r for r in policy.simulated_votes(spark.createDataFrame(rows, "k int, a double, b double, c double, d double"), {"sttl": "a", "sload": "b", "smean": "c", "sbytes": "d"}).collect()}
    votes = lambda r: (r.signals, r.svm_pred, r.rf_pred, r.qsvc_pred, r.votes, r.threat, r.review, r.simulated)
    assert votes(got[0]) == (0, 0, 0, 0, 0, "LOW", False, True)
    assert votes(got[1]) == (1, 1, 0, 0, 1, "MEDIUM", True, True)
    assert votes(got[2]) == (2, 1, 1, 1, 3, "HIGH", False, True)
    assert votes(got[3]) == (3, 1, 1, 1, 3, "HIGH", False, True)
    p = lambda k: (got[k].svm_probability, got[k].rf_probability, got[k].qsvc_probability)
    assert p(0) == (0.82, 0.85, 0.79) and p(1) == (0.61, 0.44, 0.39) and p(2) == (0.82, 0.84, 0.78) and p(3) == (0.92, 0.92, 0.88) and p(4) == (0.04, 0.03, 0.06)


def test_recommended_sizes(spark):
    runs = [("fast", 50, 3.0), ("fast", 220, 119.0), ("slow", 100, 40.0), ("slow", 250, 121.0), ("middle", 120, 500.0), ("small", 99, 1.0)]
    got = {r.series: (r.largest, r.n_train, r.n_validation, r.n_test, r.within_ceilings) for r in projection.recommend(spark.createDataFrame(runs, "series string, n int, seconds double")).collect()}
    assert got == {"fast": (220, 200, 50, 100, True), "slow": (250, 100, 50, 100, True), "middle": (120, 100, 50, 100, True), "small": (99, 50, 25, 50, True)}


def test_dry_run(spark):
    measured = {"n_train": 200, "n_test": 1000, "test_embed": 50.0, "train_kernel": 0.5, "test_kernel": 2.0, "fit": 0.1, "predict": 0.25}
    r = projection.dry_run(spark.createDataFrame([(400,)], "n_train int"), measured).first()
    assert (r.embed_s, r.train_kernel_s, r.test_kernel_s, r.fit_s, r.predict_s, r.total_s, r.test_matrix_mb) == (20.0, 2.0, 4.0, 0.4, 0.25, 26.65, 3.05)


def test_poisson_totals(spark):
    """Mean and variance of a draw are the rows of its cell, whether drawn singly or by the normal quantile; draws differ by cell and resample."""
    sizes = (1, 3, 8, 9, 20, 400)
    df = spark.range(6000).select(F.col("id").cast("int").alias("r"), F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    drawn = df.withColumn("w", inference.poisson_total("t", F.col("r"), F.concat(F.lit("cell"), F.col("n").cast("string")), F.col("n")))
    for r in drawn.groupBy("n").agg(F.avg("w").alias("mean"), F.var_samp("w").alias("var"), F.min("w").alias("least"), F.count("*").alias("c")).collect():
        assert r.c == 6000 and r.least >= 0
        assert abs(r.mean - r.n) < 5 * math.sqrt(r.n / 6000) and abs(r["var"] / r.n - 1) < 0.12
    assert drawn.where("n = 1 AND w = 0").count() / 6000 == pytest.approx(math.exp(-1), abs=0.03)


def test_poisson_weights_of_rows(spark):
    """Every row has a draw of its own in every resample: sums over the rows are those of draws made one by one."""
    import hashlib

    n, rows = 300, []
    for k in range(n):
        rows.append((f"r{k}", k % 2, "c", *(v for m in range(3) for v in (0.9 if (k + m) % 3 else 0.2, int((k + m) % 3 > 0)))))
    df = spark.createDataFrame(rows, "row_id string, y int, category string, " + ", ".join(f"{m}_score double, {m}_pred int" for m in inference.MODELS))
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(7)]

    def weight(r: int, row: str) -> int:
        u = int(hashlib.md5(f"boot:{r}:{row}".encode()).hexdigest()[:8], 16) / 2**32
        return sum(u >= s for s in steps)

    got = {(r.resample, r.model): (r.n, r.right) for r in inference.poisson_counts(df, 4).collect()}
    for r in range(4):
        w = [weight(r, x[0]) for x in rows]
        for k, m in enumerate(inference.MODELS):
            assert got[r, m] == (sum(w), sum(a for a, x in zip(w, rows, strict=True) if x[4 + 2 * k] == x[1]))
    drawn = spark.range(4000).select(inference.poisson_weight("t", F.lit(1), F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert abs(drawn.m - 1) < 0.08 and abs(drawn.v - 1) < 0.12


def test_digests_of_many_texts():
    """The first 32 bits are hashlib's, for texts of any length, letters of several bytes, and none."""
    import hashlib

    import pyarrow as pa

    from sparkvane.functions.digests import Tails

    short, long = [f":{k}:{k * k}" for k in range(300)], [":é" + "x" * k for k in range(200)]
    for tails in (short, long, [""], [":a" * 40] * 3, []):
        for beginning in (b"", b"boot:7", b"boot:77", b"boot:777", b"a" * 70):
            want = [int(hashlib.md5(beginning + t.encode()).hexdigest()[:8], 16) for t in tails]
            assert Tails(pa.array(tails, pa.string()), len(beginning)).draws(beginning).tolist() == want


def test_paired_poisson_bootstrap_has_all_resamples(spark, monkeypatch):
    """The registered query and its SQL draw as many resamples as the protocol has, of all rows."""
    from sparkvane.plans import queries

    drawn = []
    monkeypatch.setattr(inference, "interval", lambda df, *a, was=inference.interval: (drawn.append(df), was(df, *a))[1])
    assert queries.QUERIES["H3_poisson_bootstrap"](spark, "/root/testdata/sf0.001").count() == 12
    assert [r["count"] for r in drawn[0].groupBy("model_a", "model_b", "metric").count().collect()] == [1000] * 12
    assert "range(1000)" in queries.ORACLE_SQL["H3_poisson_bootstrap"]


def test_paired_poisson_bootstrap_is_of_rows(spark):
    """Both models of a pair have the same rows' draws: the mean difference of accuracy is that of draws made one by one."""
    import hashlib

    rows = [(f"r{k}", k % 2, *(v for m in range(3) for v in ((k * (m + 3)) % 11 / 11, int((k * (m + 3)) % 11 / 11 >= 0.5)))) for k in range(200)]
    df = spark.createDataFrame(rows, "row_id string, y int, " + ", ".join(f"{m}_score double, {m}_pred int" for m in inference.MODELS))
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(7)]
    u = lambda r, x: int(hashlib.md5(f"boot:{r}:{x}".encode()).hexdigest()[:8], 16) / 2**32
    got = {(r.model_a, r.model_b): r["mean"] for r in inference.poisson_bootstrap(df, 3).where("metric = 'accuracy'").collect()}
    at = {m: 3 + 2 * k for k, m in enumerate(inference.MODELS)}
    for (a, b), mean in got.items():
        each = []
        for r in range(3):
            w = [sum(u(r, x[0]) >= s for s in steps) for x in rows]
            each.append(sum(v * ((x[at[a]] == x[1]) - (x[at[b]] == x[1])) for v, x in zip(w, rows, strict=True)) / sum(w))
        assert mean == pytest.approx(sum(each) / 3, abs=1e-12)


def test_large_interval(spark):
    """Bounds are exact, whatever the sizes, ties, signs and nulls; no aggregate holds a group's values."""
    import numpy as np

    rng = np.random.default_rng(5)
    groups = {"a": list(rng.normal(size=999)), "b": [7.0], "c": [1.0] * 50 + [2.0] * 2, "d": [None, None], "e": [-5.0, None, 3.0, 0.0], "f": list(rng.exponential(1e6, 400))}
    df = spark.createDataFrame([(g, v if v is None else float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    made = inference.large_interval(df, ["g"], "v")
    got = {r.g: r for r in made.collect()}
    assert set(got) == set(groups) and "percentile(" not in made._jdf.queryExecution().toString()
    for g, vs in groups.items():
        x = np.array([v for v in vs if v is not None])
        want = (x.mean(), x.std(), *np.quantile(x, [0.025, 0.975])) if len(x) else (None,) * 4
        assert (got[g]["mean"], got[g].se, got[g].lower, got[g].upper) == (want if not len(x) else pytest.approx(want, rel=1e-9, abs=1e-9))
