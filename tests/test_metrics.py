import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import metrics as M
from cohortlens.operators import threshold as H


def test_golden_point_metrics(golden_rows):
    r = M.metrics(golden_rows).first()
    assert r["roc_auc"] == pytest.approx(0.7156139124825287, abs=1e-9)
    assert r["pr_auc"] == pytest.approx(0.7543575887785675, abs=1e-9)
    assert r["brier"] == pytest.approx(0.2141536, abs=1e-7)
    assert r["ece"] == pytest.approx(0.0654728, abs=1e-7)
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (454, 135, 220, 70)
    assert r["precision"] == pytest.approx(0.6736, abs=1e-4)
    assert r["sensitivity"] == pytest.approx(0.8664, abs=1e-4)


def test_golden_ece_closed_last(golden_rows):
    r = M.metrics(golden_rows, closed_last=True).first()
    assert r["ece"] == pytest.approx(0.0688858, abs=1e-7)


def test_golden_best_threshold(golden_rows):
    grid = H.optimize_grid(H.threshold_curve(golden_rows))
    best = H.best_threshold(grid).first()
    assert best["threshold"] == pytest.approx(0.47)
    assert (best["C_FP"], best["C_FN"], best["Cost"]) == (1, 1, 290)
    assert (best["TP"], best["FP"], best["FN"], best["TN"]) == (454, 220, 70, 135)
    assert grid.count() == 100


def _brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def _brute_ap(y, p):
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    thr = np.unique(ps)[::-1]
    ap, prev_r = 0.0, 0.0
    for t in thr:
        pred = ps >= t
        tp = (ys[pred] == 1).sum()
        r = tp / y.sum()
        prec = tp / pred.sum()
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_ap_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    y = rng.integers(0, 2, n)
    p = np.round(rng.random(n) * 0.5 + 0.3 * y, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, y_prob double")
    r = M.auc_ap(M.curve_table(M.score_histogram(df))).first()
    assert r["roc_auc"] == pytest.approx(_brute_auc(y, p), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(_brute_ap(y, p), abs=1e-12)
    flipped = df.withColumn("y_prob", 1 - F.col("y_prob"))
    r2 = M.auc_ap(M.curve_table(M.score_histogram(flipped))).first()
    assert r2["roc_auc"] == pytest.approx(1 - r["roc_auc"], abs=1e-12)
    mono = df.withColumn("y_prob", F.exp(F.col("y_prob") * 3))
    r3 = M.auc_ap(M.curve_table(M.score_histogram(mono))).first()
    assert r3["roc_auc"] == pytest.approx(r["roc_auc"], abs=1e-12)


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y_true int, y_prob double")
    r = M.metrics(df).first()
    assert r["roc_auc"] is None
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (1, 1, 0, 0)
    c = M.confusion(df).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (1, 0, 1, 0)


def test_continuous_curve_split_path(spark, monkeypatch):
    """Large distinct-score tables are summed in cells; same answer."""
    from cohortlens.operators import prefix
    rng = np.random.default_rng(5)
    n = 3000
    y = rng.integers(0, 2, n)
    p = rng.random(n) * 0.6 + 0.2 * y
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, y_prob double")
    h = M.score_histogram(df)
    small = M.auc_ap(M.curve_table(h)).first()["roc_auc"]
    monkeypatch.setattr(prefix, "ROWS_PER_TASK", 10)
    big = M.auc_ap(M.curve_table(h)).first()["roc_auc"]
    assert big == pytest.approx(small, abs=1e-12)
    assert small == pytest.approx(_brute_auc(y, p), abs=1e-12)


def test_threshold_curve_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 300
    y = rng.integers(0, 2, n)
    p = np.concatenate([rng.random(n - 4), [0.0, 1.0, 0.001, 0.3]])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, y_prob double")
    cur = {r["k"]: r for r in H.threshold_curve(df).collect()}
    thr = np.linspace(0, 1, 1001)
    for k in [0, 1, 300, 500, 999, 1000]:
        pred = p >= thr[k]
        assert cur[k]["TP"] == int(((y == 1) & pred).sum())
        assert cur[k]["FP"] == int(((y == 0) & pred).sum())
        assert cur[k]["threshold"] == thr[k]
    sens = [cur[k]["Sens"] for k in range(1001)]
    assert all(a >= b for a, b in zip(sens, sens[1:]))


def test_strict_threshold_rule(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.7)], "y_true int, y_prob double")
    a = M.metrics(df).first()
    b = M.metrics(df, strict=True).first()
    assert (a["tp"], a["fp"]) == (2, 1)
    assert (b["tp"], b["fp"]) == (1, 0)


def test_equal_width_bins_match_numpy(spark):
    from cohortlens.operators import profile
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.random(500) * 7.3 - 1.1, [-1.1, 6.2]])
    x = np.concatenate([x, np.linspace(x.min(), x.max(), 21)])     # values exactly on the edges
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r["bin"]: r["count"] for r in profile.equal_width_histogram(df, ["x"], 20).collect()}
    counts, _ = np.histogram(x, bins=20)
    assert [got.get(i, 0) for i in range(20)] == list(counts)


def test_thinned_roc_matches_numpy_rule(spark):
    rng = np.random.default_rng(12)
    n = 400
    y = rng.integers(0, 2, n)
    p = np.round(rng.random(n), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, y_prob double")
    got = sorted(r["threshold"] for r in M.roc_points_thinned(M.curve_table(M.score_histogram(df))).collect())
    thr = np.unique(p)[::-1]
    fps = np.array([((p >= t) & (y == 0)).sum() for t in thr])
    tps = np.array([((p >= t) & (y == 1)).sum() for t in thr])
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    assert got == sorted(thr[keep].tolist())
