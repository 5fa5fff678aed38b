import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import calibrate as K
from cohortlens.operators import metrics as M
from cohortlens.operators import prep as P
from cohortlens.operators import profile
from cohortlens.sources import sinks


def test_isotonic_monotone_and_clipped(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "y_raw double, label double")
    m = K.fit_isotonic(df)
    pts = spark.createDataFrame([(float(x),) for x in np.linspace(-0.5, 1.5, 41)], "y_raw double")
    out = [r["y_cal"] for r in K.apply_isotonic(m, pts).orderBy("y_raw").collect()]
    assert all(a <= b + 1e-15 for a, b in zip(out, out[1:]))
    assert out[0] == out[1]          # constant below the range
    assert out[-1] == out[-2]        # constant above the range


def test_unknown_calibration_method(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.9, 1.0)], "y_raw double, label double")
    with pytest.raises(ValueError):
        K.calibrate(df, "beta")


def test_sigmoid_returns_probabilities(spark):
    rng = np.random.default_rng(4)
    p = rng.random(300)
    y = (rng.random(300) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "y_raw double, label double")
    out = K.calibrate(df, "sigmoid")(df).select("y_cal").collect()
    vals = [r["y_cal"] for r in out]
    assert len(set(np.round(vals, 6))) > 10 and all(0 < v < 1 for v in vals)


def test_metrics_nan_null_and_empty(spark):
    df = spark.createDataFrame([(1, 0.9), (0, float("nan")), (1, None), (0, 0.1)], "y_true int, y_prob double")
    r = M.metrics(df).first()
    assert r["roc_auc"] == 1.0
    assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 2
    empty = spark.createDataFrame([], "y_true int, y_prob double")
    rows = M.metrics(empty).collect()      # a global aggregate: one row, nothing estimable
    assert len(rows) <= 1 and all(r["roc_auc"] is None for r in rows)


def test_all_scores_tied(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y_true int, y_prob double")
    r = M.metrics(df).first()
    assert r["roc_auc"] == 0.5
    assert r["pr_auc"] == 0.5


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    out = {(r["var_a"], r["var_b"]): r["corr"] for r in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert out[("a", "b")] is None
    assert out[("b", "b")] == pytest.approx(1.0)


def test_prep_unseen_level_and_imputation(spark):
    train = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (None, "y"), (5.0, None)], "v double, c string")
    params = P.fit_preprocessor(train, ["v"], ["c"])
    assert params.medians["v"] == 3.0
    assert params.modes["c"] == "y"
    assert params.levels["c"] == ["x", "y"]
    test = spark.createDataFrame([(None, "z"), (3.0, None)], "v double, c string")
    out = P.transform(test, params).collect()
    assert out[0]["cat__c_x"] == 0.0 and out[0]["cat__c_y"] == 0.0     # unseen -> all zeros
    assert out[1]["cat__c_y"] == 1.0                                     # missing -> mode
    imputed = np.array([1.0, 3.0, 3.0, 5.0])
    assert out[0]["num__v"] == pytest.approx((3.0 - imputed.mean()) / imputed.std())


def test_mode_tie_takes_smallest(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    assert P.fit_preprocessor(train, [], ["c"]).modes["c"] == "a"


def test_sinks_per_variable(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "variable string, value double")
    path = os.path.join(tempfile.mkdtemp(prefix="cl-sink-"), "out")
    sinks.write_per_variable(df, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("variable=")) == ["variable=a", "variable=b"]
    back = spark.read.parquet(path)
    assert back.where(F.col("variable") == "a").count() == 2
    small = os.path.join(tempfile.mkdtemp(prefix="cl-sink-"), "csv")
    sinks.write_table(df, small, fmt="csv", small=True)
    assert len([f for f in os.listdir(small) if f.endswith(".csv")]) == 1


def test_csv_scan_with_schema_and_column_reread(spark):
    from cohortlens.sources import readers
    d = tempfile.mkdtemp(prefix="cl-csv-")
    path = os.path.join(d, "raw.csv")
    with open(path, "w") as f:
        f.write("rownames,id,time,dos,hatype,age,airq,medication,headache,sex\n")
        f.write("1,1,-5,98,Aura,30,12.5,continuing,yes,female\n")
        f.write("2,1,3,120,Aura,30,,reduced,no,female\n")
    df = readers.load_csv(spark, path)
    assert df.schema == readers.RAW_PANEL_SCHEMA
    rows = df.collect()
    assert rows[1]["airq"] is None and rows[0]["time"] == -5
    cols = readers.load_columns(spark, path, ["id", "headache"], fmt="csv").collect()
    assert [tuple(r) for r in cols] == [(1, "yes"), (1, "no")]


def test_box_stats_overall_and_semi_join(spark):
    from cohortlens.operators import clean
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(vals)], "x double, g int")
    r = profile.box_stats(df, "x", []).first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert (r["q1"], r["q3"]) == (q1, q3)
    assert r["whisker_hi"] == 4.0 and r["n_outliers"] == 1 and r["n"] == 5
    keys = spark.createDataFrame([(1,)], "g int")
    assert clean.semi_join(df, keys, ["g"]).count() == 2


def test_one_row_and_null_target(spark):
    one = spark.createDataFrame([(1, 0.7)], "y_true int, y_prob double")
    r = M.metrics(one).first()
    assert r["roc_auc"] is None and r["pr_auc"] == 1.0 and r["tp"] == 1
    withnull = spark.createDataFrame([(1, 0.7), (None, 0.2), (0, 0.1)], "y_true int, y_prob double")
    r2 = M.metrics(withnull).first()
    assert r2["tp"] + r2["tn"] + r2["fp"] + r2["fn"] == 2 and r2["roc_auc"] == 1.0
