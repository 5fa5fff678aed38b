"""Boosted-tree prefixes, balanced frames, evaluation callbacks, event levels and names of calibration methods."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortlens.operators import calibrate as K
from cohortlens.operators import metrics as M
from cohortlens.operators import models as ML


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(2)
    rows = [(i, i % 5, rng.random(), rng.random()) for i in range(300)]
    rows = [(i, f, a, b, float(a + 0.3 * b + 0.2 * rng.random() > 0.7)) for i, f, a, b in rows]
    d = spark.createDataFrame(rows, "rownames int, fold int, a double, b double, label double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d).repartition(7).cache()


def test_searches_rank_every_setting(train):
    even = ML.balanced(train)
    assert even.rdd.getNumPartitions() == 1
    trees = ML.search_boosted(train, "gbt", {"trees": [2, 4], "step": [0.1], "depth": [2, 3]}).table
    assert len(trees) == 4 and sum(r["best"] for r in trees) == 1
    logistic = ML.tune_logistic(train, grid={"C": [0.1, 1], "l1_ratio": [0, 1]})
    assert len(logistic) == 4 and max(r["mean_auc"] for r in logistic) == next(r["mean_auc"] for r in logistic if r["best"])


def test_out_of_fold_estimators_get_their_own_row_count(train):
    seen = []

    def make(n):
        seen.append(n)
        return ML.estimator("logreg", n)

    out = K.oof_scores(train, make, 5, keep=["rownames"])
    assert out.count() == 300 and sorted(seen) == [240] * 5


def test_platt_is_sigmoid_by_another_name(spark):
    d = spark.createDataFrame([(0.1, 0.0), (0.4, 0.0), (0.5, 1.0), (0.9, 1.0)], "y_raw double, label double")
    a = [r["y_cal"] for r in K.calibrate(d, "platt")(d).orderBy("y_raw").collect()]
    assert a == [r["y_cal"] for r in K.calibrate(d, "sigmoid")(d).orderBy("y_raw").collect()]


def test_event_level_first_is_the_other_label(spark):
    d = spark.createDataFrame([(1, 0.75), (0, 0.25), (1, 0.5), (0, 0.5), (0, 0.125)], "y_true int, y_prob double")
    flipped = d.select((1 - F.col("y_true")).alias("y_true"), (1 - F.col("y_prob")).alias("y_prob"))
    area = lambda x, **k: M.auc_ap(M.curve_table(M.score_histogram(x, **k))).first()["pr_auc_trapz"]
    assert area(d, event_level="first") == pytest.approx(area(flipped))
    with pytest.raises(ValueError):
        M.score_histogram(d, event_level="third")


def test_metrics_callback(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.2)], "y_true int, y_prob double")
    out = M.evaluate_models({"as_is": 0.0, "shifted": 0.05}, d, lambda m, x: M.metrics(x.withColumn("y_prob", F.col("y_prob") + m)))
    assert [r["model"] for r in out.select("model").orderBy("model").collect()] == ["as_is", "shifted"]
