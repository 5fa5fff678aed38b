import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap as B
from cohortlens.operators import metrics as M


def test_poisson_weights_moments(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    w = df.select(B.poisson_weight(B.replicate_uniform(B.hash_int(F.lit(42), F.col("k")), F.lit(3))).alias("w"))
    vals = np.array([r["w"] for r in w.collect()])
    assert vals.mean() == pytest.approx(1.0, abs=0.03)
    assert vals.var() == pytest.approx(1.0, abs=0.05)
    cdf = B.poisson1_cdf(3)
    assert cdf[0] == pytest.approx(np.exp(-1))


def test_replicates_are_deterministic_and_distinct(spark, golden_rows):
    a = B.bootstrap_metrics(golden_rows, ["row_id"], n_boot=20, seed=7).orderBy("rep").collect()
    b = B.bootstrap_metrics(golden_rows.repartition(5), ["row_id"], n_boot=20, seed=7).orderBy("rep").collect()
    assert [r["roc_auc"] for r in a] == pytest.approx([r["roc_auc"] for r in b], abs=1e-12)
    assert len({round(r["roc_auc"], 10) for r in a}) > 10
    point = M.metrics(golden_rows).first()["roc_auc"]
    assert np.mean([r["roc_auc"] for r in a]) == pytest.approx(point, abs=0.03)


def test_bootstrap_summary_columns(spark, golden_rows):
    reps = B.bootstrap_metrics(golden_rows, ["row_id"], n_boot=30, seed=1)
    s = B.bootstrap_summary(reps, M.metrics(golden_rows))
    rows = {r["metric"]: r for r in s.collect()}
    assert set(rows) == set(M.METRIC_NAMES)
    assert rows["roc_auc"]["ci95_low"] <= rows["roc_auc"]["ci95_high"]
    assert rows["roc_auc"]["point"] == pytest.approx(0.7156139124825287, abs=1e-9)


def test_stream_metrics_equal_batch(spark, golden_rows):
    from cohortlens.streaming.metrics_stream import run_metrics_stream
    src = tempfile.mkdtemp(prefix="cl-stream-src-")
    golden_rows.where(F.col("row_id") % 2 == 0).write.mode("overwrite").parquet(os.path.join(src, "a"))
    golden_rows.where(F.col("row_id") % 2 == 1).write.mode("overwrite").parquet(os.path.join(src, "b"))
    got = []
    q = run_metrics_stream(spark, os.path.join(src, "*"), golden_rows.schema, [],
                           lambda df, bid: got.append(df.collect()))
    q.awaitTermination(120)
    final = got[-1][0]
    assert final["roc_auc"] == pytest.approx(0.7156139124825287, abs=1e-9)


def test_multinomial_bootstrap(spark, golden_rows):
    h = B.multinomial_histogram(golden_rows, [], n_boot=40, seed=3)
    sizes = {r["rep"]: r["n"] for r in h.groupBy("rep").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()}
    assert len(sizes) == 40 and set(sizes.values()) == {879.0}
    again = B.multinomial_histogram(golden_rows.repartition(3), [], n_boot=40, seed=3)
    a = sorted(tuple(r) for r in h.collect())
    b = sorted(tuple(r) for r in again.collect())
    assert a == b
    reps = B.bootstrap_metrics_multinomial(golden_rows, [], n_boot=60, seed=3).collect()
    aucs = np.array([r["roc_auc"] for r in reps])
    assert aucs.mean() == pytest.approx(0.7156, abs=0.02)
    assert 0.005 < aucs.std() < 0.04


def test_multinomial_tree_over_many_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(rng.random() < s), float(s)) for g in ("a", "b") for s in np.round(rng.random(700), 3)] + [("a", 1, 0.5)] * 500 + [("c", 1, 0.2), ("d", None, 0.1), ("d", 1, float("nan"))]
    d = spark.createDataFrame(rows, "model string, y_true int, y_prob double")
    sizes = {"a": 1200, "b": 700, "c": 1}
    for leaf_scores in (7, 10_000):
        h = B.multinomial_histogram(d, ["model"], n_boot=50, seed=3, leaf_scores=leaf_scores).cache()
        n = {(r["model"], r["rep"]): r["n"] for r in h.groupBy("model", "rep").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()}
        assert n == {(m, r): sizes[m] for m in sizes for r in range(50)}
        again = B.multinomial_histogram(d.repartition(5), ["model"], n_boot=50, seed=3, leaf_scores=leaf_scores)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, h.collect()))
        # the summed form has the metrics of its own draws
        expected = {(r["model"], r["rep"]): r for r in M.metric_table(h, ["model", "rep"]).collect()}
        got = B.bootstrap_metrics_multinomial(d, ["model"], n_boot=50, seed=3, leaf_scores=leaf_scores).collect()
        assert len(got) == len(expected) == 150
        for r in got:
            e = expected[r["model"], r["rep"]]
            for m in M.METRIC_NAMES:
                assert r[m] == (None if e[m] is None else pytest.approx(e[m], abs=1e-9)), m
        # every row is drawn once on average, in each part of the score's range
        mean = {(r["model"], r["low"]): r["n"] / 50 for r in h.groupBy("model", (F.col("score") < 0.3).alias("low")).agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()}
        rows_in = {(m, low): sum(1 for r in rows if r[0] == m and r[1] is not None and (r[2] < 0.3) == low) for m in ("a", "b") for low in (True, False)}
        for k, n in rows_in.items():
            assert abs(mean[k] - n) < 4 * (n / 50) ** 0.5
    assert B.bootstrap_metrics_multinomial(d.limit(0), ["model"], n_boot=3).count() == 0


def test_small_integer_weights_equal_the_distribution_function():
    import numpy as np
    from cohortlens.operators import bootstrap as B
    x = np.concatenate([B.POISSON_STEPS.astype(np.int64) + d for d in (-1, 0, 1)] + [np.arange(0, 2**31, 1_000_003)])
    expected = np.searchsorted(np.array(B.poisson1_cdf()[:-1]), x / 2147483648.0, side="right")
    assert (np.searchsorted(B.POISSON_STEPS, x.astype(np.uint32), side="right") == expected).all()
    rows, rep = np.random.default_rng(3).integers(0, 2**60, 300), np.arange(70)
    u = B.hash_array(rows, rep) / 2147483648.0
    got = B.poisson_weights(rows, rep)
    assert got.dtype == np.uint8 and (got == np.searchsorted(np.array(B.poisson1_cdf()[:-1]), u, side="right")).all()
