import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import explain as X
from cohortlens.operators import split
from cohortlens.sources import views

SF = "/root/testdata/sf0.001"


def test_entity_split_sizes_and_disjoint(spark):
    ids = spark.range(1, 134).withColumnRenamed("id", "pid")
    rows = ids.crossJoin(spark.range(3)).select(F.col("pid").alias("id"))
    s = split.entity_split(rows, "id", 0.4, 42)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 79, "valid": 27, "test": 27}
    assert s.select("id").distinct().count() == 133


def test_group_folds_keep_entities_together(spark):
    p = views.panel(spark, SF)
    f = split.group_folds(p, "id", 5, 42)
    assert f.groupBy("id").agg(F.countDistinct("fold").alias("k")).where(F.col("k") > 1).count() == 0
    assert {r["fold"] for r in f.select("fold").distinct().collect()} <= set(range(5))


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for n, i in sorted((-n, i) for i, n in sizes.items()):
        out[i] = min(range(k), key=lambda f: (loads[f], f))
        loads[out[i]] -= n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_fold_cycles_are_the_greedy_rule(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 7))
    table = sorted({int(n): int(rng.integers(1, 40)) for n in rng.integers(1, 60 if seed else 4, 12)}.items(), reverse=True)
    loads, plain = [0] * k, [0] * k
    for n, m in table:
        cycles = split.fold_cycles(n, m, loads)
        for r in range(m):
            start, turn = [c for c in cycles if c[0] <= r][-1]
            fold = min(range(k), key=lambda f: (plain[f], f))
            assert turn[(r - start) % len(turn)] == fold
            plain[fold] += n
        assert loads == plain


def test_balanced_folds(spark):
    rng = np.random.default_rng(4)
    sizes = {i: int(rng.integers(1, 9)) for i in range(300)} | {1000: 900}
    rows = [(i,) for i, n in sizes.items() for _ in range(n)] + [(None,)] * 5
    got = split.balanced_folds(spark.createDataFrame(rows, "id long"), "id", 5).collect()
    assert {r["id"]: r["n"] for r in got} == sizes and {r["id"]: r["fold"] for r in got} == greedy(sizes, 5)
    assert split.balanced_folds(spark.createDataFrame([], "id long")).count() == 0


@pytest.fixture(scope="module")
def design(spark):
    return views.design(spark, SF)


def test_linear_shap_additivity(design):
    sc = X.Scorer.of(views.DESIGN_COEFS)
    shap = X.linear_shap(design, sc, ["rownames"])
    tot = shap.groupBy("rownames").agg(F.sum("phi").alias("s"), F.first("base").alias("b"))
    j = tot.join(design.select("rownames", sc.eta().alias("eta")), "rownames")
    for r in j.collect():
        assert r["s"] + r["b"] == pytest.approx(r["eta"], abs=1e-9)


def test_sampled_shap_additivity(design):
    sc = X.Scorer.of(views.DESIGN_COEFS)
    d = design.limit(300)
    shap = X.shapley_sampled(d, sc, ["rownames"], n_background=50, seed=1)
    tot = shap.groupBy("rownames").agg(F.sum("phi").alias("s"), F.first("base").alias("b"))
    j = tot.join(d.select("rownames", sc.score().alias("p")), "rownames").collect()
    assert len(j) == 300
    for r in j:
        assert r["s"] + r["b"] == pytest.approx(r["p"], abs=1e-9)


def test_ale_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 500
    x = np.round(rng.normal(0, 1, n), 2)
    z = rng.normal(0, 1, n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, z)], "x double, z double")
    sc = X.Scorer.of({"intercept": 0.2, "x": 1.3, "z": -0.7})
    got = {r["bin"]: r for r in X.ale(df, sc, "x").collect()}
    qs = np.quantile(x, np.linspace(0, 1, 21))
    f = lambda xv: 1 / (1 + np.exp(-(0.2 + 1.3 * xv - 0.7 * z)))
    deltas = []
    for b in range(20):
        idx = (x >= qs[b]) & (x < qs[b + 1])
        if not idx.any():
            deltas.append(0.0)
            continue
        lo, hi = x.copy(), x.copy()
        lo[idx], hi[idx] = qs[b], qs[b + 1]
        deltas.append(np.mean(f(hi) - f(lo)))
    ale = np.cumsum(deltas)
    ale -= ale.mean()
    for b in range(20):
        assert got[b]["ale"] == pytest.approx(ale[b], abs=1e-9)
        assert got[b]["mid"] == pytest.approx((qs[b] + qs[b + 1]) / 2, abs=1e-12)


def test_pdp_and_sensitivity(design):
    sc = X.Scorer.of(views.DESIGN_COEFS)
    levels = [f"d_{lv}" for lv in views.DESIGN_LEVELS]
    pdp = {r["level"]: r["pdp"] for r in X.pdp_onehot(design, sc, levels).collect()}
    pd_ = design.toPandas()
    for lv in levels:
        eta = -0.4 + 0.8 * pd_["z_airq"] - 0.3 * pd_["z_dos"] + {"d_BUILDING": 0.5, "d_MACHINERY": -0.2,
                                                                  "d_FURNITURE": 0.1, "d_HOUSEHOLD": 0.0}[lv]
        assert pdp[lv] == pytest.approx((1 / (1 + np.exp(-eta))).mean(), abs=1e-12)
    sens = X.sensitivity(design, sc, "id", levels=levels)
    assert sens.where(F.col("sensitivity") < 0).count() == 0
    with pytest.raises(ValueError):
        X.pdp_onehot(design, sc, [])


def test_model_scorer_matches_column_scorer(spark, design):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    feats = ["z_airq", "z_dos", "d_BUILDING", "d_MACHINERY", "d_FURNITURE", "d_HOUSEHOLD"]
    d = design.withColumn("label", F.coalesce(F.col("headache") == "yes", F.lit(False)).cast("double"))
    pm = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                          LogisticRegression(regParam=0.01, maxIter=50)]).fit(d)
    lr = pm.stages[-1]
    coefs = {"intercept": float(lr.intercept), **{f: float(b) for f, b in zip(feats, lr.coefficients.toArray())}}
    col_sc, mod_sc = X.Scorer.of(coefs), X.ModelScorer(pm)
    levels = [f"d_{lv}" for lv in views.DESIGN_LEVELS]
    a = {r["level"]: r["pdp"] for r in X.pdp_onehot(d, col_sc, levels).collect()}
    b = {r["level"]: r["pdp"] for r in X.pdp_onehot(d, mod_sc, levels).collect()}
    assert a == pytest.approx(b, abs=1e-9)
    ea = {r["bin"]: r["ale"] for r in X.ale(d, col_sc, "z_airq").collect()}
    eb = {r["bin"]: r["ale"] for r in X.ale(d, mod_sc, "z_airq").collect()}
    assert ea == pytest.approx(eb, abs=1e-9)
    pa = {r["Variable"]: r["Importance"] for r in X.permutation_importance(d, col_sc, "label", "id", "rownames", feats).collect()}
    pb = {r["Variable"]: r["Importance"] for r in X.permutation_importance(d, mod_sc, "label", "id", "rownames", feats).collect()}
    assert pa == pytest.approx(pb, abs=1e-9)


def test_sensitivity_shuffles_rows_before_they_meet_the_grid(spark):
    from pyspark.sql import functions as F
    from cohortlens.operators import explain as X
    rows = spark.createDataFrame([(i % 7 if i % 11 else None, float(i)) for i in range(60)], "id long, z double")
    found = X.sensitivity(rows, X.Scorer.of({"intercept": -1.0, "z": 0.02}), "id", feature="z")
    plan = found._jdf.queryExecution().executedPlan().toString()
    grid, dealt = plan.index("BroadcastNestedLoopJoin"), plan.index("Exchange hashpartitioning(id")
    assert grid < dealt and plan.count("Exchange hashpartitioning") == 1
    assert found.count() == 8 and found.where(F.col("sensitivity").isNull()).count() == 0


@pytest.mark.parametrize("job", ["ale", "permutation"])
def test_rows_are_made_once(spark, design, job):
    """The panel of F8 and F16 is read once, and what meets it carries no copy per feature."""
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    rows = design.where(F.col("headache").isNotNull()).withColumn("z_airq", F.udf(counted, "double")(F.col("z_airq"))) \
        .withColumn("label", (F.col("headache") == "yes").cast("int"))
    sc = X.Scorer.of(views.DESIGN_COEFS)
    if job == "ale":
        X.ale_many(rows, sc, ["z_airq", "z_dos"], {"none": None, "level": ["d_BUILDING", "d_MACHINERY"]}).collect()
    else:
        X.permutation_importance(rows, sc, "label", "id", "rownames").collect()
    assert made.value == rows.count()
