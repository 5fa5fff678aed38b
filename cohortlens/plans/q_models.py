"""Queries: preprocessing (SQL-checked), model fits, tuning, calibration."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cohortlens.operators import calibrate as K
from cohortlens.operators import metrics as M
from cohortlens.operators import models as ML
from cohortlens.operators import prep as P
from cohortlens.operators import split
from cohortlens.functions.scalar import clinical_flags
from cohortlens.plans import sql as S
from cohortlens.plans.base import query
from cohortlens.plans.common import SCORED_SQL, SEED, feature_design
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources import views
from cohortlens.spec import DEFAULT_SPEC

NUM = list(DEFAULT_SPEC.num)
CAT = list(DEFAULT_SPEC.cat)
# Levels the driver tables hold for each categorical feature (the oracle SQL is static).
ORACLE_LEVELS = {
    "hatype": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "medication": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "sex": ["female", "male"],
    "study_season": ["autumn", "spring", "summer", "winter"],
    "phase": ["No treatment", "Under treatment"],
    "age_band": ["18-30", "31-40", "41-50", "51-66"],
}


def model_frame(spark, sf_dir):
    """Feature design of the rows with a known outcome (P5), with label (yes -> 1, no -> 0) and hash folds."""
    d = feature_design(spark, sf_dir).where(F.col("headache").isNotNull()).withColumn("label", (F.col("headache") == "yes").cast("double"))
    return split.group_folds(d, "id", 5, SEED)


def fitted_prep(spark, sf_dir):
    d = model_frame(spark, sf_dir).cache()   # before the preprocessor's own passes
    params = P.fit_preprocessor(d.where(F.col("split") == "train"), NUM, CAT)
    return d, params


def prepared(spark, sf_dir):
    d, params = fitted_prep(spark, sf_dir)
    return P.preprocessor_model(params).transform(d), params


PREP_NUM_SQL = SCORED_SQL + ", known AS (SELECT * FROM design WHERE headache IS NOT NULL), tr AS (SELECT * FROM known WHERE split = 'train'),\n  med AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS med_{c}" for c in NUM) + " FROM tr),\n  mom AS (SELECT " + ", ".join(
    f"avg(coalesce(CAST({c} AS DOUBLE), med_{c})) AS mu_{c}, stddev_pop(coalesce(CAST({c} AS DOUBLE), med_{c})) AS sd_{c}"
    for c in NUM) + " FROM tr, med)\nSELECT rownames, " + ", ".join(
    f"(coalesce(CAST({c} AS DOUBLE), med_{c}) - mu_{c}) / sd_{c} AS num__{c}" for c in NUM) + " FROM known, med, mom"


@query("prep_numeric", "rownames:bigint " + " ".join(f"num__{c}:double" for c in NUM), PREP_NUM_SQL)
def prep_numeric(spark, sf_dir):
    """M2: median imputation + standardisation (population sd) fitted on train, applied to all rows."""
    d, params = fitted_prep(spark, sf_dir)
    return P.transform(d, params)


ONEHOT_COLS = [f"cat__{c}_{P.safe_name(lv)}" for c in CAT for lv in ORACLE_LEVELS[c]]
PREP_CAT_SQL = SCORED_SQL + ", known AS (SELECT * FROM design WHERE headache IS NOT NULL), tr AS (SELECT * FROM known WHERE split = 'train'),\n" + ",\n".join(
    f"  mode_{c} AS (SELECT CAST({c} AS VARCHAR) AS v FROM tr WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    for c in CAT) + "\nSELECT rownames, " + ", ".join(
    f"CAST(coalesce(CAST({c} AS VARCHAR), (SELECT v FROM mode_{c})) = '{lv}' AS DOUBLE) AS cat__{c}_{P.safe_name(lv)}"
    for c in CAT for lv in ORACLE_LEVELS[c]) + " FROM known"


@query("prep_onehot", "rownames:bigint " + " ".join(f"{c}:double" for c in ONEHOT_COLS), PREP_CAT_SQL)
def prep_onehot(spark, sf_dir):
    """M3: most-frequent imputation + one-hot over sorted training levels (unseen -> zeros)."""
    d, params = fitted_prep(spark, sf_dir)
    return P.transform(d, params)


FEATURE_NAMES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}')" for i, n in enumerate([f"num__{c}" for c in NUM] + ONEHOT_COLS)) + ") t(position, name)"


@query("feature_names", "position:bigint name:string", FEATURE_NAMES_SQL)
def feature_names(spark, sf_dir):
    """Fitted feature names in matrix order, read from the vector column's ML attributes."""
    d, params = prepared(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(P.attribute_names(d))), "position long, name string")


def _fit_logreg(spark, sf_dir):
    d, params = prepared(spark, sf_dir)
    d = d.cache()
    train = d.where(F.col("split") == "train")
    n = train.count()
    model = ML.logistic(n, LOGREG_C, LOGREG_L1).fit(train)
    return d, params, model


LOGREG_C = ML.LOGREG["C"]
LOGREG_L1 = ML.LOGREG["l1_ratio"]


@query("fit_logreg", "term:string estimate:double")
def fit_logreg(spark, sf_dir):
    """M5: elastic-net logistic regression (l1_ratio 0.25, C 1) on the training split."""
    d, params, model = _fit_logreg(spark, sf_dir)
    return ML.coefficient_table(spark, model, params.feature_names())


METRIC_COLS = " ".join(f"{m}:double" for m in M.METRIC_NAMES)


def _scored_metrics(model, data):
    """The metrics callback of the model queries: the full metric row per split."""
    s = ML.positive_probability(model.transform(data))
    return M.metrics(s.select("split", F.col("label").cast("int").alias("y_true"), "y_prob"), ["split"])


def _eval(models: dict, d, splits=("valid", "test")):
    return M.evaluate_models(models, d.where(F.col("split").isin(*splits)), _scored_metrics)


@query("score_rows", "rownames:bigint id:bigint y_prob:double")
def score_rows(spark, sf_dir):
    """P(event) for the test rows from the fitted logistic model."""
    d, params, model = _fit_logreg(spark, sf_dir)
    return ML.positive_probability(model.transform(d.where(F.col("split") == "test")))


@query("train_all", "model:string split:string " + METRIC_COLS)
def train_all(spark, sf_dir):
    """M8: logistic regression, boosted trees and the subsampled profile fitted on one
    training frame, evaluated on validation and test in one histogram job."""
    d, params = prepared(spark, sf_dir)
    d = d.cache()
    train = d.where(F.col("split") == "train")
    return _eval(ML.train_all(train, train.count(), seed=SEED, key_col="rownames"), d)


@query("fit_gbt", "model:string split:string " + METRIC_COLS)
def fit_gbt(spark, sf_dir):
    """M6: gradient-boosted trees (500 x depth 3, step 0.05)."""
    d, params = prepared(spark, sf_dir)
    d = d.cache()
    train = d.where(F.col("split") == "train")
    return _eval(ML.train_all(train, 0, ["gbt"], seed=SEED, key_col="rownames"), d)


@query("fit_gbt_sub", "model:string split:string " + METRIC_COLS)
def fit_gbt_sub(spark, sf_dir):
    """M7: second-order boosted trees (1000 x depth 4, step 0.03, rows and features sampled at 0.8,
    L2 penalty 1 on leaves), standing in for the external boosted-tree library."""
    d, params = prepared(spark, sf_dir)
    d = d.cache()
    train = d.where(F.col("split") == "train")
    return _eval(ML.train_all(train, 0, ["gbt_sub"], seed=SEED, key_col="rownames"), d)


@query("staged_model_score", "rownames:bigint id:bigint y_prob:double")
def staged_model_score(spark, sf_dir):
    """Preprocessing stages + logistic model fitted as one Pipeline; scores of the test rows."""
    d, params = fitted_prep(spark, sf_dir)
    train = d.where(F.col("split") == "train").cache()
    n = train.count()
    pipe = ML.staged_model(P.preprocessor_model(params).stages, ML.logistic(n, LOGREG_C, LOGREG_L1))
    fitted = pipe.fit(train)
    return ML.positive_probability(fitted.transform(d.where(F.col("split") == "test"))).select("rownames", "id", "y_prob")


@query("tune_logreg", "C:double l1_ratio:double mean_auc:double best:boolean")
def tune_logreg(spark, sf_dir):
    """4 x 3 grid, 5 entity-grouped folds, exact AUC."""
    d, params = prepared(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    return spark.createDataFrame([tuple(r.values()) for r in ML.tune_logistic(train)], "C double, l1_ratio double, mean_auc double, best boolean")


SEARCH_GBT = "trees:bigint step:double depth:bigint mean_auc:double best:boolean"


def _search_rows(spark, search, out: str):
    return spark.createDataFrame([tuple(r.values()) for r in search.table], ", ".join(c.replace(":", " ") for c in out.split()))


def _search(spark, sf_dir, name):
    d, params = prepared(spark, sf_dir)
    return ML.search_boosted(d.where(F.col("split") == "train"), name, seed=SEED, key_col="rownames")


@query("tune_gbt", SEARCH_GBT)
def tune_gbt(spark, sf_dir):
    """M10 for boosted trees: 2 x 2 x 2 grid, 5 entity-grouped folds and the refit in lock-step, exact AUC."""
    return _search_rows(spark, _search(spark, sf_dir, "gbt"), SEARCH_GBT)


@query("tuned_calibrated", "model:string split:string " + METRIC_COLS)
def tuned_calibrated(spark, sf_dir):
    """The tuned logistic and boosted models, refitted on the training split, uncalibrated and with each
    calibration fitted on the search's own out-of-fold scores: metrics on the test split."""
    d, params = prepared(spark, sf_dir)
    d = d.cache()
    train = ML.balanced(d.where(F.col("split") == "train"))
    test = d.where(F.col("split") == "test")
    best = next(r for r in ML.tune_logistic(train) if r["best"])
    train = ML.balanced(d.where(F.col("split") == "train"))
    n = train.count()
    search = ML.search_boosted(train, "gbt", seed=SEED, key_col="rownames")
    train = ML.balanced(d.where(F.col("split") == "train"))
    models = {"logreg_tuned": ML.logistic(n, best["C"], best["l1_ratio"], ML.LOGREG["max_iter"]).fit(train), "gbt_tuned": ML.BoostedTreesModel(search.model)}
    oof = {"logreg_tuned": K.oof_scores(train, lambda size: ML.logistic(size, best["C"], best["l1_ratio"], ML.LOGREG["max_iter"]), 5),
           "gbt_tuned": ML.oof_boosted(train, {"gbt_tuned": search.folds})}
    return M.metrics(_calibrated(models, oof, test), ["model", "split"])


@query("train_flags", "model:string split:string " + METRIC_COLS)
def train_flags(spark, sf_dir):
    """Every model of M8 refitted with the clinical flags (raw units) added to the matrix, beside the fit
    without them; with the flags the logistic model has the plain L2 penalty. Boosted fits share one binned frame."""
    from pyspark.ml.feature import VectorAssembler
    d, params = prepared(spark, sf_dir)
    flags = clinical_flags()
    d = d.select("*", *[c.cast("double").alias(n) for n, c in flags.items()])
    va = VectorAssembler(inputCols=params.feature_names() + list(flags), outputCol="features_flags", handleInvalid="keep")
    d = va.transform(d).cache()
    train = ML.balanced(d.where(F.col("split") == "train"))
    n = train.count()
    base, plain = ML.fit_together([lambda: ML.estimator("logreg", n).fit(train), lambda: ML.logistic(n, LOGREG_C, 0.0, ML.LOGREG["max_iter"], "features_flags").fit(train)])
    own = tuple(range(len(params.feature_names())))
    trees = ML.fit_boosted(train, {f"{m}_{kind}": ML.boosting(m, SEED, columns=cols) for m in ML.BOOSTED for kind, cols in (("base", own), ("flags", None))},
                           "features_flags", key_col="rownames")
    return _eval({"logreg_base": base, "logreg_flags": plain} | {name: ML.BoostedTreesModel(t, "features_flags") for name, t in trees.items()}, d)


def _logreg(n):
    return ML.estimator("logreg", n)


@query("oof_scores", "rownames:bigint fold:bigint label:double y_raw:double")
def oof_scores(spark, sf_dir):
    """K1: out-of-fold logistic scores over 5 entity-grouped folds of the training split."""
    d, params = prepared(spark, sf_dir)
    return K.oof_scores(d.where(F.col("split") == "train"), _logreg, 5, keep=["rownames"])


def _calibrated(models: dict, oof: dict, test):
    """Test scores of each model, uncalibrated and under each calibration fitted on its out-of-fold scores."""
    parts = []
    for name, model in models.items():
        raw = ML.positive_probability(model.transform(test), "y_raw").select("split", F.col("label").cast("int").alias("y_true"), "y_raw").cache()
        parts.append(raw.select(F.lit(f"{name}_uncalibrated").alias("model"), "split", "y_true", F.col("y_raw").alias("y_prob")))
        scores = oof[name].select("label", "y_raw").cache()
        for method in K.METHODS:
            cal = K.calibrate(scores, method)(raw)
            parts.append(cal.select(F.lit(f"{name}_{method}").alias("model"), "split", "y_true", F.col("y_cal").alias("y_prob")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


@query("calib_metrics", "model:string split:string " + METRIC_COLS)
def calib_metrics(spark, sf_dir):
    """K2-K6: each model of M8 uncalibrated, with isotonic and with sigmoid calibration, on the
    test split (calibrators fit on out-of-fold training scores); full and out-of-fold boosted fits in lock-step."""
    d, params = prepared(spark, sf_dir)
    d = d.cache()
    train = ML.balanced(d.where(F.col("split") == "train"))
    n = train.count()
    trees = ML.fit_boosted(train, {(m, i): ML.boosting(m, SEED, leave_out=i) for m in ML.BOOSTED for i in (None, *range(5))}, fold_col="fold", key_col="rownames")
    models = {"logreg": ML.estimator("logreg", n).fit(train)} | {m: ML.BoostedTreesModel(trees[m, None]) for m in ML.BOOSTED}
    oof = {"logreg": K.oof_scores(train, _logreg, 5)} | {m: ML.oof_boosted(train, {m: {i: trees[m, i] for i in range(5)}}) for m in ML.BOOSTED}
    return M.metrics(_calibrated(models, oof, d.where(F.col("split") == "test")), ["model", "split"])


ISO_SQL = S.with_(S.SCORE) + """,
  h AS (SELECT y_prob AS s, CAST(sum(y_true) AS DOUBLE) AS sy, CAST(count(*) AS DOUBLE) AS n FROM score GROUP BY y_prob),
  o AS (SELECT s, row_number() OVER (ORDER BY s) AS i, sy, n FROM h),
  blk AS (SELECT a.i AS a, b.i AS b, (SELECT sum(sy) / sum(n) FROM o WHERE o.i BETWEEN a.i AND b.i) AS m FROM o a, o b WHERE a.i <= b.i),
  fit AS (SELECT o.s AS score, max(mn) AS fitted FROM o,
            LATERAL (SELECT a, min(m) AS mn FROM blk WHERE blk.a <= o.i AND blk.b >= o.i GROUP BY a) t GROUP BY o.s)"""


def _iso_model(spark, sf_dir):
    s = views.score(spark, sf_dir).select(F.col("y_prob").alias("y_raw"), F.col("y_true").alias("label"))
    return K.fit_isotonic(s)


@query("isotonic_fit", "score:double fitted:double", ISO_SQL + "\nSELECT * FROM fit")
def isotonic_fit(spark, sf_dir):
    """K2: isotonic calibration map of the bucketed score (pooled adjacent violators),
    evaluated at every distinct score."""
    m = _iso_model(spark, sf_dir)
    pts = views.score(spark, sf_dir).select(F.col("y_prob").alias("y_raw")).distinct()
    return K.apply_isotonic(m, pts).select(F.col("y_raw").alias("score"), F.col("y_cal").alias("fitted"))


@query("isotonic_apply", "l_orderkey:bigint l_linenumber:bigint l_partkey:bigint id:bigint l_extendedprice:double y_prob:double y_cal:double",
       ISO_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, id, l_extendedprice, y_prob, f.fitted AS y_cal
FROM score JOIN fit f ON score.y_prob = f.score""")
def isotonic_apply(spark, sf_dir):
    """K3: calibrated probability for every scored row."""
    m = _iso_model(spark, sf_dir)
    rows = views.score(spark, sf_dir).withColumn("y_raw", F.col("y_prob"))
    return K.apply_isotonic(m, rows)


def _platt_sql(steps: int = 15) -> str:
    """Newton steps on the score's cells: log-loss plus half the squared slope (C = 1), the intercept free."""
    out = S.with_(S.SCORE) + """,
  cell AS (SELECT y_prob AS x, CAST(sum(y_true) AS DOUBLE) AS sy, CAST(count(*) AS DOUBLE) AS n FROM score GROUP BY y_prob),
  b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"""
    for k in range(steps):
        out += f""",
  g{k} AS (SELECT max(a) AS a, max(b) AS b, sum(sy - n * p) AS ga, sum(x * (sy - n * p)) - max(b) AS gb, sum(n * p * (1 - p)) AS haa,
           sum(x * n * p * (1 - p)) AS hab, sum(x * x * n * p * (1 - p)) + 1 AS hbb
           FROM (SELECT cell.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM cell, b{k}) t),
  b{k + 1} AS (SELECT a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{k})"""
    return out + f"\nSELECT '(Intercept)' AS term, a AS estimate FROM b{steps} UNION ALL SELECT 'y_raw', b FROM b{steps}"


@query("platt_fit", "term:string estimate:double", _platt_sql())
def platt_fit(spark, sf_dir):
    """K4: logistic (Platt) calibration of the bucketed score: intercept and slope."""
    s = views.score(spark, sf_dir).select(F.col("y_prob").alias("y_raw"), F.col("y_true").cast("double").alias("label"))
    va, lr = K.fit_platt(s)
    return spark.createDataFrame([("(Intercept)", float(lr.intercept)), ("y_raw", float(lr.coefficients[0]))],
                                 "term string, estimate double")


TEST_ROWS_SQL = SCORED_SQL + "SELECT rownames, true AS same FROM design WHERE split = 'test' AND headache IS NOT NULL"


@query("model_roundtrip_same", "rownames:bigint same:boolean", TEST_ROWS_SQL)
def model_roundtrip_same(spark, sf_dir):
    """Every test row gets the same score from the saved and loaded pipeline."""
    return model_roundtrip(spark, sf_dir).select("rownames", F.col("y_prob").eqNullSafe(F.col("y_prob_loaded")).alias("same"))


def _bundle(spark, sf_dir):
    """Test rows scored by the fitted bundle (preprocess, logistic model, isotonic calibrator) and by its saved and loaded copy."""
    d, params = fitted_prep(spark, sf_dir)
    prep = P.preprocessor_model(params)
    train = prep.transform(d.where(F.col("split") == "train")).cache()
    model = ML.estimator("logreg", train.count()).fit(train)
    whole = K.bundle(prep.stages, model, K.oof_scores(train, _logreg, 5), "isotonic")
    loaded = ML.load_model(ML.save_model(whole, os.path.join(ensure_checkpoint_dir(spark), f"bundle-{uuid.uuid4().hex}")))
    test = d.where(F.col("split") == "test")
    return whole.transform(test).select("rownames", "id", "y_raw", "y_cal"), loaded.transform(test).select("rownames", F.col("y_cal").alias("y_cal_loaded"))


@query("score_calibrated", "rownames:bigint id:bigint y_raw:double y_cal:double")
def score_calibrated(spark, sf_dir):
    """Raw and calibrated P(event) of the test rows from one fitted bundle."""
    return _bundle(spark, sf_dir)[0]


@query("bundle_roundtrip", "rownames:bigint same:boolean", TEST_ROWS_SQL)
def bundle_roundtrip(spark, sf_dir):
    """Every test row gets the same calibrated score from the saved and loaded bundle."""
    a, b = _bundle(spark, sf_dir)
    return a.join(b, "rownames").select("rownames", F.col("y_cal").eqNullSafe(F.col("y_cal_loaded")).alias("same"))


@query("oof_coverage", "rownames:bigint fold:bigint scored:boolean", SCORED_SQL + """SELECT rownames,
       CAST('0x' || substr(md5(concat_ws('|', '42', CAST(id AS VARCHAR))), 1, 15) AS BIGINT) % 5 AS fold, true AS scored
       FROM design WHERE split = 'train' AND headache IS NOT NULL""")
def oof_coverage(spark, sf_dir):
    """K1: every training row with a known outcome is scored once, by the fit that left its fold out."""
    return oof_scores(spark, sf_dir).select("rownames", "fold", F.col("y_raw").between(0, 1).alias("scored"))


@query("model_roundtrip", "rownames:bigint y_prob:double y_prob_loaded:double")
def model_roundtrip(spark, sf_dir):
    """Preprocess + logistic as one Pipeline, saved to the shared checkpoint
    folder, loaded back, and both copies score the test rows."""
    d, params = fitted_prep(spark, sf_dir)
    train = d.where(F.col("split") == "train").cache()
    n = train.count()
    prep = P.preprocessor_model(params)
    pipe = ML.staged_model(prep.stages, ML.logistic(n, LOGREG_C, LOGREG_L1))
    fitted = pipe.fit(train)
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    loaded = ML.load_model(ML.save_model(fitted, path))
    test = d.where(F.col("split") == "test")
    a = ML.positive_probability(fitted.transform(test)).select("rownames", "y_prob")
    b = ML.positive_probability(loaded.transform(test)).select("rownames", F.col("y_prob").alias("y_prob_loaded"))
    return a.join(b, "rownames")


PREP_MATRIX_SQL = SCORED_SQL + """, known AS (SELECT * FROM design WHERE headache IS NOT NULL), tr AS (SELECT * FROM known WHERE split = 'train'),
  med AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in NUM) + """ FROM tr),
  mom AS (SELECT """ + ", ".join(
    f"avg(coalesce(CAST({c} AS DOUBLE), med_{c})) AS mu_{c}, stddev_pop(coalesce(CAST({c} AS DOUBLE), med_{c})) AS sd_{c}"
    for c in NUM) + """ FROM tr, med),
""" + ",\n".join(
    f"  mode_{c} AS (SELECT CAST({c} AS VARCHAR) AS v FROM tr WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    for c in CAT) + "\nSELECT rownames, " + ", ".join(
    f"(coalesce(CAST({c} AS DOUBLE), med_{c}) - mu_{c}) / sd_{c} AS num__{c}" for c in NUM) + ", " + ", ".join(
    f"CAST(coalesce(CAST({c} AS VARCHAR), (SELECT v FROM mode_{c})) = '{lv}' AS DOUBLE) AS cat__{c}_{P.safe_name(lv)}"
    for c in CAT for lv in ORACLE_LEVELS[c]) + " FROM known, med, mom"


@query("prep_matrix", "rownames:bigint " + " ".join(f"num__{c}:double" for c in NUM) + " "
       + " ".join(f"{c}:double" for c in ONEHOT_COLS), PREP_MATRIX_SQL)
def prep_matrix(spark, sf_dir):
    """M4: the full fitted design matrix (numeric then one-hot block) as named columns."""
    d, params = prepared(spark, sf_dir)
    return P.with_names(d, params)


def _fitted_pipeline(spark, sf_dir):
    d, params = fitted_prep(spark, sf_dir)
    train = d.where(F.col("split") == "train").cache()
    n = train.count()
    pipe = ML.staged_model(P.preprocessor_model(params).stages, ML.logistic(n, LOGREG_C, LOGREG_L1))
    return d, pipe.fit(train)


@query("pdp_fitted", "variable:string level:string pdp:double")
def pdp_fitted(spark, sf_dir):
    """I2 with the fitted preprocessing + logistic pipeline as the predictor: partial
    dependence of the test rows over every segment and subtype level (raw categories
    overridden, then the whole pipeline re-applied)."""
    from cohortlens.operators import explain as X
    d, model = _fitted_pipeline(spark, sf_dir)
    test = d.where(F.col("split") == "test")
    sc = X.ModelScorer(model)
    parts = []
    for col in ["medication", "hatype"]:
        levels = ORACLE_LEVELS[col]
        parts.append(X.pdp_categorical(test, sc, col, levels).select(F.lit(col).alias("variable"), "level", "pdp"))
    return parts[0].unionByName(parts[1])


@query("ale_fitted", "stratum:string bin:bigint mid:double ale:double")
def ale_fitted(spark, sf_dir):
    """I3 with the fitted pipeline as the predictor: ALE of the exposure over the test rows."""
    from cohortlens.operators import explain as X
    d, model = _fitted_pipeline(spark, sf_dir)
    return X.ale(d.where(F.col("split") == "test"), X.ModelScorer(model), "airq")


@query("shap_fitted", "rownames:bigint feature:string phi:double base:double")
def shap_fitted(spark, sf_dir):
    """I10 with the fitted pipeline as the predictor: Shapley values of the test rows over its raw inputs (three orders, twenty background rows)."""
    from cohortlens.operators import explain as X
    d, model = _fitted_pipeline(spark, sf_dir)
    test = d.where(F.col("split") == "test").select("rownames", *NUM, *CAT)
    return X.shapley_model(test, X.ModelScorer(model), NUM + CAT, ["rownames"], seed=SEED)


@query("calibrated_bootstrap", "model:string metric:string mean:double std:double ci95_low:double ci95_high:double point:double")
def calibrated_bootstrap(spark, sf_dir):
    """Entry B: logistic fit on the training split, isotonic calibrator fit on out-of-fold
    training scores, calibrated test scores, then 1000 exact multinomial bootstrap
    replicates of all ten metrics summarised against the point estimates."""
    from cohortlens.operators import bootstrap as B
    d, params, model = _fit_logreg(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    n = train.count()
    oof = K.oof_scores(train, _logreg, 5).cache()
    cal = K.calibrate(oof, "isotonic")
    test = ML.positive_probability(model.transform(d.where(F.col("split") == "test")), "y_raw") \
        .select(F.col("label").cast("int").alias("y_true"), "y_raw")
    scored = cal(test).select(F.lit("logreg_isotonic").alias("model"), "y_true", F.col("y_cal").alias("y_prob")).cache()
    reps = B.bootstrap_metrics_multinomial(scored, ["model"], n_boot=1000, seed=SEED)
    return B.bootstrap_summary(reps, M.metrics(scored, ["model"]), ["model"])
