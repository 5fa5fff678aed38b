"""Classifier fitting, tuning and scoring.

The training DataFrame is cached once and shared by every fit. Logistic models
are Spark ML optimisations (L-BFGS/OWL-QN) that run side by side; boosted trees
of all models, folds and settings grow in lock-step (``boost``). Only
coefficients or trees reach the driver.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import metrics as M
from cohortlens.operators.boost import BoostedTrees, BoostedTreesModel, Boosting, fit_boosted
from cohortlens.session import ship_package

# Model settings and the search grids.
LOGREG = {"C": 1.0, "l1_ratio": 0.25, "max_iter": 1000}
GBT = {"trees": 500, "depth": 3, "step": 0.05}
GBT_SUB = {"trees": 1000, "depth": 4, "step": 0.03, "subsample": 0.8, "colsample": 0.8, "l1": 0.0, "l2": 1.0, "newton": True}
LOGREG_GRID = {"C": [0.01, 0.1, 1, 10], "l1_ratio": [0, 0.5, 1]}
GBT_GRID = {"trees": [200, 500], "step": [0.05, 0.1], "depth": [3, 5]}
GBT_SUB_GRID = {"trees": [500, 1000], "step": [0.03, 0.1], "depth": [3, 4], "subsample": [0.8, 1.0], "colsample": [0.8, 1.0], "l2": [1.0, 2.0], "l1": [0.0, 0.5]}


def logistic(n_train: int, C: float = 1.0, l1_ratio: float = 0.25, max_iter: int = 1000,
             features: str = "features", label: str = "label") -> LogisticRegression:
    """M5: C-parameterised elastic-net logistic regression. Dividing
    C * sum(loss) + penalty by C * n gives Spark's mean-loss objective with
    regParam = 1 / (C * n) and elasticNetParam = l1_ratio."""
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                              regParam=1.0 / (C * max(n_train, 1)), elasticNetParam=float(l1_ratio),
                              standardization=False, tol=1e-4)


def boosting(name: str, seed: int = 42, **changes) -> Boosting:
    """M6/M7: the settings of a boosted model: ``gbt`` (variance splits) or ``gbt_sub`` (second-order
    splits with penalties, sampled rows and features), with ``changes``."""
    return replace(Boosting(**BOOSTED[name], seed=seed), **changes)


def positive_probability(pred: DataFrame, out: str = "y_prob") -> DataFrame:
    """P(class 1) from the probability vector."""
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


BOOSTED = {"gbt": GBT, "gbt_sub": GBT_SUB}
MODELS = ["logreg", *BOOSTED]
#: Rows that one partition of a training frame holds at most, so that small frames do not pay for empty tasks at every tree.
ROWS_PER_PARTITION = 100_000


def balanced(train: DataFrame) -> DataFrame:
    """The training frame in partitions that its row count asks for, cached: a fit
    passes over it once per iteration, on whatever partitions it finds."""
    train = train.cache()
    parts = -(-train.count() // ROWS_PER_PARTITION) or 1
    if parts >= train.rdd.getNumPartitions():
        return train
    even = train.repartition(parts).cache()
    even.count()
    train.unpersist()
    return even


def estimator(name: str, n_train: int, features: str = "features") -> LogisticRegression:
    """The named Spark ML model with its fixed settings; the penalty of ``logreg`` follows ``n_train``."""
    if name != "logreg":
        raise ValueError(f"unknown model(s): {[name]}")
    return logistic(n_train, LOGREG["C"], LOGREG["l1_ratio"], LOGREG["max_iter"], features=features)


def fit_together(jobs: list, parallelism: int = 8) -> list:
    """Results of fitting functions that run side by side: each fit is a chain of
    small jobs, so several of them share the cluster well."""
    with ThreadPool(min(parallelism, len(jobs) or 1)) as pool:
        return pool.map(inheritable_thread_target(SparkSession.getActiveSession())(lambda job: job()), jobs)


def train_all(train: DataFrame, n_train: int, which: list[str] | None = None, seed: int = 42, features: str = "features", key_col: str | None = None) -> dict:
    """M8: fit the named models on one balanced, cached training frame; the boosted ones together."""
    which = which or MODELS
    made = {name: estimator(name, n_train, features) for name in which if name not in BOOSTED}
    train = balanced(train)
    fitted = dict(zip(made, fit_together([lambda e=e: e.fit(train) for e in made.values()]), strict=True))
    boosted = {name: boosting(name, seed) for name in which if name in BOOSTED}
    if boosted:
        fitted |= {name: BoostedTreesModel(t, features) for name, t in fit_boosted(train, boosted, features, key_col=key_col).items()}
    train.unpersist()
    return {name: fitted[name] for name in which}


def fold_margins(df: DataFrame, models: list[dict[int, BoostedTrees]], at: list[int] | None = None, fold_col: str = "fold", features: str = "features", out: str = "margins") -> DataFrame:
    """Log-odds of every row by the models that left its fold out, as an array: per entry of ``models``
    (fold -> trees), after each number of trees in ``at`` (default: all). Each tree is applied once. Null for rows of other folds."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def margins(fold: pd.Series, x: pd.Series) -> pd.Series:
        found: list = [None] * len(fold)
        for f in fold.dropna().unique():
            if all(f in m for m in models):
                rows = np.flatnonzero((fold == f).to_numpy())
                values = np.array(x.iloc[rows].tolist(), float)
                every = np.column_stack([m[f].margins(values, at) for m in models])
                for r, row in zip(rows.tolist(), every, strict=True):
                    found[r] = row
        return pd.Series(found, dtype=object)

    return df.withColumn(out, margins(F.col(fold_col), vector_to_array(F.col(features))))


def oof_boosted(train: DataFrame, models: dict[str, dict[int, BoostedTrees]], keep: list[str] | None = None, fold_col: str = "fold", label: str = "label", features: str = "features") -> DataFrame:
    """K1 for boosted models: (model, keep..., fold, label, y_raw), every row scored by the fit that left its fold out."""
    names = list(models)
    scored = fold_margins(train, list(models.values()), None, fold_col, features)
    return scored.select(*(keep or []), fold_col, label, F.posexplode("margins").alias("__i", "__m")) \
        .select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__i") + 1).alias("model"), *(keep or []), fold_col, label, (1.0 / (1.0 + F.exp(-F.col("__m")))).alias("y_raw"))


def coefficient_table(spark, model, names: list[str]) -> DataFrame:
    """Fitted logistic coefficients as (term, estimate)."""
    rows = [("(Intercept)", float(model.intercept))] + [(n, float(b)) for n, b in zip(names, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "term string, estimate double")


def tune_logistic(train: DataFrame, fold_col: str = "fold", parallelism: int = 8,
                  grid: dict | None = None, k: int = 5) -> list[dict]:
    """Grid search with entity-grouped folds and exact ROC-AUC. C is fixed, so
    the penalty of each fit follows its own number of rows. One dict per setting:
    C, l1_ratio, mean_auc, best (the first of the largest)."""
    grid = grid or LOGREG_GRID
    train = balanced(train)
    sizes = {r[0]: r[1] for r in train.groupBy(fold_col).count().collect()}   # k rows
    n = sum(sizes.values())
    settings = [(c, r) for c in grid["C"] for r in grid["l1_ratio"]]

    def auc(c, r, i):
        model = logistic(n - sizes.get(i, 0), c, r, LOGREG["max_iter"]).fit(train.where(F.col(fold_col) != i))
        return _auc().evaluate(model.transform(train.where(F.col(fold_col) == i)))

    scores = fit_together([lambda c=c, r=r, i=i: auc(c, r, i) for c, r in settings for i in range(k)], parallelism)
    train.unpersist()
    return _ranked([{"C": float(c), "l1_ratio": float(r)} for c, r in settings], scores, k)


def _auc() -> BinaryClassificationEvaluator:
    """Exact (``numBins=0``: no down-sampling)."""
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0)


def _ranked(settings: list[dict], scores: list[float], k: int) -> list[dict]:
    means = [sum(scores[j * k:(j + 1) * k]) / k for j in range(len(settings))]
    best = max(range(len(means)), key=lambda j: means[j])
    return [s | {"mean_auc": float(m), "best": j == best} for j, (s, m) in enumerate(zip(settings, means))]


@dataclass
class Search:
    """A finished search: a row per setting (settings, ``mean_auc``, ``best``), the best setting's refit on all rows and its fits without each fold."""

    table: list[dict]
    best: dict
    model: BoostedTrees
    folds: dict[int, BoostedTrees]


def search_boosted(train: DataFrame, name: str = "gbt", grid: dict | None = None, fold_col: str = "fold", k: int = 5, seed: int = 42,
                   features: str = "features", key_col: str | None = None) -> Search:
    """M10 for boosted trees, with the refit. Trees are added one after the other, so the first m trees of a
    longer fit are the fit of m trees: every shape (all settings but the number of trees) is fitted once per
    fold and once on all rows, all in lock-step, with the most trees. One pass over the rows then scores every
    setting by running sums over the trees, and exact ROC-AUC per (setting, fold) is one aggregate."""
    grid = grid or {"gbt": GBT_GRID, "gbt_sub": GBT_SUB_GRID}[name]
    counts = sorted(grid["trees"])
    others = [g for g in grid if g != "trees"]
    shapes = [dict(zip(others, v, strict=True)) for v in itertools.product(*(grid[g] for g in others))]
    train = balanced(train)
    fits = {(j, i): boosting(name, seed, **s, trees=counts[-1], leave_out=i) for j, s in enumerate(shapes) for i in (*range(k), None)}
    fitted = fit_boosted(train, fits, features, fold_col=fold_col, key_col=key_col)
    held = [{i: fitted[j, i] for i in range(k)} for j in range(len(shapes))]
    scored = fold_margins(train, held, counts, fold_col, features).select(F.col(fold_col).alias("fold"), F.col("label").cast("int").alias("y_true"), F.posexplode("margins").alias("setting", "y_prob")) \
        .withColumn("y_prob", 1.0 / (1.0 + F.exp(-F.col("y_prob"))))
    keys = ["setting", "fold"]
    area = M.auc_ap(M.curve_table(M.score_histogram(scored, keys), keys), keys)
    means = {r["setting"]: r["mean"] for r in area.groupBy("setting").agg(F.avg("roc_auc").alias("mean")).collect()}     # a row per setting
    train.unpersist()
    settings = [{"trees": m} | s for s in shapes for m in counts]
    best = max(range(len(settings)), key=lambda j: means.get(j) if means.get(j) is not None else -1.0)
    trees, shape = settings[best]["trees"], best // len(counts)
    table = [s | {"mean_auc": means.get(j), "best": j == best} for j, s in enumerate(settings)]
    return Search(table, settings[best], fitted[shape, None].first(trees), {i: t.first(trees) for i, t in held[shape].items()})


def staged_model(prep_stages: list, estimator) -> Pipeline:
    """Preprocessing + model as one Pipeline."""
    return Pipeline(stages=list(prep_stages) + [estimator])


class PositiveProbability(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The probability of class 1 as a number: the stage between a classifier and a calibrator."""

    @keyword_only
    def __init__(self, *, inputCol: str = "probability", outputCol: str = "y_raw"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="probability", outputCol="y_raw")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), vector_to_array(F.col(self.getInputCol()))[1])


def save_model(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline (preprocess -> model -> calibrator)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
