"""Model-agnostic explanations for a Column scorer.

The reference calls its predictor once per (row, grid value) or per feature
permutation in interpreted loops. Here every explanation is one DataFrame job:
the scorer is a Column expression with some inputs substituted, a small grid
(levels, quantile edges, 25 points: sizes fixed by the method) is broadcast
and crossed with the rows, and the result is aggregated at once. Only ICE
returns row-level curves.

A scorer is ``Scorer(coefs)`` for a logistic model with given coefficients;
``score(overrides)`` returns the probability with some features replaced by
other expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.scalar import hash_int
from cohortlens.operators.bootstrap import hash_array
from cohortlens.operators.metrics import auc_ap, curve_table, score_histogram
from cohortlens.operators.prefix import running_sums
from cohortlens.operators.quantile import quantiles


@dataclass(frozen=True)
class Scorer:
    coefs: tuple  # ((name, beta), ...) with "intercept" for b0

    @staticmethod
    def of(coefs: dict[str, float]) -> "Scorer":
        return Scorer(tuple(coefs.items()))

    @property
    def features(self) -> list[str]:
        return [n for n, _ in self.coefs if n != "intercept"]

    def beta(self, name: str) -> float:
        return dict(self.coefs).get(name, 0.0)

    def eta(self, overrides: dict[str, Column] | None = None) -> Column:
        overrides = overrides or {}
        e = F.lit(float(self.beta("intercept")))
        for n in self.features:
            x = overrides.get(n, F.col(n))
            e = e + F.lit(float(self.beta(n))) * x.cast("double")
        return e

    def score(self, overrides: dict[str, Column] | None = None) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.eta(overrides)))

    def numpy_score(self, X: np.ndarray) -> np.ndarray:
        b = np.array([self.beta(n) for n in self.features])
        return 1.0 / (1.0 + np.exp(-(self.beta("intercept") + X @ b)))


class ModelScorer:
    """Any fitted Spark ML model (or pipeline) as a scorer: ``predict`` applies the
    overrides as columns, runs ``model.transform`` and keeps P(class 1) as ``__p``
    (the reference's ``pred_fun(model, newdata)``)."""

    def __init__(self, model, prob_col: str = "probability"):
        self.model = model
        self.prob_col = prob_col

    def frame(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        cols = df.columns
        out = self.model.transform(df)
        return out.select(*cols, vector_to_array(F.col(self.prob_col))[1].alias("__p"))


def predict(df: DataFrame, scorer, overrides: dict[str, Column] | None = None, out: str = "__p") -> DataFrame:
    """Prediction with some inputs replaced: one Column expression for a ``Scorer``,
    ``withColumns`` + ``transform`` for a ``ModelScorer``."""
    overrides = overrides or {}
    if isinstance(scorer, Scorer):
        return df.withColumn(out, scorer.score(overrides))
    keep = df.columns
    tmp = {k: f"__orig_{k}" for k in overrides if k in keep}
    x = df.select(*[F.col(c).alias(tmp.get(c, c)) for c in keep], *[v.alias(k) for k, v in overrides.items()])
    y = scorer.frame(x).withColumnRenamed("__p", out)
    return y.drop(*overrides.keys()).select(*[F.col(tmp.get(c, c)).alias(c) for c in keep], out)


def _levels_df(spark, levels: list[str]) -> DataFrame:
    return spark.createDataFrame([(lv, i) for i, lv in enumerate(levels)], "level string, level_pos int")


def _onehot_overrides(levels: list[str]) -> dict[str, Column]:
    """All dummies of the group 0 except the row's grid level."""
    return {lv: (F.col("level") == lv).cast("double") for lv in levels}


def pdp_onehot(df: DataFrame, scorer: Scorer, levels: list[str]) -> DataFrame:
    """Mean prediction with the whole group set to each level in turn."""
    if not levels:
        raise ValueError("one-hot group has no columns")
    g = F.broadcast(_levels_df(df.sparkSession, levels))   # one row per level
    x = predict(df.crossJoin(g), scorer, _onehot_overrides(levels))
    return x.groupBy("level").agg(F.avg("__p").alias("pdp"))


def pdp_categorical(df: DataFrame, scorer, column: str, levels: list[str]) -> DataFrame:
    """I2 for a model on raw categories: the column set to each level in turn."""
    if not levels:
        raise ValueError("no levels")
    g = F.broadcast(_levels_df(df.sparkSession, levels))
    x = predict(df.crossJoin(g), scorer, {column: F.col("level")})
    return x.groupBy("level").agg(F.avg("__p").alias("pdp"))


def pdp_all(df: DataFrame, scorer: Scorer, groups: dict[str, list[str]]) -> DataFrame:
    """Every (variable, level) pair in one pass."""
    spark = df.sparkSession
    for name, lv in groups.items():
        if not lv:
            raise ValueError(f"no columns for group {name}")
    pairs = spark.createDataFrame([(g, lv) for g, lvs in groups.items() for lv in lvs], "variable string, level string")
    x = df.crossJoin(F.broadcast(pairs))
    over = {}
    for g, lvs in groups.items():
        for lv, expr in _onehot_overrides(lvs).items():
            over[lv] = F.when(F.col("variable") == g, expr).otherwise(F.col(lv))
    return predict(x, scorer, over).groupBy("variable", "level").agg(F.avg("__p").alias("pdp"))


def grid_points(df: DataFrame, feature: str, n: int = 25) -> DataFrame:
    """n evenly spaced values from min to max of ``feature`` (min + i * (max - min) / (n - 1))."""
    spark = df.sparkSession
    mm = df.agg(F.min(feature).alias("__lo"), F.max(feature).alias("__hi"))
    pts = spark.range(n).select(F.col("id").alias("point"))
    return mm.crossJoin(pts).select(
        "point", (F.col("__lo") + F.col("point") * ((F.col("__hi") - F.col("__lo")) / F.lit(float(n - 1)))).alias("x"))


def ice_numeric(df: DataFrame, scorer: Scorer, feature: str, keep: list[str], n: int = 25) -> DataFrame:
    """Each row's prediction at every grid value of ``feature`` (rows x broadcast grid)."""
    g = F.broadcast(grid_points(df, feature, n))   # n rows
    base = df.select(*keep, *scorer.features) if isinstance(scorer, Scorer) else df
    x = predict(base.crossJoin(g), scorer, {feature: F.col("x")}, "ice")
    return x.select(*keep, "point", "x", "ice")


def ice_onehot(df: DataFrame, scorer: Scorer, levels: list[str], keep: list[str]) -> DataFrame:
    """Each row's prediction with the group set to each level."""
    g = F.broadcast(_levels_df(df.sparkSession, levels))
    base = df.select(*keep, *scorer.features) if isinstance(scorer, Scorer) else df
    x = predict(base.crossJoin(g), scorer, _onehot_overrides(levels), "ice")
    return x.select(*keep, "level", "ice")


def ice_mean(ice: DataFrame, by: list[str]) -> DataFrame:
    """Mean ICE curve."""
    return ice.groupBy(*by).agg(F.avg("ice").alias("ice_mean"))


def sensitivity(df: DataFrame, scorer: Scorer, id_col: str, feature: str | None = None,
                levels: list[str] | None = None, n: int = 25) -> DataFrame:
    """Per entity, max - min over the grid of the entity's mean prediction. Rows are dealt by entity
    before they meet the grid, so what is shuffled is rows, not rows x grid."""
    grid = None if levels else F.broadcast(grid_points(df, feature, n))
    df = df.select(id_col, *[c for c in scorer.features if c != id_col]).repartition(F.col(id_col)) if isinstance(scorer, Scorer) else df.repartition(F.col(id_col))
    if levels:
        x = df.crossJoin(F.broadcast(_levels_df(df.sparkSession, levels))).withColumnRenamed("level_pos", "point")
        x = predict(x, scorer, _onehot_overrides(levels))
    else:
        x = predict(df.crossJoin(grid), scorer, {feature: F.col("x")})
    curve = x.groupBy(id_col, "point").agg(F.avg("__p").alias("__m"))
    return curve.groupBy(id_col).agg((F.max("__m") - F.min("__m")).alias("sensitivity"))


def sensitivity_table(measures: dict[str, DataFrame], extra: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per entity with a column per measure (one grouped pivot of
    the long table, one left join of the extra per-entity columns)."""
    long = None
    for name, d in measures.items():
        part = d.select(id_col, F.lit(name).alias("measure"), F.col("sensitivity"))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy(id_col).pivot("measure", list(measures)).agg(F.first("sensitivity"))
    return wide.join(extra, id_col, "left")


def ale(df: DataFrame, scorer: Scorer, feature: str, bins: int = 20, strata: list[str] | None = None,
        min_rows: int = 10, mode: str = "reference") -> DataFrame:
    """Accumulated local effects with type-7 quantile edges (21 edges ->
    20 bins [q_b, q_b+1); the maximum falls in no bin). Per bin the in-bin
    rows' prediction differences between the upper and lower edge are summed
    and divided by all rows N (``mode="reference"``) or the bin count
    (``"standard"``); the cumulative sum is centred by its unweighted mean.
    With ``strata`` (one-hot columns) edges are computed within each stratum
    (>= ``min_rows`` rows) and the divisor stays N."""
    probs = [i / bins for i in range(bins + 1)]
    names = [f"e{i}" for i in range(bins + 1)]
    x = F.col(feature)
    if strata:
        long = df.select(x.alias(feature), *strata).unpivot([feature], strata, "stratum", "__in") \
                 .where(F.col("__in") == 1).drop("__in")
        sizes = long.groupBy("stratum").agg(F.count(F.lit(1)).alias("__ns"))
        rows = long.join(sizes.where(F.col("__ns") >= min_rows).select("stratum"), "stratum")
        edges = quantiles(rows, feature, probs, ["stratum"], names)
        keyed = df.select("*", F.explode(F.array(*[F.when(F.col(s) == 1, F.lit(s)) for s in strata])).alias("stratum")) \
                    .where(F.col("stratum").isNotNull())
    else:
        edges = quantiles(df, feature, probs, [], names).withColumn("stratum", F.lit("all"))
        keyed = df.withColumn("stratum", F.lit("all"))
    bins_df = edges.select("stratum", F.explode(F.array(*[
        F.struct(F.lit(b).alias("bin"), F.col(names[b]).alias("lo"), F.col(names[b + 1]).alias("hi"))
        for b in range(bins)])).alias("__b")).select("stratum", "__b.*")
    # strata x bins rows: broadcast, equi-join on stratum, range filter leaves <= 1 bin per row
    j = keyed.join(F.broadcast(bins_df), "stratum").where((x >= F.col("lo")) & (x < F.col("hi")))
    j = predict(predict(j, scorer, {feature: F.col("hi")}, "__p_hi"), scorer, {feature: F.col("lo")}, "__p_lo")
    diff = F.col("__p_hi") - F.col("__p_lo")
    sums = j.groupBy("stratum", "bin").agg(F.sum(diff).alias("__sum"), F.count(F.lit(1)).alias("__nb"))
    n_all = df.count() if mode == "reference" else None
    full = bins_df.join(sums, ["stratum", "bin"], "left")
    if mode == "reference":
        delta = F.coalesce(F.col("__sum") / F.lit(float(n_all)), F.lit(0.0))
    else:
        delta = F.coalesce(F.col("__sum") / F.col("__nb"), F.lit(0.0))
    w = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.withColumn("__cum", F.sum(delta).over(w))    # <= bins rows per stratum
    full = full.withColumn("ale", F.col("__cum") - F.avg("__cum").over(Window.partitionBy("stratum")))
    return full.select("stratum", "bin", ((F.col("lo") + F.col("hi")) / 2.0).alias("mid"), "ale")


def ale_many(df: DataFrame, scorer: Scorer, features: list[str], stratifications: dict[str, list[str] | None],
             bins: int = 20, min_rows: int = 10) -> DataFrame:
    """ALE of every (feature, stratification) in one job keyed by (feature,
    strat, stratum), with the conventions of ``ale`` (reference divisor). A
    stratification is a list of one-hot columns, or None for all rows."""
    strata = [(name, c) for name, cols in stratifications.items() for c in (cols or ["all"])]
    groups = [(f, n, c) for f in features for n, c in strata]
    probs = [i / bins for i in range(bins + 1)]
    names = [f"e{i}" for i in range(bins + 1)]
    by = ["feature", "strat", "stratum"]
    # the rows are made once; beside a value goes the number of its (feature, strat, stratum), not their names
    used = dict.fromkeys([*scorer.features, *features, *[c for _, c in strata if c != "all"]])
    df = df.select(*used).persist()
    member = F.array(*[F.struct(F.lit(i).alias("group"), F.col(f).cast("double").alias("x"), (F.lit(True) if c == "all" else F.col(c) == 1).alias("in"))
                       for i, (f, _, c) in enumerate(groups)])
    keyed = df.withColumn("__s", F.explode(F.filter(member, lambda m: m["in"]))) \
        .select(*df.columns, F.col("__s.group").alias("__group"), F.col("__s.x").alias("__x"))
    ok = keyed.groupBy("__group").agg(F.count(F.lit(1)).alias("__ns")).where(F.col("__ns") >= min_rows).select("__group")
    edges = quantiles(keyed.select("__group", "__x"), "__x", probs, ["__group"], names).join(ok, "__group")
    name = [F.element_at(F.array(*[F.lit(g[k]) for g in groups]), F.col("__group") + 1).alias(c) for k, c in enumerate(by)]
    # features x strata x bins rows: fixed by the arguments
    table = edges.select("__group", F.explode(F.array(*[F.struct(F.lit(b).alias("bin"), F.col(names[b]).alias("lo"), F.col(names[b + 1]).alias("hi"))
                                                        for b in range(bins)])).alias("__b")).select("__group", "__b.*").persist()
    j = keyed.join(F.broadcast(table), "__group").where((F.col("__x") >= F.col("lo")) & (F.col("__x") < F.col("hi")))
    of = lambda f: F.col("__group").isin([i for i, g in enumerate(groups) if g[0] == f])
    at = lambda edge: {f: F.when(of(f), F.col(edge)).otherwise(F.col(f).cast("double")) for f in features}
    sums = j.groupBy("__group", "bin").agg(F.sum(scorer.score(at("hi")) - scorer.score(at("lo"))).alias("__sum"))
    n_all = df.agg(F.count(F.lit(1)).cast("double").alias("__n"))
    full = table.join(sums, ["__group", "bin"], "left").crossJoin(F.broadcast(n_all))   # one row
    of_group = Window.partitionBy("__group")
    w = of_group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)   # <= bins rows
    full = full.withColumn("__cum", F.sum(F.coalesce(F.col("__sum") / F.col("__n"), F.lit(0.0))).over(w))
    return full.select(*name, "bin", ((F.col("lo") + F.col("hi")) / 2.0).alias("mid"), (F.col("__cum") - F.avg("__cum").over(of_group)).alias("ale"))


def linear_shap(df: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """Exact SHAP of a linear model on the log-odds scale with the full data
    as background: phi_j = b_j (x_j - mean x_j). One aggregate + one projection."""
    feats = scorer.features
    means = df.agg(*[F.avg(f).alias(f"__m_{f}") for f in feats])
    x = df.crossJoin(F.broadcast(means))   # one row
    long = x.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                 (F.lit(scorer.beta(f)) * (F.col(f) - F.col(f"__m_{f}"))).alias("phi")) for f in feats])).alias("__s"))
    base = F.lit(scorer.beta("intercept"))
    for f in feats:
        base = base + F.lit(scorer.beta(f)) * F.col(f"__m_{f}")
    return long.select(*keep, "__s.*").crossJoin(F.broadcast(means.select(base.alias("base"))))


def shap_importance(shap_long: DataFrame, top_n: int = 20) -> DataFrame:
    """Mean |phi| per feature, top-N report."""
    return shap_long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap")) \
                    .orderBy(F.col("mean_abs_shap").desc(), F.col("feature")).limit(top_n)


def _background(df: DataFrame, feats: list[str], keep: list[str], n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of their key: a sampling operator."""
    return df.select(*feats, hash_int(F.lit(seed), *[F.col(k) for k in keep]).alias("__h")).orderBy("__h", *feats).limit(n).drop("__h")


def feature_orders(row_hash: np.ndarray, p: int, n_permutations: int) -> np.ndarray:
    """(rows, permutations, p): the features of each row's permutations, ordered by a
    hash of (row, permutation, feature); the same in any engine with integers."""
    key = hash_array(row_hash, np.arange(1, n_permutations * p + 1, dtype=np.int64)).reshape(len(row_hash), n_permutations, p)
    return np.argsort(key, axis=2, kind="stable")


def shapley_sampled(df: DataFrame, scorer: Scorer, keep: list[str], n_background: int = 200, seed: int = 42,
                    n_permutations: int = 10) -> DataFrame:
    """Shapley values on the probability scale against a background sample
    (interventional expectation), by permutation sampling: along each of a row's
    seeded feature orders the features go from the background's values to the
    row's, and each step's change of the mean score is that feature's share. The
    work is linear in the number of features, and sum(phi) = f(x) - mean
    f(background) holds exactly, as each order's steps add up to it. The
    background (``n_background`` rows: the sample that the method fixes) is
    broadcast; rows are worked on in numpy blocks (``mapInPandas``)."""
    feats = scorer.features
    p = len(feats)
    bg = _background(df, feats, keep, n_background, seed).collect()
    bc = df.sparkSession.sparkContext.broadcast(np.array([[float(r[f]) for f in feats] for r in bg]).reshape(-1, p))
    coef = np.array([scorer.beta(f) for f in feats])
    b0 = float(scorer.beta("intercept"))
    out_schema = T.StructType([*[df.schema[k] for k in keep],
                               T.StructField("feature", T.StringType()), T.StructField("phi", T.DoubleType()),
                               T.StructField("base", T.DoubleType())])

    def block(pdf, background):
        x, z = pdf[feats].to_numpy(dtype=float) * coef, background * coef
        n = len(x)
        order = feature_orders(pdf["__h"].to_numpy(), p, n_permutations)
        phi = np.zeros((n, p))
        start = b0 + z.sum(axis=1)
        base = float((1.0 / (1.0 + np.exp(-start))).mean())
        rows = np.arange(n)
        for k in range(n_permutations):
            eta = np.repeat(start[None, :], n, axis=0)
            before = np.full(n, base)
            for step in range(p):
                j = order[:, k, step]
                eta += x[rows, j][:, None] - z[:, j].T
                now = (1.0 / (1.0 + np.exp(-eta))).mean(axis=1)
                phi[rows, j] += now - before
                before = now
        out = {c: np.repeat(pdf[c].to_numpy(), p) for c in keep}
        return pd.DataFrame(out | {"feature": np.tile(np.array(feats, dtype=object), n), "phi": (phi / n_permutations).reshape(-1),
                                   "base": np.full(n * p, base)})

    def run(batches):
        for big in batches:
            for start in range(0, len(big), 512):   # bound the rows x background block
                yield block(big.iloc[start:start + 512], bc.value)

    rows = df.select(*keep, *feats, hash_int(F.lit(seed), *[F.col(k) for k in keep]).alias("__h"))
    return rows.mapInPandas(run, out_schema)


def shapley_model(df: DataFrame, scorer: ModelScorer, feats: list[str], keep: list[str], n_background: int = 20, seed: int = 42,
                  n_permutations: int = 3) -> DataFrame:
    """I10 for any fitted model on its raw inputs ``feats``: the steps of
    ``shapley_sampled`` as rows (row x permutation x step x background), scored
    by the model's own ``transform`` and averaged over the background.
    ``keep`` is the row key, by which rows are dealt first: a row's steps stay in its task."""
    p = len(feats)
    whole, df = df, df.repartition(*[F.col(k) for k in keep])
    others = [c for c in df.columns if c not in feats and c not in keep]
    orders = F.pandas_udf(lambda h: pd.Series(list(feature_orders(h.to_numpy(), p, n_permutations).reshape(len(h), -1))), "array<long>")
    rows = df.withColumn("__o", orders(hash_int(F.lit(seed), *[F.col(k) for k in keep])))
    steps = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1)))) \
        .withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(p)))) \
        .withColumn("__in", F.slice("__o", F.col("__k") * p + 1, F.col("__t"))) \
        .withColumn("__j", F.when(F.col("__t") > 0, F.get("__o", F.col("__k") * p + F.col("__t") - 1)))
    bg = _background(whole, feats, keep, n_background, seed).select(*[F.col(f).alias(f"__bg_{f}") for f in feats])
    # n_background rows: the sample that the method fixes
    mixed = steps.crossJoin(F.broadcast(bg)).select(*keep, *others, "__j", "__k", "__t", *[
        F.when(F.array_contains("__in", F.lit(j).cast("bigint")), F.col(f)).otherwise(F.col(f"__bg_{f}")).alias(f) for j, f in enumerate(feats)])
    value = scorer.frame(mixed).groupBy(*keep, "__k", "__t", "__j").agg(F.avg("__p").alias("__v"))     # a step moves one feature
    w = Window.partitionBy(*keep, "__k").orderBy("__t")   # p + 1 rows
    change = value.withColumn("__d", F.col("__v") - F.lag("__v").over(w)).withColumn("__base", F.first("__v").over(w))
    name = F.element_at(F.array(*[F.lit(f) for f in feats]), (F.col("__j") + 1).cast("int"))
    return change.where("__t > 0").groupBy(*keep, name.alias("feature")).agg(F.avg("__d").alias("phi"), F.avg("__base").alias("base"))


def permutation_importance(df: DataFrame, scorer: Scorer, y: str, id_col: str, row_key: str,
                           features: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Group-block permutation importance = baseline PR-AUC (trapezoid) minus
    PR-AUC after replacing one feature. For every feature, entity groups are
    permuted (destination rank k takes the entity with hash rank k) and each
    destination row draws a donor row of its source entity with replacement
    (hash of feature and row key modulo the source size). Donors are found by an
    equi-join on (source entity, index); all features run in one job. Rows meet
    what their entity draws from once for all features, and donors are sent once."""
    if features is None and not isinstance(scorer, Scorer):
        raise ValueError("features must be given for a model scorer")
    feats = features or scorer.features
    spark = df.sparkSession
    cols = [row_key, id_col, y, *feats] if isinstance(scorer, Scorer) else df.columns   # a model needs all its inputs
    df = df.select(*dict.fromkeys(cols)).persist()
    fl = spark.createDataFrame([(f,) for f in feats], "feature string")
    ids = df.select(id_col).distinct()
    # plain order of entities and a hash order per feature, both ranked without a global window
    ranked_plain = running_sums(ids, [], [F.col(id_col)], {"__k": F.lit(1).cast("bigint")}, inclusive=True, persist=True)
    hashed = ids.crossJoin(F.broadcast(fl)).withColumn(
        "__hx", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("feature"), F.col(id_col).cast("string"))))
    ranked_hash = running_sums(hashed, ["feature"], [F.col("__hx"), F.col(id_col)], {"__k": F.lit(1).cast("bigint")},
                               inclusive=True, persist=True)
    # per entity: what each feature is drawn from, and how many rows that has
    sizes = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n_src")).withColumnRenamed(id_col, "src_id")
    source = ranked_hash.select("feature", F.col(id_col).alias("src_id"), "__k").join(sizes, "src_id")
    mapping = ranked_plain.join(source, "__k").groupBy(id_col).agg(*[
        F.max(F.when(F.col("feature") == f, F.struct("src_id", "__n_src"))).alias(f"__s{i}") for i, f in enumerate(feats)])
    # donor index within each entity (row order)
    idx = running_sums(df.select(id_col, row_key, *feats), [id_col], [F.col(row_key)], {"__idx": F.lit(1).cast("bigint")}, inclusive=False)
    donors = idx.select(F.col(id_col).alias("src_id"), F.coalesce("__idx", F.lit(0)).alias("__idx"), *[F.col(f).alias(f"__d{i}") for i, f in enumerate(feats)])
    draw = [F.struct(F.lit(i).alias("feature"), F.col(f"__s{i}.src_id").alias("src_id"),
                     F.pmod(hash_int(F.lit(seed), F.lit(f), F.col(row_key)), F.col(f"__s{i}.__n_src")).alias("__idx")) for i, f in enumerate(feats)]
    kept = [c for c in df.columns if not isinstance(scorer, Scorer) or c not in (row_key, id_col)]
    dst = df.join(mapping, id_col).select(*kept, F.explode(F.array(*draw)).alias("__draw")) \
        .select(*kept, F.col("__draw.feature").alias("__f"), F.col("__draw.src_id").alias("__src"), F.col("__draw.__idx").alias("__i")).where("__src is not null")
    j = dst.join(donors, (F.col("__src") == F.col("src_id")) & (F.col("__i") == F.col("__idx")), "left")
    over = {f: F.when(F.col("__f") == i, F.col(f"__d{i}")).otherwise(F.col(f)) for i, f in enumerate(feats)}
    perm = predict(j, scorer, over)
    hist = score_histogram(perm, ["__f"], y, "__p").persist()   # read for the sums and for the totals
    pa = auc_ap(curve_table(hist, ["__f"]), ["__f"])
    base = auc_ap(curve_table(score_histogram(predict(df, scorer), [], y, "__p")))
    return pa.crossJoin(F.broadcast(base.select(F.col("pr_auc_trapz").alias("baseline")))).select(
        F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("__f") + 1).alias("Variable"), (F.col("baseline") - F.col("pr_auc_trapz")).alias("Importance"))
