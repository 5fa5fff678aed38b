"""Discrimination and calibration metrics from one score histogram.

Every metric here is a function of the histogram
``(keys..., score, pos, neg)`` = weighted positives/negatives per distinct
score. Rows are scanned once and reduced with map-side combine; curve
quantities (cumulative positives/negatives below each score) come from a
prefix sum over the histogram, never from a global sort of rows. ``keys``
(e.g. model, replicate, subgroup) let many evaluations share one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import equal_width_bin, finite
from cohortlens.operators.prefix import running_sums

METRIC_NAMES = ["roc_auc", "pr_auc", "brier", "ece", "tp", "tn", "fp", "fn", "precision", "sensitivity"]


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def score_histogram(df: DataFrame, keys: list[str] | None = None, y: str = "y_true", p: str = "y_prob",
                    weight: str | None = None, event_level: str = "second") -> DataFrame:
    """(keys..., score, pos, neg, n) over rows with a finite score and a 0/1 label.

    ``event_level``: "second" takes label 1 as the event (the score is its
    probability), "first" label 0 (with one minus the score)."""
    if event_level not in ("first", "second"):
        raise ValueError(f"unknown event level {event_level!r}")
    keys = list(keys or [])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.where(finite(p) & F.col(y).isNotNull())
    yy, score = F.col(y).cast("double"), F.col(p).cast("double")
    if event_level == "first":
        yy, score = F.lit(1.0) - yy, F.lit(1.0) - score
    return d.groupBy(*keys, score.alias("score")).agg(
        F.sum(w * yy).alias("pos"), F.sum(w * (F.lit(1.0) - yy)).alias("neg"))


def curve_table(hist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``pos_below``/``neg_below`` (weights at strictly lower scores) and the
    group totals ``P``/``N``; the basis for AUC, AP, ROC and PR points."""
    keys = list(keys or [])
    c = running_sums(hist, keys, [F.col("score")],
                          {"pos_below": F.col("pos"), "neg_below": F.col("neg")}, inclusive=False, persist=True)
    tot = hist.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = c.withColumn("pos_below", F.coalesce("pos_below", F.lit(0.0))) \
         .withColumn("neg_below", F.coalesce("neg_below", F.lit(0.0)))
    # keyed totals have one row per key group (unbounded): plain join, AQE may
    # still broadcast it at runtime after measuring; the global total is one row
    c = c.join(tot, keys, "inner") if keys else c.crossJoin(F.broadcast(tot))
    return c.withColumn("tp_ge", F.col("P") - F.col("pos_below")) \
            .withColumn("fp_ge", F.col("N") - F.col("neg_below"))


def auc_ap(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """E1 ROC-AUC (ties count one half; Mann-Whitney) and E2 average precision
    (step sum over distinct thresholds), plus E3 trapezoidal PR-AUC starting at
    (recall 0, precision 1). Null when a class is absent."""
    keys = list(keys or [])
    prec = _div(F.col("tp_ge"), F.col("tp_ge") + F.col("fp_ge"))
    tp_gt = F.col("tp_ge") - F.col("pos")
    fp_gt = F.col("fp_ge") - F.col("neg")
    prec_prev = F.when(tp_gt + fp_gt == 0, F.lit(1.0)).otherwise(_div(tp_gt, tp_gt + fp_gt))
    r = F.col("pos") / F.col("P")
    return curve.groupBy(*keys).agg(
        _div(F.sum(F.col("pos") * (F.col("neg_below") + F.lit(0.5) * F.col("neg"))),
             F.first("P") * F.first("N")).alias("roc_auc"),
        _div(F.sum(F.col("pos") * prec), F.first("P")).alias("pr_auc"),
        F.sum(F.when(F.col("P") > 0, r * (prec + prec_prev) / F.lit(2.0))).alias("pr_auc_trapz"),
        F.first("P").alias("P"), F.first("N").alias("N"),
    ).withColumn("roc_auc", F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("roc_auc"))) \
     .withColumn("pr_auc", F.when(F.col("P") > 0, F.col("pr_auc"))) \
     .withColumn("pr_auc_trapz", F.when(F.col("P") > 0, F.col("pr_auc_trapz")))


def ece_bin(p: Column, n_bins: int = 10, closed_last: bool = False) -> Column:
    """Bin index with edges i/n_bins computed as ``i * (1.0/n_bins)`` in double,
    half-open [e_i, e_i+1); p = 1.0 falls in no bin unless ``closed_last``."""
    step = 1.0 / n_bins
    idx = sum((p >= F.lit(j * step)).cast("int") for j in range(1, n_bins))
    inside = (p >= F.lit(0.0)) & ((p <= F.lit(1.0)) if closed_last else (p < F.lit(1.0)))
    return F.when(inside, idx)


def reliability_bin(p: Column, n_bins: int = 10) -> Column:
    """Right-closed uniform bins, 0 and 1 included (the plotting convention)."""
    step = 1.0 / n_bins
    return sum((p > F.lit(j * step)).cast("int") for j in range(1, n_bins))


def metric_table(hist: DataFrame, keys: list[str] | None = None, threshold: float = 0.5,
                 n_bins: int = 10, closed_last: bool = False, curve: DataFrame | None = None,
                 strict: bool = False) -> DataFrame:
    """One row per key group with roc_auc, pr_auc, brier, ece, tp, tn, fp, fn,
    precision, sensitivity - all from the histogram. Predicted positive is
    score >= threshold (``strict``: score > threshold, the bootstrap's rule in the reference)."""
    keys = list(keys or [])
    curve = curve if curve is not None else curve_table(hist, keys)
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    n = pos + neg
    thr = F.lit(float(threshold))
    pred = (s > thr) if strict else (s >= thr)
    base = hist.groupBy(*keys).agg(
        _div(F.sum(pos * (F.lit(1.0) - s) * (F.lit(1.0) - s) + neg * s * s), F.sum(n)).alias("brier"),
        F.sum(F.when(pred, pos).otherwise(0.0)).alias("tp"),
        F.sum(F.when(pred, neg).otherwise(0.0)).alias("fp"),
        F.sum(F.when(~pred, pos).otherwise(0.0)).alias("fn"),
        F.sum(F.when(~pred, neg).otherwise(0.0)).alias("tn"),
        F.sum(n).alias("__n"))
    b = hist.withColumn("__bin", ece_bin(s, n_bins, closed_last)).where(F.col("__bin").isNotNull()) \
        .groupBy(*keys, "__bin").agg(F.sum(n).alias("__nb"), F.sum(s * n).alias("__sp"), F.sum(pos).alias("__sy"))
    e = b.join(base.select(*keys, "__n"), keys, "inner") if keys else b.crossJoin(base.select("__n"))
    e = e.groupBy(*keys).agg(F.sum(F.abs(F.col("__sy") / F.col("__nb") - F.col("__sp") / F.col("__nb"))
                                   * F.col("__nb") / F.col("__n")).alias("ece"))
    a = auc_ap(curve, keys)
    out = base.join(a, keys, "left") if keys else base.crossJoin(a)
    out = out.join(e, keys, "left") if keys else out.crossJoin(e)
    return out.select(
        *keys, "roc_auc", "pr_auc", "brier", F.coalesce("ece", F.lit(0.0)).alias("ece"),
        "tp", "tn", "fp", "fn",
        F.coalesce(_div(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(_div(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)).alias("sensitivity"))


def metrics(df: DataFrame, keys: list[str] | None = None, y: str = "y_true", p: str = "y_prob",
            threshold: float = 0.5, n_bins: int = 10, closed_last: bool = False, weight: str | None = None,
            strict: bool = False) -> DataFrame:
    """E8 from scored rows: the full metric row for every key group."""
    hist = score_histogram(df, keys, y, p, weight).persist()
    return metric_table(hist, keys, threshold, n_bins, closed_last, strict=strict)


def evaluate_models(models: dict, data: DataFrame, metrics_fn) -> DataFrame:
    """Rows of ``metrics_fn(model, data)`` for each named model, stacked, with the name first."""
    out = None
    for name, model in models.items():
        part = metrics_fn(model, data)
        part = part.select(F.lit(name).alias("model"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out


def confusion(df: DataFrame, keys: list[str] | None = None, y: str = "y_true", p: str = "y_prob",
              threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Four counts in one pass; a one-class input still yields all four."""
    keys = list(keys or [])
    pred = (F.col(p) > threshold) if strict else (F.col(p) >= threshold)
    yy = F.col(y)
    return df.groupBy(*keys).agg(
        F.count_if((yy == 1) & pred).alias("tp"), F.count_if((yy == 0) & pred).alias("fp"),
        F.count_if((yy == 1) & ~pred).alias("fn"), F.count_if((yy == 0) & ~pred).alias("tn"))


def rates_from_counts(df: DataFrame) -> DataFrame:
    """Sensitivity, specificity, precision, F1, Youden with 0 fallback."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    z = F.lit(0.0)
    sens = F.coalesce(_div(tp, tp + fn), z)
    spec = F.coalesce(_div(tn, tn + fp), z)
    return df.withColumn("sens", sens).withColumn("spec", spec) \
             .withColumn("precision", F.coalesce(_div(tp, tp + fp), z)) \
             .withColumn("f1", F.coalesce(_div(2 * tp, 2 * tp + fp + fn), z)) \
             .withColumn("youden", F.col("sens") + F.col("spec") - F.lit(1.0))


def roc_points(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    keys = list(keys or [])
    return curve.select(*keys, F.col("score").alias("threshold"),
                        _div(F.col("fp_ge"), F.col("N")).alias("fpr"), _div(F.col("tp_ge"), F.col("P")).alias("tpr"))


def roc_points_thinned(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """E11 with collinear points dropped (the plotting library's default): a point is
    kept when the second difference of FP or TP counts around it is non-zero; the
    first and last points are always kept. Points are ranked by descending score with
    a distributed prefix count and joined to their neighbours on (keys, rank)."""
    keys = list(keys or [])
    ranked = running_sums(curve, keys, [-F.col("score")], {"__r": F.lit(1).cast("bigint")}, inclusive=True, persist=True)
    ranked = ranked.withColumn("__r", F.col("__r").cast("bigint"))
    n = ranked.groupBy(*keys).agg(F.max("__r").alias("__n"))
    nb = ranked.select(*keys, "__r", "fp_ge", "tp_ge")
    prev = nb.select(*keys, (F.col("__r") + 1).alias("__r"), F.col("fp_ge").alias("__fp0"), F.col("tp_ge").alias("__tp0"))
    nxt = nb.select(*keys, (F.col("__r") - 1).alias("__r"), F.col("fp_ge").alias("__fp2"), F.col("tp_ge").alias("__tp2"))
    j = ranked.join(prev, keys + ["__r"], "left").join(nxt, keys + ["__r"], "left")
    j = j.join(n, keys, "inner") if keys else j.crossJoin(F.broadcast(n))
    bend = ((F.col("__fp2") - 2 * F.col("fp_ge") + F.col("__fp0")) != 0) | \
           ((F.col("__tp2") - 2 * F.col("tp_ge") + F.col("__tp0")) != 0)
    keep = (F.col("__r") == 1) | (F.col("__r") == F.col("__n")) | F.coalesce(bend, F.lit(False))
    return roc_points(j.where(keep), keys)


def pr_points(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    keys = list(keys or [])
    return curve.select(*keys, F.col("score").alias("threshold"),
                        _div(F.col("tp_ge"), F.col("tp_ge") + F.col("fp_ge")).alias("precision"),
                        _div(F.col("tp_ge"), F.col("P")).alias("recall"))


def reliability(hist: DataFrame, keys: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """Mean predicted vs observed rate per uniform bin (empty bins dropped)."""
    keys = list(keys or [])
    n = F.col("pos") + F.col("neg")
    return hist.withColumn("bin", reliability_bin(F.col("score"), n_bins)).groupBy(*keys, "bin").agg(
        (F.sum(F.col("score") * n) / F.sum(n)).alias("mean_pred"),
        (F.sum("pos") / F.sum(n)).alias("frac_pos"), F.sum(n).alias("n")).where(F.col("n") > 0)


def class_score_histogram(df: DataFrame, keys: list[str] | None = None, y: str = "y_true", p: str = "y_prob",
                          bins: int = 20) -> DataFrame:
    """Score histogram per class, each class over its own min..max (last bin closed).
    Rows are first reduced to (keys, class, distinct score) counts, so the range join
    and the binning run on the reduced table."""
    keys = list(keys or []) + [y]
    d = df.where(finite(p) & F.col(y).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("__x")) \
          .agg(F.count(F.lit(1)).alias("__c"))
    rng = d.groupBy(*keys).agg(F.min("__x").alias("vmin"), F.max("__x").alias("vmax"))
    b = equal_width_bin("__x", "vmin", "vmax", bins)
    return d.join(rng, keys).withColumn("bin", b).groupBy(*keys, "bin").agg(F.sum("__c").alias("count"))


def metrics_long(table: DataFrame, keys: list[str], names: list[str] = METRIC_NAMES) -> DataFrame:
    """U2 for metric rows: (keys..., metric, value)."""
    t = table.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return t.unpivot(keys, names, "metric", "value")


def metric_deltas(baseline: DataFrame, variant: DataFrame, keys: list[str]) -> DataFrame:
    """Join two long metric tables on (keys, metric): absolute and relative % change."""
    b = baseline.withColumnRenamed("value", "baseline")
    v = variant.withColumnRenamed("value", "variant")
    j = b.join(v, keys + ["metric"], "inner")
    return j.withColumn("abs_delta", F.col("variant") - F.col("baseline")) \
            .withColumn("rel_delta_pct", _div(F.col("abs_delta"), F.col("baseline")) * F.lit(100.0))
