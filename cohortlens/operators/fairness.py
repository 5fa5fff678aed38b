"""Subgroup summaries, one-way ANOVA and subgroup fairness.

Nulls follow the reference's three-valued rules: an entity's mean score is
missing if any of its scores is missing; sensitivity (specificity) is missing
if any positive (negative) entity lacks a score; AUC uses only scored entities.
All groupings run as one job over (variable, level) after an unpivot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.stats import f_sf
from cohortlens.operators.metrics import auc_ap, curve_table, score_histogram
from cohortlens.operators.quantile import quantiles


def entity_rates(df: DataFrame, group: str, y: str = "target_num", id_col: str = "id") -> DataFrame:
    """Mean target per (entity, group)."""
    return df.where(F.col(y).isNotNull()).groupBy(id_col, group).agg(F.avg(y).alias("mean_target"))


def group_rate_summary(rates: DataFrame, group: str, value: str = "mean_target") -> DataFrame:
    """Mean, sd (ddof 1) and count of entity means per group."""
    return rates.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                    F.count(value).alias("n"))


def anova_oneway(rates: DataFrame, group: str, value: str = "mean_target") -> DataFrame:
    """one-way ANOVA of entity means across groups (unweighted entities).
    SSB and SSW come from one grouped pass; only 3 numbers per group reach the driver."""
    g = rates.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"),
        (F.stddev_pop(value) * F.stddev_pop(value) * F.count(value)).alias("ss"))
    rows = g.collect()   # one row per group level
    n = sum(r["n"] for r in rows)
    k = len(rows)
    grand = sum(r["n"] * r["m"] for r in rows) / n
    ssb = sum(r["n"] * (r["m"] - grand) ** 2 for r in rows)
    ssw = sum(r["ss"] for r in rows)
    df1, df2 = k - 1, n - k
    msb = ssb / df1 if df1 > 0 else None
    msw = ssw / df2 if df2 > 0 else None
    f = msb / msw if msb is not None and msw else None
    p = f_sf(f, df1, df2) if f is not None else None
    out = [(group, df1, ssb, msb, f, p), ("Residuals", df2, ssw, msw, None, None)]
    return rates.sparkSession.createDataFrame(
        out, "term string, df bigint, sum_sq double, mean_sq double, f_value double, p_value double")


def entity_collapse(df: DataFrame, group_cols: list[str], y: str = "target_num", p: str = "y_prob",
                    id_col: str = "id") -> DataFrame:
    """Per (variable, level, entity): y = max(target), p = mean score, null if any score is null."""
    long = df.select(id_col, y, p, *[F.col(c).cast("string").alias(c) for c in group_cols]) \
             .unpivot([id_col, y, p], group_cols, "variable", "level")
    return long.groupBy("variable", "level", id_col).agg(
        F.max(y).alias("y_true"),
        F.when(F.count(p) == F.count(F.lit(1)), F.avg(p)).alias("y_pred"))


def fairness_metrics(df: DataFrame, group_cols: list[str], threshold: float, y: str = "target_num",
                     p: str = "y_prob", id_col: str = "id") -> DataFrame:
    """per (variable, level): AUC (auto direction), sensitivity, specificity,
    n, n_pos, n_neg, n_scored and validity flags."""
    ent = entity_collapse(df, group_cols, y, p, id_col).persist()
    thr = F.lit(float(threshold))
    yt, yp = F.col("y_true"), F.col("y_pred")
    counts = ent.groupBy("variable", "level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yt == 1).alias("n_pos"), F.count_if(yt == 0).alias("n_neg"),
        F.count(yp).alias("n_scored"),
        F.count_if((yt == 1) & yp.isNull()).alias("__pos_missing"),
        F.count_if((yt == 0) & yp.isNull()).alias("__neg_missing"),
        F.count_if((yt == 1) & (yp >= thr)).alias("__tp"),
        F.count_if((yt == 0) & (yp < thr)).alias("__tn"))
    scored = ent.where(yp.isNotNull() & yt.isNotNull())
    keys = ["variable", "level"]
    auc = auc_ap(curve_table(score_histogram(scored, keys, "y_true", "y_pred"), keys), keys).select(*keys, "roc_auc")
    med = quantiles(scored, "y_pred", [0.5], keys + ["y_true"], ["med"], method="rank")
    direction = med.groupBy(*keys).agg(
        F.max(F.when(F.col("y_true") == 0, F.col("med"))).alias("__med_ctrl"),
        F.max(F.when(F.col("y_true") == 1, F.col("med"))).alias("__med_case"))
    out = counts.join(auc, keys, "left").join(direction, keys, "left")
    flip = F.col("__med_ctrl") > F.col("__med_case")
    auc_dir = F.when(flip, F.lit(1.0) - F.col("roc_auc")).otherwise(F.col("roc_auc"))
    return out.select(
        *keys,
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc_dir).alias("AUC"),
        F.when((F.col("n_pos") > 0) & (F.col("__pos_missing") == 0), F.col("__tp") / F.col("n_pos")).alias("Sensitivity"),
        F.when((F.col("n_neg") > 0) & (F.col("__neg_missing") == 0), F.col("__tn") / F.col("n_neg")).alias("Specificity"),
        "n", "n_pos", "n_neg", "n_scored",
        ((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).alias("valid_auc"),
        (F.col("n_pos") > 0).alias("valid_sens"), (F.col("n_neg") > 0).alias("valid_spec"))


def valid_only(fair: DataFrame) -> DataFrame:
    """keep levels where every metric is estimable."""
    return fair.where(F.col("valid_auc") & F.col("valid_sens") & F.col("valid_spec"))


def fairness_long(fair: DataFrame) -> DataFrame:
    """F8: long table (variable, level, term, OR, CI_low, CI_high, label) with CI = point."""
    terms = ["AUC", "Sensitivity", "Specificity"]
    long = fair.select("variable", "level", *terms).unpivot(["variable", "level"], terms, "term", "OR")
    return long.withColumn("CI_low", F.col("OR")).withColumn("CI_high", F.col("OR")) \
               .withColumn("label", F.concat(F.col("variable"), F.lit(": "), F.col("level"), F.lit(" — "), F.col("term")))
