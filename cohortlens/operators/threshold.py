"""Cost-based decision thresholds (H1-H4, H6, O2, O3).

The reference re-scans every row for every (threshold, cost pair): 10 x 10 x
1001 passes. Here rows are scanned once: each score goes to the bucket of the
largest grid threshold it reaches, giving at most ``n_thresh`` rows per key;
suffix sums over that tiny table give the confusion counts at every threshold.
Costs only enter after that reduction (a broadcast cross join with the cost
pairs: 1001 x 100 rows per key).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.metrics import rates_from_counts

# Threshold grid size, cost ranges and the minimum sensitivity.
N_THRESH = 1001
C_FP_RANGE = list(range(1, 11))
C_FN_RANGE = list(range(1, 11))
SENS_MIN = 0.80


def grid_threshold(k: Column, n_thresh: int = N_THRESH) -> Column:
    """Threshold value k / (n-1) computed as k * step in double (last one exactly 1.0),
    the same values an evenly spaced grid from 0 to 1 holds."""
    step = 1.0 / (n_thresh - 1)
    return F.when(k == n_thresh - 1, F.lit(1.0)).otherwise(k.cast("double") * F.lit(step))


def threshold_bucket(p: Column, n_thresh: int = N_THRESH) -> Column:
    """Largest k with threshold(k) <= p; -1 when p is below every threshold
    or missing (never predicted positive)."""
    last = n_thresh - 1
    k0 = F.least(F.greatest(F.floor(p * F.lit(float(last))), F.lit(-1)), F.lit(last)).cast("bigint")
    down = F.when((k0 >= 0) & (grid_threshold(k0, n_thresh) > p), k0 - 1).otherwise(k0)
    up = F.when((down < last) & (grid_threshold(down + 1, n_thresh) <= p), down + 1).otherwise(down)
    return F.when(p.isNull() | F.isnan(p), F.lit(-1).cast("bigint")).otherwise(up)


def threshold_curve(df: DataFrame, keys: list[str] | None = None, y: str = "y_true", p: str = "y_prob",
                    n_thresh: int = N_THRESH) -> DataFrame:
    """H2: (keys..., k, threshold, TP, FP, FN, TN, Mean_alerts, Sens, Spec, Precision, F1, Youden)
    for every grid threshold, prediction = score >= threshold."""
    keys = list(keys or [])
    spark = df.sparkSession
    yy = F.col(y).cast("bigint")
    b = df.where(F.col(y).isNotNull()).groupBy(*keys, threshold_bucket(F.col(p).cast("double"), n_thresh).alias("k")) \
          .agg(F.sum(yy).alias("pos"), F.sum(F.lit(1) - yy).alias("neg"))
    grid = spark.range(n_thresh).select(F.col("id").alias("k"))
    if keys:
        grid = b.select(*keys).distinct().crossJoin(F.broadcast(grid))  # keys x n_thresh rows
    full = grid.join(b, keys + ["k"], "left").fillna(0, ["pos", "neg"])
    totals = b.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(F.col("k").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)   # <= n_thresh rows per key
    c = full.select(*keys, "k", F.sum("pos").over(w).alias("TP"), F.sum("neg").over(w).alias("FP"))
    c = c.join(totals, keys, "inner") if keys else c.crossJoin(F.broadcast(totals))
    c = c.withColumn("FN", F.col("P") - F.col("TP")).withColumn("TN", F.col("N") - F.col("FP"))
    c = c.select(*keys, "k", grid_threshold(F.col("k"), n_thresh).alias("threshold"),
                 F.col("TP").alias("tp"), F.col("FP").alias("fp"), F.col("FN").alias("fn"), F.col("TN").alias("tn"),
                 ((F.col("TP") + F.col("FP")) / (F.col("P") + F.col("N"))).alias("mean_alerts"))
    r = rates_from_counts(c)
    return r.select(*keys, "k", "threshold", F.col("tp").alias("TP"), F.col("fp").alias("FP"),
                    F.col("fn").alias("FN"), F.col("tn").alias("TN"), F.col("mean_alerts").alias("Mean_alerts"),
                    F.col("sens").alias("Sens"), F.col("spec").alias("Spec"), F.col("precision").alias("Precision"),
                    F.col("f1").alias("F1"), F.col("youden").alias("Youden"))


def with_cost(curve: DataFrame, c_fp: float, c_fn: float) -> DataFrame:
    """H1: cost of one (C_FP, C_FN) pair on the curve."""
    return curve.withColumn("C_FP", F.lit(c_fp)).withColumn("C_FN", F.lit(c_fn)) \
                .withColumn("Cost", F.col("C_FN") * F.col("FN") + F.col("C_FP") * F.col("FP"))


def cost_pairs(spark, c_fp_range=C_FP_RANGE, c_fn_range=C_FN_RANGE) -> DataFrame:
    """Cost pairs in generation order (C_FP outer, C_FN inner)."""
    rows = [(i, a, b) for i, (a, b) in enumerate(product(c_fp_range, c_fn_range))]
    return spark.createDataFrame(rows, "pair_order int, C_FP bigint, C_FN bigint")


def optimize_grid(curve: DataFrame, keys: list[str] | None = None, sens_min: float = SENS_MIN,
                  c_fp_range=C_FP_RANGE, c_fn_range=C_FN_RANGE, cost_norm: bool = False) -> DataFrame:
    """Best threshold per cost pair (curve x 100 broadcast cost pairs, row_number per pair). Among thresholds with Sens >= sens_min:
    lowest Cost, then highest Youden, then the first threshold; if none qualifies:
    highest Sens, then Youden, then the first. ``rank`` orders the result by
    (Cost asc, Youden desc, generation order); rank 1 is the global best (O3).
    ``cost_norm`` divides the cost by C_FP + C_FN so pairs on different scales compare."""
    keys = list(keys or [])
    pairs = F.broadcast(cost_pairs(curve.sparkSession, c_fp_range, c_fn_range))  # 100 rows
    x = curve.crossJoin(pairs).withColumn("Cost", F.col("C_FN") * F.col("FN") + F.col("C_FP") * F.col("FP"))
    if cost_norm:
        x = x.withColumn("Cost", F.col("Cost") / (F.col("C_FP") + F.col("C_FN")))
    feasible = F.col("Sens") >= F.lit(sens_min)
    w = Window.partitionBy(*keys, "C_FP", "C_FN").orderBy(
        feasible.desc(), F.when(feasible, F.col("Cost")).asc(), F.when(~feasible, F.col("Sens")).desc(),
        F.col("Youden").desc(), F.col("k").asc())
    best = x.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
    wr = (Window.partitionBy(*keys) if keys else Window).orderBy(
        F.col("Cost").asc(), F.col("Youden").desc(), F.col("pair_order").asc())   # <= 100 rows per key
    return best.withColumn("rank", F.row_number().over(wr))


def best_threshold(grid: DataFrame) -> DataFrame:
    """O3: the first row of the sorted grid per key."""
    return grid.where(F.col("rank") == 1)
