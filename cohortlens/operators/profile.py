"""Profiling aggregates A1-A14, P14, T9: frequencies, summaries, IQR outliers,
correlations, histograms, box statistics, kernel densities, quartile bands.

Wide tables are unpivoted to (variable, value) so that one grouped aggregate
serves every column (one job, one shuffle) instead of one job per column.
Statistics that feed back into row-level filters (IQR bounds, quantile breaks,
min/max) are one row per variable and are joined back with ``broadcast`` - their
size is the number of variables, not the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import equal_width_bin
from cohortlens.operators.quantile import long_quantiles, quantiles
from cohortlens.session import ship_package


def categorical_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """A1: (variable, category, frequency, percentage) with nulls kept as a category;
    percentage = count / total * 100 rounded half-even to 2 places (T10)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
             .unpivot([], cols, "variable", "category")
    g = long.groupBy("variable", "category").agg(F.count(F.lit(1)).alias("frequency"))
    # totals per variable (one row each) joined back: no window holding all
    # categories of a variable in one task
    tot = g.groupBy("variable").agg(F.sum("frequency").alias("__total"))
    return g.join(F.broadcast(tot), "variable").withColumn(
        "percentage", F.bround(F.col("frequency") / F.col("__total") * F.lit(100.0), 2)).drop("__total")


def prevalence(df: DataFrame, target: str) -> DataFrame:
    """A2: (target value, n, percentage)."""
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("__total"))   # one row
    return g.crossJoin(F.broadcast(tot)).withColumn(
        "percentage", F.bround(F.col("n") / F.col("__total") * 100.0, 2)).drop("__total")


def numeric_summary(df: DataFrame, cols: list[str], quantile_method: str = "rank") -> DataFrame:
    """A3: count, mean, std (ddof 1), min, 25/50/75% (exact, linear), max per variable."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    moments = long.groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(long, "value", [0.25, 0.5, 0.75], ["variable"], ["q25", "q50", "q75"], quantile_method)
    return moments.join(q, "variable", "left")


def iqr_bounds(df: DataFrame, cols: list[str], quantile_method: str = "rank") -> DataFrame:
    """(variable, lower, upper) = Q1 - 1.5 IQR, Q3 + 1.5 IQR for all columns in one pass."""
    q = long_quantiles(df, cols, [0.25, 0.75], ["q1", "q3"], method=quantile_method)
    iqr = F.col("q3") - F.col("q1")
    return q.select("variable", (F.col("q1") - F.lit(1.5) * iqr).alias("lower"),
                    (F.col("q3") + F.lit(1.5) * iqr).alias("upper"))


def _bounds_row(bounds: DataFrame, cols: list[str]) -> DataFrame:
    """Pivot the per-variable bounds to one row (size = number of variables)."""
    aggs = []
    for c in cols:
        aggs += [F.max(F.when(F.col("variable") == c, F.col("lower"))).alias(f"__lo_{c}"),
                 F.max(F.when(F.col("variable") == c, F.col("upper"))).alias(f"__hi_{c}")]
    return bounds.agg(*aggs)


def detect_outliers(df: DataFrame, col: str, quantile_method: str = "rank") -> DataFrame:
    """A4: rows strictly outside the IQR fences of ``col``."""
    b = F.broadcast(_bounds_row(iqr_bounds(df, [col], quantile_method), [col]))
    x = F.col(col)
    return df.crossJoin(b).where((x < F.col(f"__lo_{col}")) | (x > F.col(f"__hi_{col}"))) \
             .drop(f"__lo_{col}", f"__hi_{col}")


def outlier_report(df: DataFrame, cols: list[str], quantile_method: str = "rank") -> DataFrame:
    """A5: (variable, lower, upper, n_outliers) for every column, bounds in one pass."""
    bounds = iqr_bounds(df, cols, quantile_method)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    j = long.join(F.broadcast(bounds), "variable")
    n_out = j.groupBy("variable").agg(
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("n_outliers"))
    return bounds.join(n_out, "variable", "left") \
                 .withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))


def outliers_long(df: DataFrame, cols: list[str], key: str, quantile_method: str = "rank") -> DataFrame:
    """A4 for every column at once: (variable, key, value) of the rows outside the
    fences - the long table a per-variable sink (S4) partitions by variable."""
    bounds = iqr_bounds(df, cols, quantile_method)
    long = df.select(F.col(key).alias("__key"), *[F.col(c).cast("double").alias(c) for c in cols]) \
             .unpivot(["__key"], cols, "variable", "value")
    j = long.join(F.broadcast(bounds), "variable")   # one row per variable
    return j.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))) \
            .select("variable", F.col("__key").alias(key), "value")


def flag_outliers(df: DataFrame, cols: list[str], quantile_method: str = "rank") -> DataFrame:
    """``<col>_is_outlier`` booleans; a null value is not an outlier."""
    b = F.broadcast(_bounds_row(iqr_bounds(df, cols, quantile_method), cols))
    out = df.crossJoin(b)
    for c in cols:
        cond = (F.col(c) < F.col(f"__lo_{c}")) | (F.col(c) > F.col(f"__hi_{c}"))
        out = out.withColumn(f"{c}_is_outlier", F.coalesce(cond, F.lit(False)))
    return out.drop(*[x for c in cols for x in (f"__lo_{c}", f"__hi_{c}")])


def episodes_per_entity(df: DataFrame, id_col: str = "id", value: str = "dos") -> DataFrame:
    """Non-null visits per entity."""
    return df.groupBy(id_col).agg(F.count(value).alias("episodes"))


def median_by_group(df: DataFrame, by: list[str], value: str, method: str = "rank") -> DataFrame:
    """Exact median per group."""
    return quantiles(df, value, [0.5], by, ["median"], method)


def pearson(a, b):
    """Pairwise-complete Pearson correlation that is null (not an error under ANSI
    mode, where Spark's ``corr`` divides by zero) when either side is constant."""
    a_pair = F.when(b.isNotNull(), a)
    b_pair = F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a_pair) * F.stddev_samp(b_pair))


def correlation_matrix(df: DataFrame, cols: list[str], complete_cases: bool = False) -> DataFrame:
    """Pearson correlation per pair (pairwise-complete by default; with
    ``complete_cases`` rows with any null among ``cols`` are dropped first).
    One aggregate pass computes every pair. Constant columns give null."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if complete_cases:
        d = d.dropna(subset=cols)
    aggs = []
    for a in cols:
        for b in cols:
            aggs.append(pearson(F.col(a), F.col(b)).alias(f"{a}__{b}"))
    wide = d.agg(*aggs)
    pairs = [f"{a}__{b}" for a in cols for b in cols]
    long = wide.unpivot([], pairs, "pair", "corr")
    parts = F.split("pair", "__")
    return long.select(parts[0].alias("var_a"), parts[1].alias("var_b"),
                       F.when(F.isnan("corr"), None).otherwise(F.col("corr")).alias("corr"))


def equal_width_histogram(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max, last bin closed: (variable, bin, lo, hi, count).
    Min/max are one row per variable (broadcast)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "variable", "value") \
             .where(F.col("value").isNotNull() & ~F.isnan("value"))
    # reduce to distinct values first; min/max and binning run on the reduced table
    vals = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("__c"))
    rng = vals.groupBy("variable").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    b = equal_width_bin("value", "vmin", "vmax", bins)
    h = vals.join(F.broadcast(rng), "variable").withColumn("bin", b) \
            .groupBy("variable", "bin", "vmin", "vmax").agg(F.sum("__c").alias("count"))
    step = (F.col("vmax") - F.col("vmin")) / F.lit(float(bins))
    return h.select("variable", "bin", (F.col("vmin") + F.col("bin") * step).alias("lo"),
                    (F.col("vmin") + (F.col("bin") + 1) * step).alias("hi"), "count")


def counts_in_order(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """Count per category with a fixed display order (levels not present give 0)."""
    spark = df.sparkSession
    order = spark.createDataFrame([(lv, i) for i, lv in enumerate(levels)], f"{col} string, position int")
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(order).join(g, col, "left").select(col, "position", F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, value: str, by: list[str], quantile_method: str = "rank") -> DataFrame:
    """Quartiles, whiskers at the furthest points inside 1.5 IQR, outlier count per group."""
    q = quantiles(df, value, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"], quantile_method)
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("__lo", F.col("q1") - 1.5 * iqr).withColumn("__hi", F.col("q3") + 1.5 * iqr)
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("__x")).where(F.col("__x").isNotNull())
    j = rows.join(q, by) if by else rows.crossJoin(F.broadcast(q))   # overall: one row of statistics
    inside = (F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi"))
    s = j.groupBy(*by).agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return q.drop("__lo", "__hi").join(s, by) if by else q.drop("__lo", "__hi").crossJoin(s)


#: Groups that a task holds kernel sums of before it hands them on.
KDE_GROUPS = 10_000


def _kernel_sums(gridsize: int):
    """Sums of the Gaussian kernel over a task's values (__g, x, lo, hi, bw), per group and grid point."""
    def run(frames):
        sums: dict[int, np.ndarray] = {}

        def out():
            return pd.DataFrame({"__g": np.repeat(np.array(list(sums), np.int64), gridsize), "point": np.tile(np.arange(gridsize), len(sums)), "__k": np.concatenate(list(sums.values()))})

        for pdf in frames:
            for g, rows in pdf.groupby("__g"):
                lo, hi, bw = (float(rows[c].iloc[0]) for c in ("lo", "hi", "bw"))
                grid = lo + (hi - lo) * np.arange(gridsize) / float(gridsize - 1)
                z = (grid[:, None] - rows["x"].to_numpy()[None, :]) / bw
                sums[g] = sums.get(g, 0.0) + np.exp(-0.5 * z * z).sum(axis=1)
            if len(sums) > KDE_GROUPS:
                yield out()
                sums.clear()
        if sums:
            yield out()

    return run


def kde_by_group(df: DataFrame, value: str, group: str, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE per group on its own grid (Scott's factor n^(-1/5) times the
    sample sd, grid min - cut*bw .. max + cut*bw), densities scaled by group share.

    Each task sums the kernels of its own rows on the grids of the groups it meets, so a
    row never becomes a row per grid point and only groups x gridsize sums are shuffled.
    """
    ship_package(df.sparkSession)
    x = F.col(value).cast("double")
    d = df.select(F.col(group), x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & F.col(group).isNotNull())
    stats = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                                 F.min("x").alias("vmin"), F.max("x").alias("vmax"))
    total = stats.agg(F.sum("n").alias("__total"))   # one row
    stats = stats.crossJoin(F.broadcast(total)) \
                 .withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))) \
                 .withColumn("share", F.col("n") / F.col("__total")) \
                 .select(group, F.xxhash64(group).alias("__g"), "n", "bw", "share", (F.col("vmin") - F.lit(cut) * F.col("bw")).alias("lo"),
                         (F.col("vmax") + F.lit(cut) * F.col("bw")).alias("hi"))
    sums = d.join(stats.where("bw > 0").select(group, "__g", "lo", "hi", "bw"), group).select("__g", "x", "lo", "hi", "bw") \
        .mapInPandas(_kernel_sums(gridsize), "__g long, point long, __k double").groupBy("__g", "point").agg(F.sum("__k").alias("__k"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gridsize - 1).cast("long"))).alias("point"))
    norm = F.try_divide(F.lit(1.0 / math.sqrt(2 * math.pi)), F.col("n") * F.col("bw"))   # constant group: bw = 0 -> null density
    return grid.join(sums, ["__g", "point"], "left").select(
        group, "point", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(float(gridsize - 1))).alias("x"),
        (F.col("__k") * norm * F.col("share")).alias("density"))


def top_decile(df: DataFrame, value: str, method: str = "rank") -> DataFrame:
    """Rows with value above the exact 90th percentile (one-row broadcast)."""
    q = F.broadcast(quantiles(df, value, [0.9], [], ["__p90"], method))
    return df.crossJoin(q).where(F.col(value) > F.col("__p90")).drop("__p90")


QUARTILE_LABELS = ["Q1_low", "Q2", "Q3", "Q4_high"]


def quartile_band(df: DataFrame, value: str, out: str = "quartile", labels: list[str] = QUARTILE_LABELS,
                  method: str = "rank") -> DataFrame:
    """Quartile bands with type-7 breaks over the whole column, right-closed,
    lowest value included. Duplicate breaks raise (as ``cut`` does); the five
    breaks are the only values that reach the driver."""
    q = quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], [], [f"b{i}" for i in range(5)], method).first()
    if q is None or q["b0"] is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    b = [float(q[f"b{i}"]) for i in range(5)]
    if len(set(b)) < 5:
        raise ValueError(f"breaks are not unique: {b}")
    x = F.col(value)
    expr = F.when((x >= F.lit(b[0])) & (x <= F.lit(b[1])), labels[0])
    for i in range(1, 4):
        expr = expr.when((x > F.lit(b[i])) & (x <= F.lit(b[i + 1])), labels[i])
    return df.withColumn(out, expr)
