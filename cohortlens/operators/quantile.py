"""Exact quantiles without holding a group's values in one task.

Type-7 (linear interpolation) quantiles, the convention shared by pandas,
R's default, DuckDB ``quantile_cont`` and Spark ``percentile``:
position = (n - 1) * p, value = x[floor] + (x[ceil] - x[floor]) * frac.

``method="rank"`` (default): values are first reduced to (group, value, count)
with map-side combine, cumulative counts come from range-partitioned prefix
sums, and each quantile's two neighbours are picked with a second partial
aggregate. Memory per task stays bounded for a group holding a third of all rows.
``method="builtin"``: Spark ``percentile`` (one distinct-value map per group;
fine when a group has few distinct values).
``method="approx"``: ``percentile_approx`` with an accuracy knob (not exact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.prefix import running_sums


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
              names: list[str] | None = None, method: str = "rank", accuracy: int = 10000) -> DataFrame:
    """One row per group of ``by`` with one column per probability (null for an
    empty group). Nulls and NaNs are skipped."""
    by = list(by or [])
    names = names or [f"q{i}" for i in range(len(probs))]
    v = F.col(value)
    clean = df.select(*by, v.cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    if method == "builtin":
        arr = F.percentile("__x", F.array(*[F.lit(float(p)) for p in probs]))
        g = clean.groupBy(*by).agg(arr.alias("__q"))
        return g.select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    if method == "approx":
        arr = F.percentile_approx("__x", [float(p) for p in probs], accuracy)
        g = clean.groupBy(*by).agg(arr.alias("__q"))
        return g.select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    if method != "rank":
        raise ValueError(f"unknown method {method!r}")
    counts = clean.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c")).persist()   # read for the sums and for the sizes
    cum = running_sums(counts, by, [F.col("__x")], {"__before": F.col("__c")}, inclusive=False)
    cum = cum.withColumn("__before", F.coalesce("__before", F.lit(0)))
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    j = cum.join(sizes, on=by, how="inner") if by else cum.crossJoin(F.broadcast(sizes))
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        in_lo = (lo >= F.col("__before")) & (lo < F.col("__before") + F.col("__c"))
        in_hi = (hi >= F.col("__before")) & (hi < F.col("__before") + F.col("__c"))
        aggs += [F.max(F.when(in_lo, F.col("__x"))).alias(f"__lo{i}"),
                 F.max(F.when(in_hi, F.col("__x"))).alias(f"__hi{i}"),
                 F.max(pos - lo).alias(f"__f{i}")]
    g = j.groupBy(*by).agg(*aggs)
    return g.select(*by, *[
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(n)
        for i, n in enumerate(names)])


def long_quantiles(df: DataFrame, cols: list[str], probs: list[float], names: list[str] | None = None,
                   by: list[str] | None = None, method: str = "rank") -> DataFrame:
    """Quantiles of several numeric columns in one job: unpivot to (variable, value) first."""
    by = list(by or [])
    sel = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = sel.unpivot(by, cols, "variable", "__value")
    return quantiles(long, "__value", probs, by + ["variable"], names, method)
