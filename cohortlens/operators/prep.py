"""Preprocessing fitted on the training split.

Fitting collects only per-column parameters (medians, means, sds, modes,
level lists: size = number of features/levels). The fitted transform is
emitted as standard, persistable Spark ML stages - a ``SQLTransformer`` with
plain column expressions and a ``VectorAssembler`` - so it runs in whole-stage
codegen and saves/loads inside a ``PipelineModel``.

Conventions kept from the reference: numeric median imputation then
standardisation with the population sd of the imputed column; categorical
most-frequent imputation (ties -> smallest value), one-hot over the sorted
training levels with every level kept and unseen levels -> all zeros. Names
are ``num__<col>`` and ``cat__<col>_<level>`` (non-alphanumerics -> ``_``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.quantile import long_quantiles


def safe_name(s: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", str(s))


@dataclass
class PrepParams:
    num: list[str]
    cat: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    sds: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        return [f"num__{c}" for c in self.num] + [
            f"cat__{c}_{safe_name(lv)}" for c in self.cat for lv in self.levels[c]]


def fit_preprocessor(train: DataFrame, num: list[str], cat: list[str], quantile_method: str = "rank") -> PrepParams:
    """M2/M3 fit: three small aggregate jobs over the training rows."""
    p = PrepParams(list(num), list(cat))
    if num:
        med = {r["variable"]: r["q0"] for r in long_quantiles(train, list(num), [0.5], ["q0"], method=quantile_method).collect()}
        p.medians = {c: (float(med[c]) if med.get(c) is not None else 0.0) for c in num}
        imp = [F.coalesce(F.col(c).cast("double"), F.lit(p.medians[c])) for c in num]
        row = train.agg(*[F.avg(e).alias(f"m_{i}") for i, e in enumerate(imp)],
                        *[F.stddev_pop(e).alias(f"s_{i}") for i, e in enumerate(imp)]).first()
        for i, c in enumerate(num):
            p.means[c] = float(row[f"m_{i}"] or 0.0)
            sd = row[f"s_{i}"]
            p.sds[c] = float(sd) if sd else 1.0   # constant column: scale 1, as a zero sd would
    if cat:
        long = train.select(*[F.col(c).cast("string").alias(c) for c in cat]).unpivot([], list(cat), "variable", "level")
        counts = long.where(F.col("level").isNotNull()).groupBy("variable", "level").count().collect()  # levels only
        for c in cat:
            lv = sorted((r["level"], r["count"]) for r in counts if r["variable"] == c)
            p.levels[c] = [x for x, _ in lv]
            if lv:
                top = max(n for _, n in lv)
                p.modes[c] = min(x for x, n in lv if n == top)
    return p


def _sql_str(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def transform_sql(p: PrepParams) -> str:
    exprs = []
    for c in p.num:
        exprs.append(f"(coalesce(CAST(`{c}` AS DOUBLE), {p.medians[c]!r}D) - {p.means[c]!r}D) / {p.sds[c]!r}D AS `num__{c}`")
    for c in p.cat:
        imp = f"coalesce(CAST(`{c}` AS STRING), {_sql_str(p.modes[c])})" if c in p.modes else f"CAST(`{c}` AS STRING)"
        for lv in p.levels[c]:
            exprs.append(f"CAST({imp} = {_sql_str(lv)} AS DOUBLE) AS `cat__{c}_{safe_name(lv)}`")
    return "SELECT *, " + ", ".join(exprs) + " FROM __THIS__"


def preprocessor_model(p: PrepParams, out: str = "features") -> PipelineModel:
    """M4: the fitted preprocessor as Spark ML stages (persistable)."""
    return PipelineModel(stages=[SQLTransformer(statement=transform_sql(p)),
                                 VectorAssembler(inputCols=p.feature_names(), outputCol=out, handleInvalid="keep")])


def transform(df: DataFrame, p: PrepParams) -> DataFrame:
    """Apply the fitted preprocessing as expressions (wide columns, no vector)."""
    return SQLTransformer(statement=transform_sql(p)).transform(df)


def attribute_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of a vector's places, from the attributes that the assembler left in the column's metadata."""
    attrs = df.schema[features].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])]


def with_names(df: DataFrame, p: PrepParams, features: str = "features") -> DataFrame:
    """A feature vector back to named columns, by its attributes."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(features))
    names = attribute_names(df, features)
    base = df.drop(*[n for n in names if n in df.columns])
    return base.select("*", *[arr[i].alias(n) for i, n in enumerate(names)])
