"""Scoring with given coefficients (M15) and score attachment.

A linear-logistic scorer is one Column expression: it stays inside whole-stage
codegen and makes every explanation operator a pure DataFrame job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_predictor(coefs: dict[str, float], intercept_key: str = "intercept") -> Column:
    eta = F.lit(float(coefs.get(intercept_key, 0.0)))
    for name, b in coefs.items():
        if name == intercept_key:
            continue
        eta = eta + F.lit(float(b)) * F.col(name)
    return eta


def logit_score(coefs: dict[str, float], intercept_key: str = "intercept") -> Column:
    """p = 1 / (1 + exp(-(b0 + sum_j b_j x_j)))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_predictor(coefs, intercept_key)))


def attach_scores(panel: DataFrame, scores: DataFrame, key: str = "rownames", score_col: str = "y_prob") -> DataFrame:
    """Keyed left join; rows without a score get null (never positional)."""
    return panel.join(scores.select(key, score_col), key, "left")
