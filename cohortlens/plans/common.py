"""Shared plan fragments: the scored feature panel used by fairness, models and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import features, split
from cohortlens.operators.scorer import logit_score
from cohortlens.plans import sql as S
from cohortlens.sources import views

SEED = 42
FAIR_THRESHOLD = 0.5
FAIR_GROUPS = ["sex", "hatype", "study_season"]


def feature_design(spark, sf_dir) -> DataFrame:
    """Feature panel + design columns + entity split."""
    panel = views.panel(spark, sf_dir)
    d = views.design_columns(features.build_feature_panel(panel))
    # the split needs entity ids only: derive it from the raw panel, not the windowed frame
    return split.attach_split(d, split.entity_split(panel, "id", 0.4, SEED))


def scored_panel(spark, sf_dir) -> DataFrame:
    """Feature design with the fixed scorer's probability on test rows (null elsewhere)."""
    d = feature_design(spark, sf_dir)
    return d.withColumn("y_prob", F.when(F.col("split") == "test", logit_score(views.DESIGN_COEFS)))


SPLIT_SQL = """ids AS (SELECT DISTINCT id FROM panel WHERE id IS NOT NULL),
  rk AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(id AS VARCHAR))), id) AS r,
                count(*) OVER () AS n FROM ids),
  rk2 AS (SELECT *, n - ceil(0.4::DOUBLE * n) AS n_train, ceil(0.4::DOUBLE * n) - ceil(0.5::DOUBLE * ceil(0.4::DOUBLE * n)) AS n_valid FROM rk),
  sp AS (SELECT id, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_valid THEN 'valid' ELSE 'test' END AS split FROM rk2)"""

SCORED_SQL = S.with_(S.PANEL, S.SCALAR, S.FEAT, SPLIT_SQL) + """,
  design AS (SELECT f.*, sp.split,
    (airq - 250000.0) / 150000.0 AS z_airq, (CAST(dos AS DOUBLE) - 1200.0) / 700.0 AS z_dos,
    CAST(medication = 'BUILDING' AS DOUBLE) AS d_BUILDING, CAST(medication = 'MACHINERY' AS DOUBLE) AS d_MACHINERY,
    CAST(medication = 'FURNITURE' AS DOUBLE) AS d_FURNITURE, CAST(medication = 'HOUSEHOLD' AS DOUBLE) AS d_HOUSEHOLD
    FROM feat f JOIN sp ON f.id = sp.id),
  scored AS (SELECT *, CASE WHEN split = 'test' THEN """ + S.LOGIT_EXPR + """ END AS y_prob FROM design)"""
