"""Queries: logistic GLMs with cluster-robust inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import clean, features, glm, profile
from cohortlens.plans import sql as S
from cohortlens.plans.base import query
from cohortlens.plans.common import scored_panel
from cohortlens.sources import views

AGE_LEVELS = ["18-30", "31-40", "41-50", "51-66"]
SEX_LEVELS = ["female", "male"]
PHASE_LEVELS = ["No treatment", "Under treatment"]
COEF_COLS = "term:string estimate:double se:double z:double p_value:double OR:double CI_low:double CI_high:double"


def _fit(df, factors, numerics, y="target_num", firth=False, vcov="hc0", cluster="id"):
    keep = [c for c, _ in factors] + list(numerics) + [y, cluster]
    # Complete cases of the model columns, kept for the level lookups, every IRLS pass and the errors
    d = clean.drop_na(df.select(*keep), keep).persist()
    dm, xnames, terms = glm.treatment_design(d, factors, numerics)
    fit = glm.fit_logistic(dm, xnames, terms, y, firth=firth)
    if vcov == "hc0":
        V = glm.vcov_cluster_hc0(dm, fit, xnames, y, cluster)
    elif vcov == "cr2":
        V = glm.vcov_cluster_cr2(dm, fit, xnames, y, cluster)
    else:
        V = None
    d.unpersist()
    return glm.coef_table(df.sparkSession, fit, V)


# Two-sided normal tail beyond |estimate / se|, by Simpson's rule over twelve standard deviations.
NORMAL_TAIL_SQL = """(SELECT 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(-0.5 * power(abs(estimate / se) + i * 0.003, 2)) / sqrt(2 * pi())) * 0.003 / 3 FROM range(4001) r(i))"""

SINGLE_SQL = S.with_(S.PANEL, S.SCALAR) + """,
  d AS (SELECT id, hatype, CAST(target_num AS DOUBLE) AS y FROM scal WHERE target_num IS NOT NULL AND hatype IS NOT NULL),
  g AS (SELECT hatype, avg(y) AS p, count(*) AS n FROM d GROUP BY hatype),
  b AS (SELECT hatype AS base, p AS p0 FROM g ORDER BY hatype LIMIT 1),
  inf AS (SELECT d.id, d.hatype, (d.y - g.p) / (g.n * g.p * (1 - g.p)) AS f FROM d JOIN g ON d.hatype = g.hatype),
  cs AS (SELECT id, hatype, sum(f) AS sf FROM inf GROUP BY id, hatype),
  per AS (SELECT c.id, g.hatype AS lvl, sum(CASE WHEN c.hatype = g.hatype THEN c.sf ELSE 0 END) AS sk,
                 sum(CASE WHEN c.hatype = b.base THEN c.sf ELSE 0 END) AS s0
          FROM cs c, g, b GROUP BY c.id, g.hatype),
  nc AS (SELECT count(DISTINCT id) AS nclus FROM d),
  v AS (SELECT lvl, sum((sk - s0) * (sk - s0)) AS vk, sum(s0 * s0) AS v0 FROM per GROUP BY lvl),
  est AS (SELECT '(Intercept)' AS term, ln(b.p0 / (1 - b.p0)) AS estimate,
                 sqrt((SELECT max(v0) FROM v) * nc.nclus / (nc.nclus - 1)) AS se FROM b, nc
          UNION ALL
          SELECT 'hatype' || g.hatype, ln(g.p / (1 - g.p)) - ln(b.p0 / (1 - b.p0)), sqrt(v.vk * nc.nclus / (nc.nclus - 1))
          FROM g JOIN v ON g.hatype = v.lvl, b, nc WHERE g.hatype <> b.base)
SELECT term, estimate, se, estimate / se AS z, """ + NORMAL_TAIL_SQL + """ AS p_value, exp(estimate) AS "OR", exp(estimate - 1.96 * se) AS CI_low,
       exp(estimate + 1.96 * se) AS CI_high FROM est"""


@query("or_single_factor", "term:string estimate:double se:double z:double p_value:double OR:double CI_low:double CI_high:double", SINGLE_SQL)
def or_single_factor(spark, sf_dir):
    """Logistic GLM (IRLS) of the event on subtype, cluster-robust HC0
    errors by entity; checked against the closed form of the saturated model."""
    df = features.add_target_numeric(views.panel(spark, sf_dir))
    return _fit(df, [("hatype", None)], [])


@query("or_table", "term:string OR:double CI_low:double CI_high:double p_value:double",
       "SELECT term, \"OR\", CI_low, CI_high, p_value FROM (" + SINGLE_SQL + ") WHERE term <> '(Intercept)'")
def or_table(spark, sf_dir):
    """Odds-ratio table of the subtype model, without the intercept."""
    df = features.add_target_numeric(views.panel(spark, sf_dir))
    return glm.or_table(_fit(df, [("hatype", None)], []))


def _test_rows(spark, sf_dir):
    return scored_panel(spark, sf_dir).where(F.col("y_prob").isNotNull() & ~F.isnan("y_prob"))


TREAT_FACTORS = [("phase", PHASE_LEVELS), ("sex", SEX_LEVELS), ("age_band", None), ("medication", None)]


@query("glm_fit", COEF_COLS)
def glm_fit(spark, sf_dir):
    """Plain logistic GLM refit on the scored test rows (model-based errors;
    aliased columns come back with null estimates)."""
    return _fit(_test_rows(spark, sf_dir), TREAT_FACTORS, ["prev_attacks"], vcov="model")


@query("treatment_or", COEF_COLS)
def treatment_or(spark, sf_dir):
    """Bias-reduced (Firth) logistic model of the event on phase, sex, age band,
    segment and prior events over scored rows; CR2 cluster-robust errors by entity."""
    return _fit(_test_rows(spark, sf_dir), TREAT_FACTORS, ["prev_attacks"], firth=True, vcov="cr2")


SUBTYPE_FACTORS = [("hatype", None), ("sex", SEX_LEVELS), ("age_band", AGE_LEVELS)]


@query("subtype_or", COEF_COLS)
def subtype_or(spark, sf_dir):
    """Subtype effect adjusted for sex, age band and prior events; HC0 by entity."""
    return _fit(_test_rows(spark, sf_dir), SUBTYPE_FACTORS, ["prev_attacks"])


@query("subtype_models", "model:string " + COEF_COLS)
def subtype_models(spark, sf_dir):
    """Unadjusted vs adjusted subtype models stacked, subtype terms only."""
    d = _test_rows(spark, sf_dir)
    m1 = _fit(d, [("hatype", None)], []).withColumn("model", F.lit("unadjusted"))
    m2 = _fit(d, SUBTYPE_FACTORS, ["prev_attacks"]).withColumn("model", F.lit("adjusted"))
    return m1.unionByName(m2).where(F.col("term").startswith("hatype"))


@query("environment_or", COEF_COLS)
def environment_or(spark, sf_dir):
    """exposure-quartile effect (type-7 quartile bands over all rows) adjusted for
    sex, age band and prior events; all rows with an outcome; HC0 by entity."""
    fp = features.build_feature_panel(views.panel(spark, sf_dir))
    fp = profile.quartile_band(fp, "airq", "airq_quartile")
    return _fit(fp, [("airq_quartile", profile.QUARTILE_LABELS), ("sex", SEX_LEVELS), ("age_band", AGE_LEVELS)],
                ["prev_attacks"])
