"""Queries: splits, score attachment, entity summaries, ANOVA, subgroup fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import fairness as FA
from cohortlens.operators import features, scorer, split
from cohortlens.operators.scorer import logit_score
from cohortlens.plans import sql as S
from cohortlens.plans.base import query
from cohortlens.plans.common import FAIR_GROUPS, FAIR_THRESHOLD, SCORED_SQL, SEED, SPLIT_SQL, feature_design, scored_panel
from cohortlens.sources import views


@query("entity_split", "id:bigint split:string", S.with_(S.PANEL, SPLIT_SQL) + "SELECT id, split FROM sp")
def entity_split(spark, sf_dir):
    """M1: entity-disjoint 60/20/20 split by a seeded hash order."""
    return split.entity_split(views.panel(spark, sf_dir), "id", 0.4, SEED)


@query("split_rows", "rownames:bigint id:bigint split:string",
       S.with_(S.PANEL, SPLIT_SQL) + "SELECT p.rownames, p.id, sp.split FROM panel p JOIN sp ON p.id = sp.id")
def split_rows(spark, sf_dir):
    """Every visit row with its entity's split (one join, no membership lists)."""
    p = views.panel(spark, sf_dir)
    return split.attach_split(p, split.entity_split(p, "id", 0.4, SEED))


@query("group_folds", "rownames:bigint id:bigint fold:bigint",
       S.with_(S.PANEL) + """SELECT rownames, id,
         CAST('0x' || substr(md5(concat_ws('|', '42', CAST(id AS VARCHAR))), 1, 15) AS BIGINT) % 5 AS fold FROM panel""")
def group_folds(spark, sf_dir):
    """5 entity-grouped folds by hash."""
    return split.group_folds(views.panel(spark, sf_dir), "id", 5, SEED)


_LIGHTEST = "CASE " + " ".join(f"WHEN l{i} = least(l0, l1, l2, l3, l4) THEN {i}" for i in range(5)) + " END"


@query("balanced_folds", "id:bigint n:bigint fold:bigint",
       S.with_(S.PANEL).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
  groups AS (SELECT id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, id) AS r FROM panel WHERE id IS NOT NULL GROUP BY id),
  walk AS (SELECT 0::BIGINT AS r, {", ".join(f"0::BIGINT AS l{i}" for i in range(5))}, NULL::BIGINT AS id, 0::BIGINT AS n, 0 AS fold
           UNION ALL
           SELECT r, {", ".join(f"l{i} + CASE WHEN fold = {i} THEN n ELSE 0 END" for i in range(5))}, id, n, fold
           FROM (SELECT g.r, {", ".join(f"w.l{i}" for i in range(5))}, g.id, g.n, {_LIGHTEST} AS fold FROM walk w JOIN groups g ON g.r = w.r + 1) t)
SELECT id, n, fold FROM walk WHERE r > 0""")
def balanced_folds(spark, sf_dir):
    """5 entity-grouped folds by the greedy rule, largest entities first into the lightest fold."""
    return split.balanced_folds(views.panel(spark, sf_dir), "id", 5)


@query("attach_scores", "rownames:bigint id:bigint split:string y_prob:double",
       SCORED_SQL + "SELECT rownames, id, split, y_prob FROM scored")
def attach_scores(spark, sf_dir):
    """A table of fixed-coefficient scores of the test rows, attached to the panel by row key; null elsewhere."""
    d = feature_design(spark, sf_dir)
    scores = d.where(F.col("split") == "test").select("rownames", logit_score(views.DESIGN_COEFS).alias("y_prob"))
    return scorer.attach_scores(d, scores)


@query("entity_rate", "id:bigint medication:string mean_target:double",
       S.with_(S.PANEL, S.SCALAR) + """SELECT id, medication, avg(target_num) AS mean_target FROM scal
       WHERE target_num IS NOT NULL GROUP BY id, medication""")
def entity_rate(spark, sf_dir):
    """Event rate per (entity, segment)."""
    return FA.entity_rates(features.add_target_numeric(views.panel(spark, sf_dir)), "medication")


@query("group_rate_summary", "medication:string mean:double sd:double n:bigint",
       S.with_(S.PANEL, S.SCALAR) + """, r AS (SELECT id, medication, avg(target_num) AS m FROM scal
       WHERE target_num IS NOT NULL GROUP BY id, medication)
       SELECT medication, avg(m) AS mean, stddev_samp(m) AS sd, count(m) AS n FROM r GROUP BY medication""")
def group_rate_summary(spark, sf_dir):
    """Mean, sd and count of entity rates per segment."""
    r = FA.entity_rates(features.add_target_numeric(views.panel(spark, sf_dir)), "medication")
    return FA.group_rate_summary(r, "medication")


# Upper tail of F(d1, d2) as the integral of the beta density from 0 to d2 / (d2 + d1 f), by Simpson's rule.
F_TAIL_SQL = """(SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * CASE WHEN i = 0 THEN 0 ELSE exp((d2 / 2.0 - 1) * ln(x * i / 20000.0) + (d1 / 2.0 - 1) * ln(1 - x * i / 20000.0)
        - lgamma(d1 / 2.0) - lgamma(d2 / 2.0) + lgamma((d1 + d2) / 2.0)) END) * x / 60000.0 FROM range(20001) r(i))"""


@query("anova_oneway", "term:string df:bigint sum_sq:double mean_sq:double f_value:double p_value:double",
       S.with_(S.PANEL, S.SCALAR) + """, r AS (SELECT id, medication, avg(target_num) AS m FROM scal
       WHERE target_num IS NOT NULL GROUP BY id, medication),
       g AS (SELECT medication, count(m) AS n, avg(m) AS mm, var_pop(m) * count(m) AS ss FROM r GROUP BY medication),
       t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * mm) / sum(n) AS grand FROM g),
       s AS (SELECT sum(g.n * (g.mm - t.grand) * (g.mm - t.grand)) AS ssb, sum(g.ss) AS ssw, max(t.nn) AS nn, max(t.k) AS k FROM g, t)
       , f AS (SELECT *, (ssb / (k - 1)) / (ssw / (nn - k)) AS f, CAST(k - 1 AS DOUBLE) AS d1, CAST(nn - k AS DOUBLE) AS d2 FROM s),
       x AS (SELECT *, d2 / (d2 + d1 * f) AS x FROM f)
       SELECT 'medication' AS term, k - 1 AS df, ssb AS sum_sq, ssb / (k - 1) AS mean_sq, f AS f_value, """ + F_TAIL_SQL + """ AS p_value FROM x
       UNION ALL SELECT 'Residuals', nn - k, ssw, ssw / (nn - k), NULL, NULL FROM s""")
def anova_oneway(spark, sf_dir):
    """one-way ANOVA of entity event rates across segments (p-value from the F tail)."""
    r = FA.entity_rates(features.add_target_numeric(views.panel(spark, sf_dir)), "medication")
    return FA.anova_oneway(r, "medication").withColumn(
        "term", F.when(F.col("term") == "Residuals", "Residuals").otherwise(F.lit("medication")))


FAIR_COLS = ("variable:string level:string AUC:double Sensitivity:double Specificity:double n:bigint n_pos:bigint "
             "n_neg:bigint n_scored:bigint valid_auc:boolean valid_sens:boolean valid_spec:boolean")


def _fair_sql(where: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{g}' AS variable, CAST({g} AS VARCHAR) AS level, id, target_num, y_prob FROM fin" for g in FAIR_GROUPS)
    t = FAIR_THRESHOLD
    return SCORED_SQL + f""",
  fin AS (SELECT * FROM scored WHERE target_num IS NOT NULL {where}),
  lg AS ({long}),
  ent AS (SELECT variable, level, id, max(target_num) AS y_true,
                 CASE WHEN count(y_prob) = count(*) THEN avg(y_prob) END AS y_pred FROM lg GROUP BY variable, level, id),
  fcnt AS (SELECT variable, level, count(*) AS n, count_if(y_true = 1) AS n_pos, count_if(y_true = 0) AS n_neg,
                 count(y_pred) AS n_scored, count_if(y_true = 1 AND y_pred IS NULL) AS pm,
                 count_if(y_true = 0 AND y_pred IS NULL) AS nm, count_if(y_true = 1 AND y_pred >= {t}) AS tp,
                 count_if(y_true = 0 AND y_pred < {t}) AS tn FROM ent GROUP BY variable, level),
  sc AS (SELECT * FROM ent WHERE y_pred IS NOT NULL),
  frk AS (SELECT variable, level, y_true, rank() OVER (PARTITION BY variable, level ORDER BY y_pred)
            + (count(*) OVER (PARTITION BY variable, level, y_pred) - 1) / 2.0 AS ar FROM sc),
  auc AS (SELECT variable, level, (sum(CASE WHEN y_true = 1 THEN ar END) - sum(y_true) * (sum(y_true) + 1) / 2.0)
            / nullif(CAST(sum(y_true) AS DOUBLE) * sum(1 - y_true), 0) AS auc FROM frk GROUP BY variable, level),
  med AS (SELECT variable, level, quantile_cont(CASE WHEN y_true = 0 THEN y_pred END, 0.5) AS mc,
                 quantile_cont(CASE WHEN y_true = 1 THEN y_pred END, 0.5) AS mk FROM sc GROUP BY variable, level),
  fair AS (SELECT c.variable, c.level,
       CASE WHEN n_pos > 0 AND n_neg > 0 THEN CASE WHEN m.mc > m.mk THEN 1 - a.auc ELSE a.auc END END AS AUC,
       CASE WHEN n_pos > 0 AND pm = 0 THEN tp / n_pos END AS Sensitivity,
       CASE WHEN n_neg > 0 AND nm = 0 THEN tn / n_neg END AS Specificity,
       n, n_pos, n_neg, n_scored, n_pos > 0 AND n_neg > 0 AS valid_auc, n_pos > 0 AS valid_sens, n_neg > 0 AS valid_spec
     FROM fcnt c LEFT JOIN auc a ON c.variable = a.variable AND c.level = a.level
     LEFT JOIN med m ON c.variable = m.variable AND c.level = m.level)
"""


def _fair_input(spark, sf_dir, scored_only: bool):
    d = scored_panel(spark, sf_dir).where(F.col("target_num").isNotNull())
    if scored_only:
        d = d.where(F.col("y_prob").isNotNull())
    return d


@query("fairness_all", FAIR_COLS, _fair_sql("") + "SELECT * FROM fair")
def fairness_all(spark, sf_dir):
    """subgroup AUC/sensitivity/specificity over all entities (reference rule:
    unscored entities make sensitivity/specificity missing)."""
    return FA.fairness_metrics(_fair_input(spark, sf_dir, False), FAIR_GROUPS, FAIR_THRESHOLD)


@query("fairness_metrics", FAIR_COLS, _fair_sql("AND y_prob IS NOT NULL") + "SELECT * FROM fair")
def fairness_metrics(spark, sf_dir):
    """Subgroup metrics over scored rows (entity collapse, then thresholded means)."""
    return FA.fairness_metrics(_fair_input(spark, sf_dir, True), FAIR_GROUPS, FAIR_THRESHOLD)


@query("fairness_valid", FAIR_COLS, _fair_sql("AND y_prob IS NOT NULL")
       + "SELECT * FROM fair WHERE valid_auc AND valid_sens AND valid_spec")
def fairness_valid(spark, sf_dir):
    """levels where AUC, sensitivity and specificity are all estimable."""
    return FA.valid_only(FA.fairness_metrics(_fair_input(spark, sf_dir, True), FAIR_GROUPS, FAIR_THRESHOLD))


@query("fairness_long", "variable:string level:string term:string OR:double CI_low:double CI_high:double label:string",
       _fair_sql("AND y_prob IS NOT NULL") + """, fl AS (UNPIVOT (SELECT variable, level, AUC, Sensitivity, Specificity FROM fair)
       ON AUC, Sensitivity, Specificity INTO NAME term VALUE "OR")
       SELECT variable, level, term, "OR", "OR" AS CI_low, "OR" AS CI_high,
              variable || ': ' || level || ' — ' || term AS label FROM fl""")
def fairness_long(spark, sf_dir):
    """Long metric table with CI = point and a display label."""
    return FA.fairness_long(FA.fairness_metrics(_fair_input(spark, sf_dir, True), FAIR_GROUPS, FAIR_THRESHOLD))


def _entry_c_sql() -> str:
    from cohortlens.plans.q_thresholds import GRID_SQL
    grid_rest = GRID_SQL[len(S.with_(S.SCORE, S.SCORES_LONG)):]
    fair = _fair_sql("AND y_prob IS NOT NULL")
    fair_rest = fair[len(SCORED_SQL):]
    fair_rest = fair_rest.replace(f"y_pred >= {FAIR_THRESHOLD}", "y_pred >= (SELECT threshold FROM bt)") \
                         .replace(f"y_pred < {FAIR_THRESHOLD}", "y_pred < (SELECT threshold FROM bt)")
    return (SCORED_SQL + """,
  scores_long AS (SELECT 'valid' AS model, 'v' AS grp, CAST(target_num AS INTEGER) AS y_true, """ + S.LOGIT_EXPR + """ AS y_prob
                  FROM design WHERE split = 'valid' AND target_num IS NOT NULL)""" + grid_rest + """,
  bt AS (SELECT threshold FROM ranked WHERE rank = 1)""" + fair_rest + "\nSELECT fair.*, bt.threshold FROM fair, bt")


@query("threshold_fairness", FAIR_COLS + " threshold:double", _entry_c_sql())
def threshold_fairness(spark, sf_dir):
    """Entry C: the decision threshold is optimised on the validation split (10 x 10 cost
    grid, sensitivity >= 0.8, best pair) and subgroup fairness is reported on the test
    split at that threshold. Only the chosen threshold (one number) reaches the driver."""
    from cohortlens.operators import threshold as H
    from cohortlens.operators.scorer import logit_score
    from cohortlens.plans.common import feature_design
    d = feature_design(spark, sf_dir).withColumn("__score", logit_score(views.DESIGN_COEFS))
    val = d.where((F.col("split") == "valid") & F.col("target_num").isNotNull()) \
           .select(F.col("target_num").alias("y_true"), F.col("__score").alias("y_prob"))
    best = H.best_threshold(H.optimize_grid(H.threshold_curve(val))).first()["threshold"]
    test = d.where((F.col("split") == "test") & F.col("target_num").isNotNull()).withColumn("y_prob", F.col("__score"))
    return FA.fairness_metrics(test, FAIR_GROUPS, best).withColumn("threshold", F.lit(float(best)))
