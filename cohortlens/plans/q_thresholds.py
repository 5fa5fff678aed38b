"""Queries: threshold curve and cost grid (H1-H4, O2, O3), bootstrap (B1, B2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import bootstrap as B
from cohortlens.operators import metrics as M
from cohortlens.operators import threshold as H
from cohortlens.plans import sql as S
from cohortlens.plans.base import query
from cohortlens.sources import views

CURVE_COLS = ("threshold:double TP:bigint FP:bigint FN:bigint TN:bigint Mean_alerts:double Sens:double Spec:double "
              "Precision:double F1:double Youden:double")

CURVE_SQL = S.with_(S.SCORE, S.SCORES_LONG) + """,
  thr AS (SELECT k, CASE WHEN k = 1000 THEN 1.0::DOUBLE ELSE k * 0.001::DOUBLE END AS threshold FROM range(1001) t(k)),
  hh AS (SELECT model, y_prob AS s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM scores_long GROUP BY model, y_prob),
  cnt AS (SELECT h.model, t.k, t.threshold,
            sum(CASE WHEN h.s >= t.threshold THEN pos ELSE 0 END) AS TP, sum(CASE WHEN h.s >= t.threshold THEN neg ELSE 0 END) AS FP,
            sum(CASE WHEN h.s < t.threshold THEN pos ELSE 0 END) AS FN, sum(CASE WHEN h.s < t.threshold THEN neg ELSE 0 END) AS TN
          FROM hh h CROSS JOIN thr t GROUP BY h.model, t.k, t.threshold),
  cur AS (SELECT *, (TP + FP) / (TP + FP + FN + TN) AS Mean_alerts,
            coalesce(TP / nullif(TP + FN, 0), 0.0) AS Sens, coalesce(TN / nullif(TN + FP, 0), 0.0) AS Spec,
            coalesce(TP / nullif(TP + FP, 0), 0.0) AS Precision, coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0.0) AS F1,
            coalesce(TP / nullif(TP + FN, 0), 0.0) + coalesce(TN / nullif(TN + FP, 0), 0.0) - 1 AS Youden FROM cnt)"""

GRID_SQL = CURVE_SQL + """,
  costs AS (SELECT (a - 1) * 10 + (b - 1) AS pair_order, a AS C_FP, b AS C_FN FROM range(1, 11) x(a), range(1, 11) y(b)),
  x AS (SELECT c.*, p.pair_order, p.C_FP, p.C_FN, p.C_FN * c.FN + p.C_FP * c.FP AS Cost, c.Sens >= 0.8 AS feas
        FROM cur c CROSS JOIN costs p),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, C_FP, C_FN ORDER BY feas DESC,
             CASE WHEN feas THEN Cost END ASC NULLS LAST, CASE WHEN NOT feas THEN Sens END DESC NULLS LAST,
             Youden DESC, k ASC) AS rn FROM x) t WHERE rn = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY Cost ASC, Youden DESC, pair_order ASC) AS rank FROM best)"""

GRID_COLS = "model:string C_FP:bigint C_FN:bigint Cost:bigint rank:bigint " + CURVE_COLS


def _curve(spark, sf_dir):
    return H.threshold_curve(views.scores_long(spark, sf_dir), ["model"])


@query("threshold_curve", "model:string k:bigint " + CURVE_COLS + " Cost:bigint",
       CURVE_SQL + "\nSELECT *, 1 * FN + 1 * FP AS Cost FROM cur")
def threshold_curve(spark, sf_dir):
    """H1/H2/H6: counts, rates, alert rate and cost (C_FP = C_FN = 1) at 1001 thresholds,
    from one bucketed pass over the scores."""
    return H.with_cost(_curve(spark, sf_dir), 1, 1)


@query("threshold_grid", GRID_COLS, GRID_SQL + "\nSELECT * FROM ranked")
def threshold_grid(spark, sf_dir):
    """H3/H4/O2: best threshold for each of the 10 x 10 cost pairs, ranked."""
    return H.optimize_grid(_curve(spark, sf_dir), ["model"])


@query("best_threshold", GRID_COLS, GRID_SQL + "\nSELECT * FROM ranked WHERE rank = 1")
def best_threshold(spark, sf_dir):
    """O3: the globally best (cost pair, threshold) per scorer."""
    return H.best_threshold(H.optimize_grid(_curve(spark, sf_dir), ["model"]))


ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "id", "price_cents"]
N_BOOT = 1000
SEED = 42


def _boot_input(spark, sf_dir):
    s = views.score(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "id",
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"),
                    F.lit("bucketed").alias("model"), "y_true", "y_prob")


BOOT_SQL = S.with_(S.SCORE) + f""",
  b0 AS (SELECT 'bucketed' AS model, y_true, y_prob,
           CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                CAST(l_partkey AS VARCHAR), CAST(id AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))), 1, 15) AS BIGINT) AS h
         FROM score),
  b1 AS (SELECT model, y_true, y_prob, r.rep, h, xor(h & 2147483647, (r.rep * 2654435761) & 2147483647) AS x0 FROM b0, range({N_BOOT}) r(rep)),
  b2 AS (SELECT model, y_true, y_prob, rep, xor({S.mix31_sql('x0')}, h >> 31) AS x1 FROM b1),
  b3 AS (SELECT model, y_true, y_prob, rep, {S.mix31_sql('x1')} / 2147483648.0 AS u FROM b2),
  b4 AS (SELECT model, y_true, y_prob, rep, """ + " + ".join(
    f"CAST(u >= {c!r} AS INTEGER)" for c in B.poisson1_cdf()[:-1]) + """ AS wt FROM b3),
  bw AS (SELECT model, rep, y_true, y_prob, CAST(sum(wt) AS DOUBLE) AS w FROM b4 WHERE wt > 0 GROUP BY model, rep, y_true, y_prob)"""

BOOT_COLS = ("model:string rep:bigint roc_auc:double pr_auc:double brier:double ece:double tp:bigint tn:bigint "
             "fp:bigint fn:bigint precision:double sensitivity:double")


@query("bootstrap_metrics", BOOT_COLS, BOOT_SQL + S.metrics_sql("bw", ["model", "rep"]) + "\nSELECT * FROM mt")
def bootstrap_metrics(spark, sf_dir):
    """B1: 1000 Poisson-bootstrap replicates of all ten metrics (hash-seeded, partition-independent)."""
    return B.bootstrap_metrics(_boot_input(spark, sf_dir), ROW_KEY, ["model"], n_boot=N_BOOT, seed=SEED)


@query("bootstrap_summary", "model:string metric:string mean:double std:double ci95_low:double ci95_high:double point:double",
       BOOT_SQL + S.metrics_sql("bw", ["model", "rep"]) + """,
  reps AS (SELECT * FROM mt),
  pw AS (SELECT model, y_true, y_prob, 1.0::DOUBLE AS w FROM (SELECT 'bucketed' AS model, y_true, y_prob FROM score) t)"""
       + S.metrics_sql("pw", ["model"], prefix="p") + """,
  rl AS (UNPIVOT (SELECT model, rep, roc_auc, pr_auc, brier, ece, CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn,
                  CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, precision, sensitivity FROM reps)
         ON roc_auc, pr_auc, brier, ece, tp, tn, fp, fn, precision, sensitivity INTO NAME metric VALUE value),
  pl AS (UNPIVOT (SELECT model, roc_auc, pr_auc, brier, ece, CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn,
                  CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, precision, sensitivity FROM pt)
         ON roc_auc, pr_auc, brier, ece, tp, tn, fp, fn, precision, sensitivity INTO NAME metric VALUE point)
SELECT r.model, r.metric, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.025) AS ci95_low,
       quantile_cont(value, 0.975) AS ci95_high, max(p.point) AS point
FROM rl r LEFT JOIN pl p ON r.model = p.model AND r.metric = p.metric GROUP BY r.model, r.metric""")
def bootstrap_summary(spark, sf_dir):
    """B2: mean, sd, 95% percentile interval and point estimate per metric."""
    d = _boot_input(spark, sf_dir)
    reps = B.bootstrap_metrics(d, ROW_KEY, ["model"], n_boot=N_BOOT, seed=SEED)
    point = M.metrics(d, ["model"])
    return B.bootstrap_summary(reps, point, ["model"])


@query("bootstrap_multinomial", BOOT_COLS)
def bootstrap_multinomial(spark, sf_dir):
    """B1(a): 1000 exact iid row resamples (multinomial over label/score cells), all ten metrics."""
    return B.bootstrap_metrics_multinomial(_boot_input(spark, sf_dir), ["model"], n_boot=N_BOOT, seed=SEED)


def _cont_input(spark, sf_dir):
    return views.score(spark, sf_dir).select(F.lit("continuous").alias("model"), "y_true", F.col("y_cont").alias("y_prob"))


@query("bootstrap_continuous", BOOT_COLS)
def bootstrap_continuous(spark, sf_dir):
    """B1(a) on the continuous score: 1000 exact row resamples over nearly as many scores as rows, all ten metrics."""
    return B.bootstrap_metrics_multinomial(_cont_input(spark, sf_dir), ["model"], n_boot=N_BOOT, seed=SEED)


@query("bootstrap_rows_kept", "model:string rep:bigint n:bigint", S.with_(S.SCORE) + f"""
SELECT 'bucketed' AS model, r.rep, (SELECT count(*) FROM score) AS n FROM range({N_BOOT}) r(rep)""")
def bootstrap_rows_kept(spark, sf_dir):
    """B1(a): every replicate draws as many rows as there are."""
    h = B.multinomial_histogram(_boot_input(spark, sf_dir), ["model"], n_boot=N_BOOT, seed=SEED)
    return h.groupBy("model", "rep").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))


BOOT_ENTITY_SQL = BOOT_SQL.replace(
    """concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                CAST(l_partkey AS VARCHAR), CAST(id AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))""",
    "concat_ws('|', '42', CAST(id AS VARCHAR))")


@query("bootstrap_entity", BOOT_COLS, BOOT_ENTITY_SQL + S.metrics_sql("bw", ["model", "rep"]) + "\nSELECT * FROM mt")
def bootstrap_entity(spark, sf_dir):
    """B1 (entity unit): Poisson cluster bootstrap - every row of an entity shares the
    replicate weight drawn from (seed, entity id, replicate)."""
    return B.bootstrap_metrics(_boot_input(spark, sf_dir), ["id"], ["model"], n_boot=N_BOOT, seed=SEED)
