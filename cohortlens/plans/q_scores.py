"""Queries: score histogram metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import metrics as M
from cohortlens.plans import sql as S
from cohortlens.plans.base import query
from cohortlens.sources import views

SL = S.with_(S.SCORE, S.SCORES_LONG)

HIST = """, h AS (SELECT model, y_prob AS s, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg
              FROM scores_long WHERE y_prob IS NOT NULL AND NOT isnan(y_prob) GROUP BY model, y_prob),
  cd AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge,
                   sum(neg) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_ge,
                   sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM h)"""

AUC_SQL = """, r AS (SELECT model, y_true, rank() OVER (PARTITION BY model ORDER BY y_prob)
                  + (count(*) OVER (PARTITION BY model, y_prob) - 1) / 2.0 AS ar FROM scores_long),
  auc AS (SELECT model, (sum(CASE WHEN y_true = 1 THEN ar END) - sum(y_true) * (sum(y_true) + 1) / 2.0)
                  / (CAST(sum(y_true) AS DOUBLE) * sum(1 - y_true)) AS roc_auc FROM r GROUP BY model)"""

AP_SQL = """, ap AS (SELECT model, sum(pos / P * tp_ge / (tp_ge + fp_ge)) AS pr_auc,
     sum(pos / P * (tp_ge / (tp_ge + fp_ge) + CASE WHEN tp_ge - pos + fp_ge - neg = 0 THEN 1.0
         ELSE (tp_ge - pos) / (tp_ge - pos + fp_ge - neg) END) / 2.0) AS pr_auc_trapz FROM cd GROUP BY model)"""

ECE_SQL = """, bins AS (SELECT i, i * 0.1 AS lo, CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * 0.1 END AS hi FROM range(10) t(i)),
  nt AS (SELECT model, count(*) AS n FROM scores_long GROUP BY model),
  eb AS (SELECT s.model, b.i, avg(s.y_true) AS acc, avg(s.y_prob) AS conf, count(*) AS nb
         FROM scores_long s JOIN bins b ON s.y_prob >= b.lo AND s.y_prob < b.hi GROUP BY s.model, b.i),
  ece AS (SELECT eb.model, sum(abs(acc - conf) * nb / nt.n) AS ece FROM eb JOIN nt ON eb.model = nt.model GROUP BY eb.model)"""

CONF_SQL = """, cf AS (SELECT model, count_if(y_true = 1 AND y_prob >= 0.5) AS tp, count_if(y_true = 0 AND y_prob >= 0.5) AS fp,
     count_if(y_true = 1 AND y_prob < 0.5) AS fn, count_if(y_true = 0 AND y_prob < 0.5) AS tn,
     avg((y_true - y_prob) * (y_true - y_prob)) AS brier FROM scores_long GROUP BY model)"""

ALL_SQL = SL + HIST + AUC_SQL + AP_SQL + ECE_SQL + CONF_SQL + """
SELECT cf.model, auc.roc_auc, ap.pr_auc, ap.pr_auc_trapz, cf.brier, coalesce(ece.ece, 0.0) AS ece, tp, tn, fp, fn,
       coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS sensitivity
FROM cf JOIN auc ON cf.model = auc.model JOIN ap ON cf.model = ap.model LEFT JOIN ece ON cf.model = ece.model"""


def _metrics(spark, sf_dir):
    return M.metrics(views.scores_long(spark, sf_dir), ["model"])


def _curve(spark, sf_dir):
    h = M.score_histogram(views.scores_long(spark, sf_dir), ["model"])
    return M.curve_table(h, ["model"])


@query("roc_auc", "model:string roc_auc:double", ALL_SQL)
def roc_auc(spark, sf_dir):
    """Exact ROC-AUC (ties one half) per scorer from the distinct-score histogram."""
    return M.auc_ap(_curve(spark, sf_dir), ["model"])


@query("avg_precision", "model:string pr_auc:double", ALL_SQL)
def avg_precision(spark, sf_dir):
    """Average precision (step sum) per scorer."""
    return M.auc_ap(_curve(spark, sf_dir), ["model"])


@query("pr_auc_trapz", "model:string pr_auc_trapz:double", ALL_SQL)
def pr_auc_trapz(spark, sf_dir):
    """Trapezoidal area under the PR curve from (0, 1)."""
    return M.auc_ap(_curve(spark, sf_dir), ["model"])


FIRST_SQL = ALL_SQL.replace("scores_long AS (", "scores_both AS (", 1).replace(
    HIST, ",\n  scores_long AS (SELECT * REPLACE (1 - y_true AS y_true, 1.0::DOUBLE - y_prob AS y_prob) FROM scores_both)" + HIST, 1)


@query("pr_auc_trapz_first", "model:string pr_auc_trapz:double", FIRST_SQL)
def pr_auc_trapz_first(spark, sf_dir):
    """E3 with the first level (label 0) as the event."""
    h = M.score_histogram(views.scores_long(spark, sf_dir), ["model"], event_level="first")
    return M.auc_ap(M.curve_table(h, ["model"]), ["model"])


@query("brier", "model:string brier:double", ALL_SQL)
def brier(spark, sf_dir):
    """Brier score."""
    return _metrics(spark, sf_dir)


@query("ece", "model:string ece:double", ALL_SQL)
def ece(spark, sf_dir):
    """E5: expected calibration error, 10 half-open bins (p = 1 in no bin), weights over all rows."""
    return _metrics(spark, sf_dir)


@query("confusion", "model:string tp:bigint fp:bigint fn:bigint tn:bigint", ALL_SQL)
def confusion(spark, sf_dir):
    """Confusion counts at 0.5."""
    return M.confusion(views.scores_long(spark, sf_dir), ["model"])


@query("metrics_all", "model:string roc_auc:double pr_auc:double brier:double ece:double tp:bigint tn:bigint "
       "fp:bigint fn:bigint precision:double sensitivity:double", ALL_SQL)
def metrics_all(spark, sf_dir):
    """The full metric row per scorer from one histogram pass."""
    return _metrics(spark, sf_dir)


@query("score_hist", "model:string y_true:bigint bin:bigint count:bigint", SL + """,
  r AS (SELECT model, y_true, min(y_prob) AS vmin, max(y_prob) AS vmax FROM scores_long GROUP BY model, y_true)
  SELECT s.model, s.y_true, """ + S.equal_width_bin_sql("s.y_prob", "r.vmin", "r.vmax", 20) + """ AS bin,
         count(*) AS count FROM scores_long s JOIN r ON s.model = r.model AND s.y_true = r.y_true GROUP BY ALL""")
def score_hist(spark, sf_dir):
    """Class-conditional score histograms (20 bins per class)."""
    return M.class_score_histogram(views.scores_long(spark, sf_dir), ["model"])


@query("reliability", "model:string bin:bigint mean_pred:double frac_pos:double n:bigint", SL + """,
  b AS (SELECT *, (y_prob > 0.1)::INT + (y_prob > 0.2)::INT + (y_prob > 0.30000000000000004)::INT + (y_prob > 0.4)::INT
        + (y_prob > 0.5)::INT + (y_prob > 0.6000000000000001)::INT + (y_prob > 0.7000000000000001)::INT
        + (y_prob > 0.8)::INT + (y_prob > 0.9)::INT AS bin FROM scores_long)
  SELECT model, bin, avg(y_prob) AS mean_pred, avg(y_true) AS frac_pos, count(*) AS n FROM b GROUP BY model, bin""")
def reliability(spark, sf_dir):
    """Reliability curve, 10 right-closed bins, empty bins dropped."""
    h = M.score_histogram(views.scores_long(spark, sf_dir), ["model"])
    return M.reliability(h, ["model"])


@query("roc_curve", "model:string threshold:double fpr:double tpr:double", SL + HIST + """
  SELECT model, s AS threshold, fp_ge / N AS fpr, tp_ge / P AS tpr FROM cd""")
def roc_curve(spark, sf_dir):
    """ROC points at every distinct score (prefix sums, no global sort of rows)."""
    return M.roc_points(_curve(spark, sf_dir), ["model"])


@query("pr_curve", "model:string threshold:double precision:double recall:double", SL + HIST + """
  SELECT model, s AS threshold, tp_ge / (tp_ge + fp_ge) AS precision, tp_ge / P AS recall FROM cd""")
def pr_curve(spark, sf_dir):
    """Precision-recall points at every distinct score."""
    return M.pr_points(_curve(spark, sf_dir), ["model"])


# Metrics per (model, group) for the wide/delta/union queries: the generic
# weighted-metric SQL over unit weights.
GRP_SQL = SL + """, sg AS (SELECT model, grp, y_true, y_prob, 1.0::DOUBLE AS w FROM scores_long)""" + \
    S.metrics_sql("sg", ["model", "grp"])
MET_COLS = ["roc_auc", "pr_auc", "brier", "ece", "precision", "sensitivity"]


def _long_metric_sql():
    return GRP_SQL + """,
ml AS (UNPIVOT (SELECT model, grp, """ + ", ".join(MET_COLS) + """ FROM mt) ON """ + ", ".join(MET_COLS) + """
       INTO NAME metric VALUE value)"""


@query("metrics_wide", "model:string metric:string F:double O:double",
       _long_metric_sql() + """
SELECT model, metric, max(CASE WHEN grp = 'F' THEN value END) AS "F", max(CASE WHEN grp = 'O' THEN value END) AS "O"
FROM ml GROUP BY model, metric""")
def metrics_wide(spark, sf_dir):
    """Metrics of every scorer on two row groups, long -> wide (one column per group)."""
    t = M.metrics(views.scores_long(spark, sf_dir), ["model", "grp"])
    long = M.metrics_long(t, ["model", "grp"], MET_COLS)
    return long.groupBy("model", "metric").pivot("grp", ["F", "O"]).agg(F.first("value"))


@query("metric_deltas", "model:string metric:string baseline:double variant:double abs_delta:double rel_delta_pct:double",
       _long_metric_sql() + """
, b AS (SELECT model, metric, value AS baseline FROM ml WHERE grp = 'F'),
  v AS (SELECT model, metric, value AS variant FROM ml WHERE grp = 'O')
SELECT b.model, b.metric, baseline, variant, variant - baseline AS abs_delta,
       (variant - baseline) / nullif(baseline, 0) * 100.0 AS rel_delta_pct
FROM b JOIN v ON b.model = v.model AND b.metric = v.metric""")
def metric_deltas(spark, sf_dir):
    """Baseline (group F) vs variant (group O) metrics aligned by (model, metric)."""
    t = M.metrics(views.scores_long(spark, sf_dir), ["model", "grp"])
    long = M.metrics_long(t, ["model", "grp"], MET_COLS)
    base = long.where(F.col("grp") == "F").drop("grp")
    var = long.where(F.col("grp") == "O").drop("grp")
    return M.metric_deltas(base, var, ["model"])



@query("union_sections", "section:string model:string roc_auc:double pr_auc:double brier:double ece:double "
       "tp:bigint tn:bigint fp:bigint fn:bigint precision:double sensitivity:double",
       GRP_SQL + "\nSELECT grp AS section, * EXCLUDE (grp) FROM mt")
def union_sections(spark, sf_dir):
    """Metric tables computed per section and stacked by column name (bag union)."""
    sl = views.scores_long(spark, sf_dir)
    out = None
    for sec in ["F", "O"]:
        part = M.metrics(sl.where(F.col("grp") == sec), ["model"]).withColumn("section", F.lit(sec))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out



@query("label_score_auc", "label:string roc_auc:double pr_auc:double P:double N:double",
       """WITH j AS (SELECT l.doc_id, l.quality, l.toxic, CAST(d.n_chars AS DOUBLE) AS s
                     FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
  lg AS (SELECT 'quality' AS label, quality AS y, s FROM j WHERE quality IS NOT NULL AND s IS NOT NULL
         UNION ALL SELECT 'toxic', toxic, s FROM j WHERE toxic IS NOT NULL AND s IS NOT NULL),
  r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0 AS ar,
               s FROM lg),
  h AS (SELECT label, s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM lg GROUP BY label, s),
  cd AS (SELECT *, sum(pos) OVER (PARTITION BY label ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge,
                   sum(neg) OVER (PARTITION BY label ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_ge,
                   sum(pos) OVER (PARTITION BY label) AS P FROM h)
SELECT a.label, a.roc_auc, b.pr_auc, a.P, a.N FROM
  (SELECT label, (sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS roc_auc,
          CAST(sum(y) AS DOUBLE) AS P, CAST(sum(1 - y) AS DOUBLE) AS N FROM r GROUP BY label) a
  JOIN (SELECT label, sum(pos / P * tp_ge / (tp_ge + fp_ge)) AS pr_auc FROM cd GROUP BY label) b ON a.label = b.label""")
def label_score_auc(spark, sf_dir):
    """S7/E1/E2 on real labels: labels joined to documents by key, document length as the
    score, AUC and average precision for each label column."""
    from cohortlens.sources.readers import table
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("y_prob"))
    j = lab.join(docs, "doc_id", "inner")
    long = j.unpivot(["doc_id", "y_prob"], ["quality", "toxic"], "label", "y_true")
    h = M.score_histogram(long, ["label"])
    return M.auc_ap(M.curve_table(h, ["label"]), ["label"])



def _stream_transform(df):
    return df.select(
        F.col("l_linestatus").alias("grp"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("y_true"),
        F.explode(F.array(
            F.struct(F.lit("bucketed").alias("model"), (F.col("l_discount") * F.lit(10.0)).alias("p")),
            F.struct(F.lit("continuous").alias("model"), (F.col("l_extendedprice") / F.lit(105000.0)).alias("p")),
        )).alias("s")).select(F.col("s.model").alias("model"), "y_true", F.col("s.p").alias("y_prob"))


@query("stream_metrics", "model:string roc_auc:double pr_auc:double brier:double ece:double tp:bigint tn:bigint "
       "fp:bigint fn:bigint precision:double sensitivity:double", ALL_SQL)
def stream_metrics(spark, sf_dir):
    """E8 over a stream: the scored-item file read with Structured Streaming, the score
    histogram kept as streaming state, metrics computed per micro-batch from it."""
    from cohortlens.sources.readers import table
    from cohortlens.streaming.metrics_stream import metrics_from_stream
    schema = table(spark, sf_dir, "lineitem").schema
    return metrics_from_stream(spark, sf_dir, schema, _stream_transform, ["model"], file_glob="lineitem.parquet")



@query("roc_curve_thinned", "model:string threshold:double fpr:double tpr:double", SL + HIST + """,
  nb AS (SELECT *, lag(fp_ge) OVER w AS fp0, lag(tp_ge) OVER w AS tp0, lead(fp_ge) OVER w AS fp2, lead(tp_ge) OVER w AS tp2,
                row_number() OVER w AS r, count(*) OVER (PARTITION BY model) AS n_pts
         FROM cd WINDOW w AS (PARTITION BY model ORDER BY s DESC))
  SELECT model, s AS threshold, fp_ge / N AS fpr, tp_ge / P AS tpr FROM nb
  WHERE r = 1 OR r = n_pts OR coalesce(fp2 - 2 * fp_ge + fp0 <> 0 OR tp2 - 2 * tp_ge + tp0 <> 0, false)""")
def roc_curve_thinned(spark, sf_dir):
    """ROC points with collinear points dropped (neighbours found by rank joins, no global window)."""
    return M.roc_points_thinned(_curve(spark, sf_dir), ["model"])
