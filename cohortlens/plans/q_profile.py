"""Queries: profiling aggregates."""

from __future__ import annotations


from cohortlens.operators import features, profile
from cohortlens.plans import sql as S
from cohortlens.plans.base import query
from cohortlens.sources import views

NUMERIC = ["rownames", "id", "time", "dos", "age", "airq"]
CATEGORICAL = ["hatype", "medication", "headache", "sex"]
# Fixed value: season display order.
SEASON_ORDER = ["winter", "spring", "summer", "autumn"]


def _long_sql(cols, src, cast="DOUBLE"):
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS {cast}) AS value FROM {src}" for c in cols)


@query("cat_freq", "variable:string category:string frequency:bigint percentage:double",
       S.with_(S.PANEL) + f""", long AS ({_long_sql(CATEGORICAL, 'panel', 'VARCHAR')}),
       g AS (SELECT variable, value AS category, count(*) AS frequency FROM long GROUP BY variable, value)
       SELECT variable, category, frequency,
              round_even(frequency / sum(frequency) OVER (PARTITION BY variable) * 100.0, 2) AS percentage FROM g""")
def cat_freq(spark, sf_dir):
    """A1: categorical frequencies with percentages, nulls kept."""
    return profile.categorical_frequencies(views.panel(spark, sf_dir), CATEGORICAL)


@query("prevalence", "headache:string n:bigint percentage:double",
       S.with_(S.PANEL) + """, g AS (SELECT headache, count(*) AS n FROM panel GROUP BY headache)
       SELECT headache, n, round_even(n / sum(n) OVER () * 100.0, 2) AS percentage FROM g""")
def prevalence(spark, sf_dir):
    """A2: target prevalence."""
    return profile.prevalence(views.panel(spark, sf_dir), "headache")


@query("num_summary", "variable:string count:bigint mean:double std:double min:double q25:double q50:double q75:double max:double",
       S.with_(S.PANEL) + f""", long AS ({_long_sql(NUMERIC, 'panel')})
       SELECT variable, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
              quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
              max(value) AS max FROM long GROUP BY variable""")
def num_summary(spark, sf_dir):
    """A3: numeric summary with exact quartiles."""
    return profile.numeric_summary(views.panel(spark, sf_dir), NUMERIC)


BOUNDS_SQL = f""", long AS ({_long_sql(NUMERIC, 'panel')}),
  b AS (SELECT variable, quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower,
               quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper
        FROM long GROUP BY variable)"""


@query("outlier_report", "variable:string lower:double upper:double n_outliers:bigint",
       S.with_(S.PANEL) + BOUNDS_SQL + """
       SELECT b.variable, b.lower, b.upper, count_if(l.value < b.lower OR l.value > b.upper) AS n_outliers
       FROM b JOIN long l ON l.variable = b.variable GROUP BY b.variable, b.lower, b.upper""")
def outlier_report(spark, sf_dir):
    """A5: IQR fences and outlier counts for every numeric column, one pass."""
    return profile.outlier_report(views.panel(spark, sf_dir), NUMERIC)


@query("outlier_rows", "rownames:bigint airq:double",
       S.with_(S.PANEL) + """, b AS (SELECT quantile_cont(airq, 0.25) AS q1, quantile_cont(airq, 0.75) AS q3 FROM panel)
       SELECT rownames, airq FROM panel, b WHERE airq < q1 - 1.5 * (q3 - q1) OR airq > q3 + 1.5 * (q3 - q1)""")
def outlier_rows(spark, sf_dir):
    """A4: rows outside the IQR fences of airq."""
    return profile.detect_outliers(views.panel(spark, sf_dir), "airq")


@query("outlier_flags", " ".join(["rownames:bigint"] + [f"{c}_is_outlier:boolean" for c in NUMERIC]),
       S.with_(S.PANEL) + BOUNDS_SQL + ", w AS (SELECT " + ", ".join(
           f"max(CASE WHEN variable = '{c}' THEN lower END) AS {c}_lo, max(CASE WHEN variable = '{c}' THEN upper END) AS {c}_hi"
           for c in NUMERIC) + " FROM b)\n"
       + "SELECT rownames, " + ", ".join(
           f"coalesce(CAST({c} AS DOUBLE) < w.{c}_lo OR CAST({c} AS DOUBLE) > w.{c}_hi, false) AS {c}_is_outlier"
           for c in NUMERIC) + " FROM panel, w")
def outlier_flags(spark, sf_dir):
    """Boolean outlier flags for every numeric column."""
    return profile.flag_outliers(views.panel(spark, sf_dir), NUMERIC)


@query("episodes_per_id", "id:bigint episodes:bigint",
       S.with_(S.PANEL) + "SELECT id, count(dos) AS episodes FROM panel GROUP BY id")
def episodes_per_id(spark, sf_dir):
    """Visits per entity."""
    return profile.episodes_per_entity(views.panel(spark, sf_dir))


@query("median_by_group", "id:bigint hatype:string median:double",
       S.with_(S.PANEL) + "SELECT id, hatype, quantile_cont(dos, 0.5) AS median FROM panel GROUP BY id, hatype")
def median_by_group(spark, sf_dir):
    """Exact median dos per (entity, subtype)."""
    return profile.median_by_group(views.panel(spark, sf_dir), ["id", "hatype"], "dos")


CORR_COLS = ["time", "dos", "age", "airq"]
HIST_COLS = ["prev_attacks", "visit_number", "days_since_first_visit", "airq_prev_mean"]


def _corr_sql(cols, src):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c FROM {src}")
    return "SELECT var_a, var_b, CASE WHEN isnan(c) THEN NULL ELSE c END AS corr FROM (" + " UNION ALL ".join(parts) + ") t"


@query("corr_matrix", "var_a:string var_b:string corr:double",
       S.with_(S.PANEL) + _corr_sql(CORR_COLS, "panel"))
def corr_matrix(spark, sf_dir):
    """Pairwise-complete Pearson correlations, one aggregate pass."""
    return profile.correlation_matrix(views.panel(spark, sf_dir), CORR_COLS)


@query("corr_complete", "var_a:string var_b:string corr:double",
       S.with_(S.PANEL, S.SCALAR, S.FEAT) + ", cc AS (SELECT * FROM feat WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in HIST_COLS) + ")\n" + _corr_sql(HIST_COLS, "cc"))
def corr_complete(spark, sf_dir):
    """A10: correlations over complete-case rows of the history features."""
    fp = features.build_feature_panel(views.panel(spark, sf_dir))
    return profile.correlation_matrix(fp, HIST_COLS, complete_cases=True)


@query("hist20", "variable:string bin:bigint lo:double hi:double count:bigint",
       S.with_(S.PANEL) + f""", long AS (SELECT * FROM ({_long_sql(['airq', 'dos'], 'panel')}) t WHERE value IS NOT NULL),
       r AS (SELECT variable, min(value) AS vmin, max(value) AS vmax FROM long GROUP BY variable),
       h AS (SELECT l.variable, r.vmin, r.vmax,
                    {S.equal_width_bin_sql('l.value', 'r.vmin', 'r.vmax', 20)} AS bin
             FROM long l JOIN r ON l.variable = r.variable)
       SELECT variable, bin, vmin + bin * ((vmax - vmin) / 20.0) AS lo, vmin + (bin + 1) * ((vmax - vmin) / 20.0) AS hi,
              count(*) AS count FROM h GROUP BY variable, bin, vmin, vmax""")
def hist20(spark, sf_dir):
    """20 equal-width bins per variable."""
    return profile.equal_width_histogram(views.panel(spark, sf_dir), ["airq", "dos"], 20)


@query("season_counts", "study_season:string position:bigint n:bigint",
       S.with_(S.PANEL, S.SCALAR) + """, o AS (SELECT * FROM (VALUES ('winter', 0), ('spring', 1), ('summer', 2), ('autumn', 3)) t(study_season, position))
       SELECT o.study_season, o.position, count(s.rownames) AS n FROM o LEFT JOIN scal s ON s.study_season = o.study_season
       GROUP BY o.study_season, o.position""")
def season_counts(spark, sf_dir):
    """Episodes per season in display order."""
    return profile.counts_in_order(features.add_study_date_features(views.panel(spark, sf_dir)), "study_season", SEASON_ORDER)


@query("box_stats", "hatype:string q1:double median:double q3:double whisker_lo:double whisker_hi:double n_outliers:bigint n:bigint",
       S.with_(S.PANEL) + """, q AS (SELECT hatype, quantile_cont(dos, 0.25) AS q1, quantile_cont(dos, 0.5) AS median,
              quantile_cont(dos, 0.75) AS q3 FROM panel GROUP BY hatype),
       j AS (SELECT p.hatype, CAST(p.dos AS DOUBLE) AS x, q.q1, q.median, q.q3,
              q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi FROM panel p JOIN q ON p.hatype = q.hatype
              WHERE p.dos IS NOT NULL)
       SELECT hatype, q1, median, q3, min(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_lo,
              max(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_hi,
              count_if(NOT (x >= lo AND x <= hi)) AS n_outliers, count(*) AS n
       FROM j GROUP BY hatype, q1, median, q3""")
def box_stats(spark, sf_dir):
    """Box-plot statistics of dos per subtype."""
    return profile.box_stats(views.panel(spark, sf_dir), "dos", ["hatype"])


@query("kde_by_group", "hatype:string point:bigint x:double density:double",
       S.with_(S.PANEL, S.DESIGN) + """, d AS (SELECT hatype, z_airq AS v FROM design WHERE z_airq IS NOT NULL),
       hist AS (SELECT hatype, v, count(*) AS c FROM d GROUP BY hatype, v),
       st AS (SELECT hatype, count(*) AS n, stddev_samp(v) AS sd, min(v) AS vmin, max(v) AS vmax FROM d GROUP BY hatype),
       st2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, n / sum(n) OVER () AS share FROM st),
       grid AS (SELECT hatype, point, n, bw, share,
                 (vmin - 3.0 * bw) + ((vmax + 3.0 * bw) - (vmin - 3.0 * bw)) * point / 199.0 AS x
                FROM st2, range(200) r(point))
       SELECT g.hatype, g.point, g.x,
              sum(h.c * exp(-0.5 * ((g.x - h.v) / g.bw) * ((g.x - h.v) / g.bw))) * (0.3989422804014327 / (g.n * g.bw)) * g.share AS density
       FROM grid g JOIN hist h ON g.hatype = h.hatype GROUP BY g.hatype, g.point, g.x, g.n, g.bw, g.share""")
def kde_by_group(spark, sf_dir):
    """Gaussian KDE of the standardised exposure per subtype (200-point grids)."""
    return profile.kde_by_group(views.design(spark, sf_dir), "z_airq", "hatype")


@query("top_decile", "rownames:bigint airq:double",
       S.with_(S.PANEL) + "SELECT rownames, airq FROM panel WHERE airq > (SELECT quantile_cont(airq, 0.9) FROM panel)")
def top_decile(spark, sf_dir):
    """Rows above the exact 90th percentile of airq."""
    return profile.top_decile(views.panel(spark, sf_dir), "airq")


@query("airq_quartile", "rownames:bigint airq:double airq_quartile:string",
       S.with_(S.PANEL) + """, b AS (SELECT quantile_cont(airq, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM panel)
       SELECT rownames, airq, CASE WHEN airq >= q[1] AND airq <= q[2] THEN 'Q1_low'
              WHEN airq > q[2] AND airq <= q[3] THEN 'Q2' WHEN airq > q[3] AND airq <= q[4] THEN 'Q3'
              WHEN airq > q[4] AND airq <= q[5] THEN 'Q4_high' END AS airq_quartile FROM panel, b""")
def airq_quartile(spark, sf_dir):
    """Exposure quartile bands (type-7 breaks, right-closed, lowest included)."""
    return profile.quartile_band(views.panel(spark, sf_dir), "airq", "airq_quartile")


@query("outliers_long", "variable:string rownames:bigint value:double",
       S.with_(S.PANEL) + BOUNDS_SQL.replace(f"long AS ({_long_sql(NUMERIC, 'panel')})",
       "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, rownames, CAST({c} AS DOUBLE) AS value FROM panel" for c in NUMERIC) + ")")
       + """
       SELECT l.variable, l.rownames, l.value FROM long l JOIN b ON l.variable = b.variable
       WHERE l.value < b.lower OR l.value > b.upper""")
def outliers_long(spark, sf_dir):
    """Outlier rows of every numeric column in one long table (partition key of the per-variable sink)."""
    return profile.outliers_long(views.panel(spark, sf_dir), NUMERIC, "rownames")



@query("events_box_stats", "event_type:string q1:double median:double q3:double whisker_lo:double whisker_hi:double n_outliers:bigint n:bigint",
       """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
       j AS (SELECT e.event_type, e.value AS x, q.q1, q.median, q.q3,
              q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi FROM events e JOIN q ON e.event_type = q.event_type
              WHERE e.value IS NOT NULL)
       SELECT event_type, q1, median, q3, min(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_lo,
              max(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_hi,
              count_if(NOT (x >= lo AND x <= hi)) AS n_outliers, count(*) AS n FROM j GROUP BY event_type, q1, median, q3""")
def events_box_stats(spark, sf_dir):
    """A13 on the event stream: box statistics of the event value per event type."""
    return profile.box_stats(views.events_panel(spark, sf_dir), "value", ["event_type"])
