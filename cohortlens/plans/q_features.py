"""Queries: scan, cleaning, scalar features, history windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import clean, features
from cohortlens.plans import sql as S
from cohortlens.plans.base import REGISTRY, query
from cohortlens.sources import views

PANEL_COLS = "rownames:bigint id:bigint dos:bigint time:bigint hatype:string medication:string sex:string age:bigint airq:double headache:string"


def feature_panel(spark, sf_dir, rows_per_task=None):
    return features.build_feature_panel(views.panel(spark, sf_dir), rows_per_task=rows_per_task)


@query("scan_panel", PANEL_COLS, S.with_(S.PANEL) + "SELECT * FROM panel")
def scan_panel(spark, sf_dir):
    """The panel view (column pruning and the join are left to Catalyst)."""
    return views.panel(spark, sf_dir)


@query("clean_rows", PANEL_COLS + " target_num:bigint",
       S.with_(S.PANEL) + """SELECT DISTINCT *, CASE WHEN headache = 'yes' THEN 1 WHEN headache = 'no' THEN 0 END AS target_num
       FROM panel WHERE headache IN ('yes', 'no')""")
def clean_rows(spark, sf_dir):
    """Normalised names, full-row de-duplication, rows with a null target dropped."""
    df = features.add_target_numeric(views.panel(spark, sf_dir))
    return clean.basic_cleaning(df, target="target_num")


@query("missing_report", "variable:string n_missing:bigint",
       S.with_(S.PANEL, S.SCALAR) + """SELECT 'headache' AS variable, count(*) - count(headache) AS n_missing FROM scal
       UNION ALL SELECT 'target_num', count(*) - count(target_num) FROM scal
       UNION ALL SELECT 'age_band', count(*) - count(age_band) FROM scal
       UNION ALL SELECT 'airq', count(*) - count(airq) FROM scal
       UNION ALL SELECT 'time', count(*) - count(time) FROM scal""")
def missing_report(spark, sf_dir):
    """Nulls per column, one aggregate pass, long format."""
    df = features.add_scalar_features(views.panel(spark, sf_dir))
    return clean.missing_report(df, ["headache", "target_num", "age_band", "airq", "time"])


@query("phase", "rownames:bigint time:bigint phase:string",
       S.with_(S.PANEL, S.SCALAR) + "SELECT rownames, time, phase FROM scal")
def phase(spark, sf_dir):
    """Treatment phase from the sign of time."""
    return features.add_phase(views.panel(spark, sf_dir))


@query("study_season", "rownames:bigint dos:bigint study_date:date study_month:bigint study_season:string",
       S.with_(S.PANEL, S.SCALAR) + "SELECT rownames, dos, study_date, study_month, study_season FROM scal")
def study_season(spark, sf_dir):
    """Study date, month and season."""
    return features.add_study_date_features(views.panel(spark, sf_dir))


@query("age_band", "rownames:bigint age:bigint age_band:string",
       S.with_(S.PANEL, S.SCALAR) + "SELECT rownames, age, age_band FROM scal")
def age_band(spark, sf_dir):
    """T5: right-closed age bands, null outside."""
    return features.add_age_band(views.panel(spark, sf_dir))


@query("target_num", "rownames:bigint headache:string target_num:bigint",
       S.with_(S.PANEL, S.SCALAR) + "SELECT rownames, headache, target_num FROM scal")
def target_num(spark, sf_dir):
    """yes/no target to 1/0, anything else null."""
    return features.add_target_numeric(views.panel(spark, sf_dir))


@query("days_since_first", "rownames:bigint id:bigint days_since_first_visit:bigint",
       S.with_(S.PANEL, S.SCALAR, S.FEAT) + "SELECT rownames, id, days_since_first_visit FROM feat")
def days_since_first(spark, sf_dir):
    """Dos minus the entity's first dos."""
    return feature_panel(spark, sf_dir)


@query("visit_number", "rownames:bigint id:bigint visit_number:bigint",
       S.with_(S.PANEL, S.SCALAR, S.FEAT) + "SELECT rownames, id, visit_number FROM feat")
def visit_number(spark, sf_dir):
    """Running visit count per entity in row order."""
    return feature_panel(spark, sf_dir)


@query("prev_mean", "rownames:bigint id:bigint airq_prev_mean:double",
       S.with_(S.PANEL, S.SCALAR, S.FEAT) + "SELECT rownames, id, airq_prev_mean FROM feat")
def prev_mean(spark, sf_dir):
    """Mean of the entity's earlier values (null on the first visit)."""
    return feature_panel(spark, sf_dir)


@query("prev_events", "rownames:bigint id:bigint prev_attacks:double",
       S.with_(S.PANEL, S.SCALAR, S.FEAT) + "SELECT rownames, id, prev_attacks FROM feat")
def prev_events(spark, sf_dir):
    """Earlier events of the same entity ordered by (time, row key)."""
    return feature_panel(spark, sf_dir)


@query("prev_events_split", "rownames:bigint id:bigint visit_number:bigint airq_prev_mean:double prev_attacks:double days_since_first_visit:bigint",
       S.with_(S.PANEL, S.SCALAR, S.FEAT) + "SELECT rownames, id, visit_number, airq_prev_mean, prev_attacks, days_since_first_visit FROM feat")
def prev_events_split(spark, sf_dir):
    """W1-W4 through the hot-entity strategy (range-partitioned prefix sums)."""
    return feature_panel(spark, sf_dir, rows_per_task=20)


@query("prev_events_ref", "rownames:bigint id:bigint prev_attacks_ref:double",
       S.with_(S.PANEL, S.SCALAR) + """, ord AS (
         SELECT *, row_number() OVER w AS rn, lag(target_num) OVER w AS lag_e,
                sum(target_num) OVER (PARTITION BY id ORDER BY time, rownames ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
         FROM scal WINDOW w AS (PARTITION BY id ORDER BY time, rownames)),
       lastrow AS (SELECT id, target_num IS NULL AS last_null FROM (
         SELECT id, target_num, row_number() OVER (PARTITION BY id ORDER BY time DESC, rownames DESC) AS r FROM scal) t WHERE r = 1),
       tot AS (SELECT s.id, CASE WHEN max(CAST(l.last_null AS INTEGER)) = 1 THEN 0.0
                 ELSE coalesce(CAST(sum(s.target_num) AS DOUBLE), 0.0) END AS carry
               FROM scal s JOIN lastrow l ON s.id = l.id GROUP BY s.id),
       prevc AS (SELECT id, lag(carry) OVER (ORDER BY id) AS pc FROM tot)
       SELECT rownames, o.id, CASE WHEN rn = 1 THEN coalesce(pc, 0.0) WHEN lag_e IS NULL THEN 0.0
              ELSE coalesce(CAST(before AS DOUBLE), 0.0) END AS prev_attacks_ref
       FROM ord o JOIN prevc p ON o.id = p.id""")
def prev_events_ref(spark, sf_dir):
    """W4 reference mode (Q1): leaky ungrouped shift, without a global window."""
    df = features.add_scalar_features(views.panel(spark, sf_dir))
    return features.prev_events_reference(df)


@query("clinical_flags", "rownames:bigint flag_high_prev_attacks:bigint flag_many_visits:bigint flag_recent_attacks:bigint",
       S.with_(S.PANEL, S.SCALAR, S.FEAT) + """SELECT rownames,
         CAST(coalesce(prev_attacks > 10, false) AS BIGINT) AS flag_high_prev_attacks,
         CAST(coalesce(visit_number > 5, false) AS BIGINT) AS flag_many_visits,
         CAST(coalesce(prev_attacks > 3, false) AS BIGINT) AS flag_recent_attacks FROM feat""")
def clinical_flags(spark, sf_dir):
    """Clinical flags on raw units."""
    from cohortlens.functions.scalar import clinical_flags as flags
    df = feature_panel(spark, sf_dir)
    return df.select("rownames", *[c.alias(n) for n, c in flags().items()])


FLAGSHIP_OUT = ("study_season:string medication:string n_rows:bigint n_entities:bigint event_rate:double "
                "mean_prev_attacks:double mean_airq_prev_mean:double mean_visit_number:double")
FLAGSHIP_SQL = S.with_(S.PANEL, S.SCALAR, S.FEAT) + """SELECT study_season, medication, count(*) AS n_rows,
  count(DISTINCT id) AS n_entities, avg(target_num) AS event_rate, avg(prev_attacks) AS mean_prev_attacks,
  avg(airq_prev_mean) AS mean_airq_prev_mean, avg(visit_number) AS mean_visit_number
  FROM feat GROUP BY study_season, medication"""


@query("season_segment_rates", FLAGSHIP_OUT, FLAGSHIP_SQL)
def season_segment_rates(spark, sf_dir):
    """Flagship: feature panel (scalars + history windows), then event rate and mean
    history per (season, segment)."""
    fp = feature_panel(spark, sf_dir)
    return fp.groupBy("study_season", "medication").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_entities"),
        F.avg("target_num").alias("event_rate"),
        F.avg("prev_attacks").alias("mean_prev_attacks"),
        F.avg("airq_prev_mean").alias("mean_airq_prev_mean"),
        F.avg("visit_number").alias("mean_visit_number"),
    )


EVENTS_SQL = """events_p AS (
  SELECT event_id AS rownames, user_id AS id, ts, value, event_type,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day,
         CAST(event_type = 'error' AS INTEGER) AS target_num FROM events)"""


@query("events_history", "rownames:bigint id:bigint days_since_first_visit:bigint visit_number:bigint "
       "value_prev_mean:double prev_attacks:double",
       S.with_(EVENTS_SQL) + """SELECT rownames, id, day - min(day) OVER (PARTITION BY id) AS days_since_first_visit,
         row_number() OVER (PARTITION BY id ORDER BY ts, rownames) AS visit_number,
         avg(value) OVER (PARTITION BY id ORDER BY ts, rownames ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS value_prev_mean,
         CAST(coalesce(sum(target_num) OVER (PARTITION BY id ORDER BY ts, ts, rownames
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS prev_attacks
       FROM events_p""")
def events_history(spark, sf_dir):
    """W1-W4 on the event stream panel: order (timestamp, event id), day numbers, error events as outcome."""
    from cohortlens.spec import PanelSpec
    spec = PanelSpec(order=("ts", "rownames"), time="ts", dos="day")
    return features.history_features(views.events_panel(spark, sf_dir), spec, value="value")


ENTRY_A_NUM = ["rownames", "id", "time", "dos", "age", "airq"]


@query("entry_features", "rownames:bigint id:bigint airq_is_outlier:boolean dos_is_outlier:boolean phase:string "
       "study_season:string age_band:string target_num:bigint days_since_first_visit:bigint visit_number:bigint "
       "airq_prev_mean:double prev_attacks:double",
       S.with_(S.PANEL.replace("panel AS (", "raw AS ("), "panel AS (SELECT DISTINCT * FROM raw)", S.SCALAR, S.FEAT) + """,
  b AS (SELECT quantile_cont(airq, 0.25) AS a1, quantile_cont(airq, 0.75) AS a3,
               quantile_cont(CAST(dos AS DOUBLE), 0.25) AS d1, quantile_cont(CAST(dos AS DOUBLE), 0.75) AS d3 FROM panel)
SELECT rownames, id,
  coalesce(airq < a1 - 1.5 * (a3 - a1) OR airq > a3 + 1.5 * (a3 - a1), false) AS airq_is_outlier,
  coalesce(dos < d1 - 1.5 * (d3 - d1) OR dos > d3 + 1.5 * (d3 - d1), false) AS dos_is_outlier,
  phase, study_season, age_band, target_num, days_since_first_visit, visit_number, airq_prev_mean, prev_attacks
FROM feat, b""")
def entry_features(spark, sf_dir):
    """Entry A end to end: scan, basic cleaning (names, full-row de-duplication),
    IQR outlier flags for every numeric column, then scalar and history features -
    one Spark job with one shuffle for the de-duplication and one on entity."""
    from cohortlens.operators import clean, profile
    raw = views.panel(spark, sf_dir)
    cleaned = clean.basic_cleaning(raw, target="target_num")   # no target column yet: nothing dropped
    flagged = profile.flag_outliers(cleaned, ENTRY_A_NUM)
    return features.build_feature_panel(flagged)



@query("prev_events_ref_split", "rownames:bigint id:bigint prev_attacks_ref:double", REGISTRY["prev_events_ref"].sql_raw)
def prev_events_ref_split(spark, sf_dir):
    """W4 reference mode (Q1) through the hot-entity strategy: prefix sums over range
    partitions and a join of each row to its predecessor instead of lag windows."""
    df = features.add_scalar_features(views.panel(spark, sf_dir))
    return features.prev_events_reference(df, rows_per_task=20)
