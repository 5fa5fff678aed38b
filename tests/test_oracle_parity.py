"""Registered queries vs their DuckDB oracles on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECK = ["season_segment_rates", "prev_events_split", "prev_events_ref", "num_summary", "outlier_report", "box_stats",
         "kde_by_group", "metrics_all", "roc_curve", "threshold_grid", "bootstrap_summary", "fairness_all",
         "anova_oneway", "prep_numeric", "prep_onehot", "isotonic_fit", "ale_stratified", "perm_importance",
         "sensitivity_table", "or_single_factor"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_key_has_a_callable():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90


@pytest.mark.parametrize("name", CHECK)
def test_parity(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    d_rows = cur.fetchall()
    d_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _canon(s_rows, df.columns) == _canon(d_rows, d_cols)


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() > 0
    assert "event_rate" in out.columns
