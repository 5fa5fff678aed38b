"""Results must not depend on the number of shuffle partitions."""

import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["prev_events_split", "num_summary", "metrics_all", "threshold_grid", "bootstrap_metrics", "entity_split",
         "fairness_metrics", "perm_importance"]


def _canon(df):
    cols = sorted(df.columns)

    def norm(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_partitions_1_vs_7(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = _canon(E.queries()[name](spark, SF))
        spark.catalog.clearCache()
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = _canon(E.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.catalog.clearCache()
    assert a == b
