"""Views over the driver's test tables that stand in for the reference inputs.

``panel``  - one row per entity visit (orders joined to customers)
``score``  - one row per scored item with a label (lineitem)
``design`` - panel plus a standardised design for scoring with given coefficients
``events_panel`` - a second panel keyed by user with timestamps

The column mapping itself is fixed by the fixture description; every operator
downstream only sees the panel schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.readers import table

# Fixed values (fixture definition): origin dates of the day counters.
DOS_ORIGIN = "1995-01-01"
TIME_ORIGIN = "1998-01-01"
# Fixed values (fixture definition): scorer coefficients of the design view.
DESIGN_COEFS = {
    "intercept": -0.4,
    "z_airq": 0.8,
    "z_dos": -0.3,
    "d_BUILDING": 0.5,
    "d_MACHINERY": -0.2,
    "d_FURNITURE": 0.1,
    "d_HOUSEHOLD": 0.0,
}
DESIGN_LEVELS = ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]  # baseline AUTOMOBILE


def _days_since(c: str, origin: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit(origin).cast("date")).cast("bigint")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit panel: rownames, id, dos, time, hatype, medication, sex, age, airq, headache."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    j = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    return j.select(
        F.col("o_orderkey").alias("rownames"),
        F.col("o_custkey").alias("id"),
        _days_since("o_orderdate", DOS_ORIGIN).alias("dos"),
        _days_since("o_orderdate", TIME_ORIGIN).alias("time"),
        F.col("o_orderpriority").alias("hatype"),
        F.col("c_mktsegment").alias("medication"),
        F.when(F.pmod(F.col("c_nationkey"), F.lit(2)) == 0, "female").otherwise("male").alias("sex"),
        (F.lit(18) + F.lit(2) * F.col("c_nationkey")).cast("bigint").alias("age"),
        F.col("o_totalprice").alias("airq"),
        F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").alias("headache"),
    )


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items: row key columns, id, grp, y_true, y_prob (11 values), y_cont (continuous)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_suppkey").alias("id"),
        "l_extendedprice",
        F.col("l_linestatus").alias("grp"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("y_true"),
        (F.col("l_discount") * F.lit(10.0)).alias("y_prob"),
        (F.col("l_extendedprice") / F.lit(105000.0)).alias("y_cont"),
    )


ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "id", "l_extendedprice"]


def row_key_string(cols: list[str] = ROW_KEY) -> Column:
    """Stable text form of the composite row key (used to seed hash draws)."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, y_true, y_prob) for two scorers: the bucketed and the continuous score."""
    s = score(spark, sf_dir)
    return s.select(
        "grp", "y_true",
        F.explode(F.array(
            F.struct(F.lit("bucketed").alias("model"), F.col("y_prob").alias("p")),
            F.struct(F.lit("continuous").alias("model"), F.col("y_cont").alias("p")),
        )).alias("s"),
    ).select(F.col("s.model").alias("model"), "grp", "y_true", F.col("s.p").alias("y_prob"))


def design_columns(df: DataFrame) -> DataFrame:
    """Standardised numerics and medication dummies (baseline AUTOMOBILE)."""
    out = df.withColumn("z_airq", (F.col("airq") - F.lit(250000.0)) / F.lit(150000.0)) \
            .withColumn("z_dos", (F.col("dos").cast("double") - F.lit(1200.0)) / F.lit(700.0))
    for lvl in DESIGN_LEVELS:
        out = out.withColumn(f"d_{lvl}", (F.col("medication") == lvl).cast("double"))
    return out


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design_columns(panel(spark, sf_dir))


EVENTS_ORIGIN = "2024-01-01"


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second panel: id = user_id, order (ts, event_id), day number, value, event type,
    target = error event."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        F.col("event_id").alias("rownames"),
        F.col("user_id").alias("id"),
        "ts", "value", "event_type",
        _days_since("ts", EVENTS_ORIGIN).alias("day"),
        (F.col("event_type") == "error").cast("int").alias("target_num"),
    )
