"""Per-entity longitudinal features (T1-T6 scalars, W1-W4 history windows).

History is summed by ``prefix.running_sums``: windows over the entity, which
share one shuffle on its id. An entity with more rows than one task should hold is
cut into cells that carry sums, the minimum and the last row from one to the
next, so it spreads over many tasks and the other entities stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalar
from cohortlens.operators.prefix import hot_keys, running_sums
from cohortlens.spec import DEFAULT_SPEC, PanelSpec


def add_phase(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn("phase", scalar.phase(time))


def add_study_date_features(df: DataFrame, dos: str = "dos") -> DataFrame:
    """study_date (T2), study_month (T3), study_season (T4)."""
    return (df.withColumn("study_date", scalar.study_date(dos))
              .withColumn("study_month", F.month("study_date"))
              .withColumn("study_season", scalar.season_of(F.col("study_month"))))


def add_age_band(df: DataFrame, age: str = "age") -> DataFrame:
    return df.withColumn("age_band", scalar.age_band(age))


def add_target_numeric(df: DataFrame, target: str = "headache", out: str = "target_num") -> DataFrame:
    return df.withColumn(out, scalar.target_numeric(target))


def add_scalar_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """T1-T6 in one projection."""
    df = add_phase(df, spec.time)
    df = add_study_date_features(df, spec.dos)
    df = add_age_band(df)
    return add_target_numeric(df, spec.target, spec.target_num)


def history_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, value: str = "airq", events: str | None = None,
                     rows_per_task: int | None = None) -> DataFrame:
    """W1-W4 (O1: W4 orders by the multi-key (time, row key)).

    days_since_first_visit = dos - min(dos) per entity (W1)
    visit_number           = running count in row order (W2)
    <value>_prev_mean      = mean of earlier non-null values, null on the first row (W3)
    prev_attacks           = earlier events ordered by (time, row key), 0 when none (W4; O1 multi-key order)

    An entity of more than ``rows_per_task`` rows spreads over several tasks.
    """
    events = events or spec.target_num
    row_order = [F.col(c) for c in spec.order]
    v = F.col(value)
    hot = hot_keys(df, [spec.id], rows_per_task)
    out = running_sums(df, [spec.id], row_order, {
        "visit_number": F.lit(1).cast("bigint"),
        "__prev_sum": v,
        "__prev_n": F.when(v.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
    }, least={"__first": F.col(spec.dos)}, hot=hot, rows_per_task=rows_per_task)
    out = running_sums(out, [spec.id], [F.col(spec.time)] + row_order, {"__before": F.col(events)}, hot=hot, rows_per_task=rows_per_task)
    return out.select(
        *df.columns, (F.col(spec.dos) - F.col("__first")).alias("days_since_first_visit"),
        (F.coalesce(F.col("visit_number"), F.lit(0)) + 1).alias("visit_number"),
        F.when(F.col("__prev_n") > 0, F.col("__prev_sum") / F.col("__prev_n")).alias(f"{value}_prev_mean"),
        F.coalesce(F.col("__before"), F.lit(0)).cast("double").alias("prev_attacks"))


def prev_events_reference(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, events: str | None = None,
                          rows_per_task: int | None = None) -> DataFrame:
    """W4 in the reference's leaky form (Q1): the cumulative sum is grouped by entity
    but shifted over the whole (id, time)-sorted table, so an entity's first row
    gets the previous entity's running total (0 if that entity's last event is
    missing); a row after a missing event gets 0.

    No global window: entity totals are ranked with a distributed prefix count,
    joined to the next entity's rank, and attached to first rows. Positions, earlier events and the row
    before come from ``running_sums``, which spreads hot entities."""
    events = events or spec.target_num
    order = [F.col(spec.time)] + [F.col(c) for c in spec.order]
    e = F.col(events)
    within = running_sums(df, [spec.id], order, {"__rn": F.lit(1).cast("bigint"), "__before": e},
                          previous={"__prev_missing": e.isNull()}, rows_per_task=rows_per_task) \
        .withColumn("__rn", F.coalesce("__rn", F.lit(0)) + 1)
    last_struct = F.struct(*[F.col(spec.time)] + [F.col(c) for c in spec.order])
    totals = df.groupBy(spec.id).agg(
        F.max_by(e.isNull(), last_struct).alias("__last_null"),
        F.sum(e).alias("__total"),
    )
    ranked = running_sums(totals, [], [F.col(spec.id)], {"__rank": F.lit(1).cast("bigint")}, inclusive=True, persist=True)
    carry = ranked.select(
        (F.col("__rank") + 1).alias("__next_rank"),
        F.when(F.col("__last_null"), F.lit(0.0)).otherwise(F.coalesce(F.col("__total").cast("double"), F.lit(0.0)))
        .alias("__carry"))
    id_rank = ranked.select(spec.id, "__rank")
    first_carry = id_rank.join(carry, id_rank["__rank"] == carry["__next_rank"], "left") \
        .select(spec.id, F.coalesce("__carry", F.lit(0.0)).alias("__carry"))
    out = within.join(first_carry, spec.id, "left")
    val = F.when(F.col("__rn") == 1, F.col("__carry")) \
           .when(F.coalesce(F.col("__prev_missing"), F.lit(True)), F.lit(0.0)) \
           .otherwise(F.coalesce(F.col("__before").cast("double"), F.lit(0.0)))
    return out.withColumn("prev_attacks_ref", val).drop("__rn", "__prev_missing", "__before", "__carry")


def build_feature_panel(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, rows_per_task: int | None = None) -> DataFrame:
    """nb03 order: scalar features, then history features (one shuffle on id)."""
    return history_features(add_scalar_features(df, spec), spec, rows_per_task=rows_per_task)
