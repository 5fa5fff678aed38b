"""Cleaning and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def normalise_names(df: DataFrame) -> DataFrame:
    """Strip and lower-case column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def basic_cleaning(df: DataFrame, target: str = "target_num") -> DataFrame:
    """P3-P5 (P3 names, P4 full-row de-duplication, P5 null target): normalise names, drop exact duplicate rows, drop rows with a null
    target when that column exists."""
    df = normalise_names(df).dropDuplicates()
    if target in df.columns:
        df = df.dropna(subset=[target])
    return df


def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count per column in one aggregate pass, then long (variable, n_missing)."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "variable", "n_missing")


def drop_na(df: DataFrame, cols: list[str]) -> DataFrame:
    """P7."""
    return df.dropna(subset=list(cols))


def semi_join(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Membership in a key table (left semi join; no collect of the key set)."""
    return df.join(keys.select(*on).distinct(), on=on, how="left_semi")
