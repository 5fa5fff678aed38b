"""Sinks (S3, S4): Parquet by default, CSV on request, one folder per variable."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, small: bool = False) -> str:
    """S3: write a result table. ``small=True`` (result tables of a few rows:
    metrics, coefficient tables) writes one file; row-level outputs keep
    their partitioning."""
    out = df.coalesce(1) if small else df
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_per_variable(long_df: DataFrame, path: str, variable_col: str = "variable", fmt: str = "parquet") -> str:
    """One output folder per variable from a single long DataFrame
    (instead of one job and one file per column)."""
    return write_table(long_df, path, fmt=fmt, partition_by=[variable_col])
