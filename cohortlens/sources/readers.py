"""Scans (S1, S2): CSV with a declared schema, Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Schema of the raw visit panel as documented for the reference data set.
RAW_PANEL_SCHEMA = T.StructType([
    T.StructField("rownames", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("time", T.LongType()),
    T.StructField("dos", T.LongType()),
    T.StructField("hatype", T.StringType()),
    T.StructField("age", T.LongType()),
    T.StructField("airq", T.DoubleType()),
    T.StructField("medication", T.StringType()),
    T.StructField("headache", T.StringType()),
    T.StructField("sex", T.StringType()),
])


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = RAW_PANEL_SCHEMA,
             header: bool = True, sep: str = ",") -> DataFrame:
    """Lazy CSV scan. A declared schema avoids an inference pass over the data."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema)
    return reader.csv(path)


def load_columns(spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet") -> DataFrame:
    """Re-read a processed table keeping only some columns (pruned at the scan)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return reader.load(path).select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver test table (Parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
