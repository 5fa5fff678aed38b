"""Query registry: each entry is a Spark job plus (when SQL can say it) a DuckDB oracle.

Every query declares its output columns once (``"name:type ..."``); the same
declaration casts/rounds the Spark result and wraps the oracle SQL, so names
and types agree in both engines. Doubles are rounded to 6 decimals as the last
step, as the oracle rules require.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ship_package

ROUND_NUDGE = 1e-10
_SPARK_TYPES = {"bigint": "bigint", "double": "double", "string": "string", "boolean": "boolean", "date": "date"}
_SQL_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    out: list[tuple[str, str]]
    sql: str | None
    doc: str
    sql_raw: str | None = None


REGISTRY: dict[str, Query] = {}


def parse_out(spec: str) -> list[tuple[str, str]]:
    cols = []
    for item in spec.split():
        name, typ = item.split(":")
        cols.append((name, typ))
    return cols


def finalize(df: DataFrame, out: list[tuple[str, str]]) -> DataFrame:
    exprs = []
    for name, typ in out:
        c = F.col(f"`{name}`").cast(_SPARK_TYPES[typ])
        if typ == "double":
            # Nudge before rounding so exact ties (common for averages of
            # decimal data) land on the same side in both engines despite
            # last-bit differences in summation order.
            c = F.round(c + F.lit(ROUND_NUDGE), 6) + F.lit(0.0)   # + 0.0 turns -0.0 into 0.0
        exprs.append(c.alias(name))
    return df.select(*exprs)


def wrap_sql(sql: str, out: list[tuple[str, str]]) -> str:
    cols = []
    for name, typ in out:
        c = f'CAST("{name}" AS {_SQL_TYPES[typ]})'
        if typ == "double":
            c = f"(round({c} + {ROUND_NUDGE!r}, 6) + 0.0)"
        cols.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(cols)} FROM (\n{sql}\n) AS q"


def query(name: str, out: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    cols = parse_out(out)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            ship_package(spark)
            return finalize(_fn(spark, sf_dir), cols)

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, cols, wrap_sql(sql, cols) if sql else None, fn.__doc__ or "", sql)
        return fn

    return deco
