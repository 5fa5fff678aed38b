"""Segmented prefix sums without putting a hot key group into one task.

Rows are summed in windows over their key. A key with more than
``ROWS_PER_TASK`` rows (there are at most rows / ROWS_PER_TASK of them) is cut
into cells by its order: boundaries come from a quantile summary of the first
order column over such keys, and a row's cell is a pure expression of that
column, so every evaluation puts a row into the same cell, also after an
executor is lost. What a cell needs of the cells before it (sums, the last
row) is a small table of cell totals, summed per key; it comes back as one
carry row per cell, which the cell's window sees first. So the rows are
shuffled once, keys of any size follow one path, and nulls in keys need no
join. Rows that tie on the first order column share a cell.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 1_000_000
#: Cells of one key at most, beyond which cells grow.
MAX_CELLS = 4096


def order_code(df: DataFrame, column: Column) -> Column:
    """A double that rises with ``column`` (not strictly: strings go by their first six bytes)."""
    kind = df.select(column).schema[0].dataType
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp").cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.when(column.isNotNull(), F.lit(0.0))


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int | None = None) -> tuple[DataFrame, int] | None:
    """(table of the keys with more than ``rows_per_task`` rows, the largest one's rows), or None where no key has so many."""
    limit = rows_per_task or ROWS_PER_TASK
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).persist()
    most = found.agg(F.max("__n")).first()[0]
    if most is None:
        found.unpersist()
        return None
    return found.select(*keys), most


def _cells(df: DataFrame, keys: list[str], order: list[Column], hot: DataFrame, cells: int) -> DataFrame:
    """``df`` with ``__hot`` and ``__cell``."""
    if keys:
        mark = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot"))
        same = [df[k].eqNullSafe(mark[f"__h_{k}"]) for k in keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        marked = df.join(F.broadcast(mark), on, "left").drop(*[f"__h_{k}" for k in keys]).withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    else:
        marked = df.withColumn("__hot", F.lit(True))
    marked = marked.withColumn("__code", order_code(df, order[0]))
    share = [i / cells for i in range(1, cells)]
    cut = marked.where("__hot").agg(F.percentile_approx("__code", share, 10 * MAX_CELLS)).first()[0] if share else None
    inner = sorted({c for c in cut or [] if float("-inf") < c < float("inf")})
    marked = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="__code", outputCol="__b", handleInvalid="keep").transform(marked)
    return marked.withColumn("__cell", F.when(~F.col("__hot"), 0).when(F.col("__code").isNull(), -1).otherwise(F.col("__b")).cast("int")).drop("__code", "__b")


def running_sums(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], inclusive: bool = False,
                 least: dict[str, Column] | None = None, previous: dict[str, Column] | None = None,
                 hot: tuple[DataFrame, int] | None | str = "find", rows_per_task: int | None = None, persist: bool = False) -> DataFrame:
    """Add one column per entry of ``values``: the running sum of that expression
    over rows of the same ``keys`` that come before (``inclusive``: up to and
    including) the current row in ``order``. ``order`` rises and must be a total order
    within a key (end it with a row key). Empty frames sum to null. ``least`` adds
    the minimum of an expression over the whole key, ``previous`` its value in the row before.

    ``hot`` takes the result of ``hot_keys`` where the caller has it. ``persist``
    keeps ``df`` for the second use of what is costly to make.
    """
    keys, least, previous = list(keys), least or {}, previous or {}
    named = [("sum", n, c) for n, c in values.items()] + [("least", n, c) for n, c in least.items()] + [("previous", n, c) for n, c in previous.items()]
    base = df.select("*", *[c.alias(f"__v{i}") for i, (_, _, c) in enumerate(named)])
    if persist:
        base = base.persist()
    if hot == "find":
        hot = hot_keys(base, keys, rows_per_task)
    if hot is None:
        cell, sort = keys, order
        rows = base
    else:
        limit = rows_per_task or ROWS_PER_TASK
        rows = _cells(base, keys, order, hot[0], min(MAX_CELLS, -(-hot[1] // limit))).withColumn("__row", F.lit(1))
        place = F.struct(*order)
        made = {"sum": lambda v: F.sum(v), "least": lambda v: F.min(v), "previous": lambda v: F.max_by(v, place)}
        totals = rows.where("__hot").groupBy(*keys, "__cell").agg(*[made[kind](f"__v{i}").alias(f"__v{i}") for i, (kind, _, _) in enumerate(named)])
        of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))    # at most MAX_CELLS + 2 rows a key
        before = of_key.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = {"sum": lambda v: F.sum(v).over(before), "least": lambda v: F.min(v).over(of_key), "previous": lambda v: F.lag(v).over(of_key.orderBy("__cell"))}
        carry = totals.select(*keys, "__cell", F.lit(0).alias("__row"), *[carried[kind](f"__v{i}").alias(f"__v{i}") for i, (kind, _, _) in enumerate(named)])
        rows = rows.unionByName(carry, allowMissingColumns=True)
        cell, sort = [*keys, "__cell"], [F.col("__row"), *order]
    within = Window.partitionBy(*cell) if cell else Window.partitionBy(F.lit(0))
    so_far = within.orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    over = {"sum": lambda v: F.sum(v).over(so_far), "least": lambda v: F.min(v).over(within), "previous": lambda v: F.lag(v).over(within.orderBy(*sort))}
    out = rows.select("*", *[over[kind](f"__v{i}").alias(f"__r{i}") for i, (kind, _, _) in enumerate(named)])
    if hot is not None:
        out = out.where("__row = 1")
    return out.select(*df.columns, *[F.col(f"__r{i}").alias(name) for i, (_, name, _) in enumerate(named)])
