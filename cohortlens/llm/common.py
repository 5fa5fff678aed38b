"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir, ship_package

#: Bytes of text that a Python task turns into words at a time (bounds the task's memory; never cuts a text).
SLICE_BYTES = 4 << 20


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which a cluster sets to fit its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it again.

    Cuts the lineage like ``checkpoint()``, survives lost executors, is
    compressed, and gives Catalyst the table's true size for its join choice.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote and nothing will read again."""
    for t in tables:
        files = t.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else ""
        if folder.rsplit("/", 1)[-1].startswith("saved-"):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id`` (long, may be null) and ``__bytes`` (UTF-8, null text as empty) of every row; other columns are not read."""
    ship_package(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("__id"),
                       F.coalesce(docs[text_col].cast("string").cast("binary"), F.lit(b"")).alias("__bytes"))


_HELD: dict = {}


def held(key, make):
    """What ``make`` makes for ``key``, kept in this Python worker for the tasks that follow.

    A worker keeps one such object: the one it had for another key, with its
    memos, is let go first, so a worker that serves several operators in turn
    needs no more memory than one of them.
    """
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Free what nothing holds, and hand the allocators' free memory back to the system, which they keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, most: int = SLICE_BYTES):
    """(ids, texts) of at most ``most`` bytes of text, or of one longer text; ``batches`` come from mapInArrow with (__id, __bytes)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.column(0).slice(start, end - start).to_pylist(), batch.column(1).slice(start, end - start).to_pylist()
            start = end


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: long) reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014). A hub
    never meets in one task: its minimum is a partial aggregate, and the join
    that hands it back is one that Spark can split. The edge table is written
    after each round; rounds end when it no longer changes.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    before = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(
            F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("s")).select("s.*").where("hi <> lo").distinct()
        e = saved(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root") \
        .union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
