"""Line deduplication by site-relative frequency.

A line is a site's furniture if it stands on more than a given share of the
site's pages. Lines are grouped by host; the pages that contain a line,
divided by the host's pages, are its ratio. A page is a distinct text of the
host, so that copies of one page do not turn its own lines into furniture.
DataFrame functions only.

Lines are counted by 128-bit hashes, summed in each task before the shuffle.
A host's furniture is short, however large the host: its pages' mean number of
lines over the ratio bounds it. So it is kept as one array per host and meets
the documents in one join on the host, which Spark broadcasts while the table
is small by its own measure, and splits where one host has many documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import saved

RATIO, MIN_PAGES, MAX_WORD_SHARE = 0.05, 3, 0.5
_WHITE = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    """128 bits for a line without the white space around it; null for a line without words."""
    trimmed = F.btrim(line, F.lit(_WHITE))
    return F.when(trimmed != "", F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text",
                ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the keys of each host's lines that stand on at least ``min_pages`` and more than ``ratio`` of its distinct pages."""
    text = docs[text_col].cast("string")
    pages = docs.select(docs[host_col].cast("string").alias("host"), F.xxhash64(text).alias("page"), text.alias("t")).where("t is not null")
    totals = pages.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    keys = F.array_distinct(F.array_compact(F.transform(_lines(F.col("t")), _key)))
    on = pages.select("host", "page", F.explode(keys).alias("k")).select("host", "page", "k.a", "k.b") \
        .groupBy("host", "a", "b").agg(F.count_distinct("page").alias("on_pages")).where(F.col("on_pages") >= min_pages)
    frequent = on.join(totals, on["host"].eqNullSafe(totals["host"])).where(F.col("on_pages") > ratio * F.col("pages"))
    return frequent.groupBy(on["host"]).agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, max_word_share: float = MAX_WORD_SHARE) -> DataFrame:
    """``docs`` with its columns, its text without its host's boilerplate lines, and ``__n_lines``, ``__n_dropped``.

    Lines are what newlines separate; lines without words are never counted or
    dropped. A text of which boilerplate makes up more than ``max_word_share``
    (of its characters other than white space) stays whole: it is a page that
    others copy, not a page with furniture, and is left to the near-duplicate
    operators. Null texts stay null, empty ones empty; rows without a host are
    one host; repeated rows are one page and all stay. An empty table gives no
    rows.
    """
    plain = saved(boilerplate(docs, host_col, text_col, ratio, min_pages)).select(F.col("host").alias("__host"), F.col("lines").alias("__boilerplate"))
    text = docs[text_col].cast("string")
    joined = docs.join(plain, docs[host_col].cast("string").eqNullSafe(F.col("__host")), "left").withColumn("__lines", _lines(text))
    no = F.array().cast("array<struct<a:bigint,b:bigint>>")
    kept = F.when(F.col("__boilerplate").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: ~F.coalesce(F.array_contains(F.coalesce("__boilerplate", no), _key(x)), F.lit(False))))
    words = lambda lines: F.length(F.translate(F.array_join(lines, "\n"), _WHITE, ""))
    some = joined.withColumn("__kept", kept)
    dropped = F.size("__lines") - F.size("__kept")
    furniture = (dropped > 0) & (words(F.col("__kept")) >= (1 - max_word_share) * words(F.col("__lines")))
    result = some.withColumn("__cut", furniture).withColumn("__n_lines", F.coalesce(F.size("__lines"), F.lit(0)))
    columns = [F.when(F.col("__cut"), F.array_join("__kept", "\n")).otherwise(text).alias(c) if c == text_col else docs[c] for c in docs.columns]
    return result.select(*columns, F.when(text.isNull(), 0).otherwise(F.col("__n_lines")).cast("long").alias("__n_lines"),
                         F.when(F.col("__cut"), dropped).otherwise(0).cast("long").alias("__n_dropped"))
