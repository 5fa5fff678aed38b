"""URL filtering by host rules and by association rules mined from labels.

A short list of host rules decides first. For all other URLs, Spark's
FP-growth mines which combinations of URL tokens go with unwanted pages; rules
with enough support, confidence and lift are kept, less those that a shorter
rule already covers. An inverted index holds each rule once, under its rarest
token: a URL looks up its own tokens there, and a rule that is found matches
if the URL has all its tokens. DataFrame functions and Spark ML only.

All labelled rows are mined. Matching works on distinct URLs and returns to
the rows by the URL, so a URL that many rows share is looked up once.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import saved

#: Verdict, host, path. A rule fits its host and the hosts below it where the URL's path starts with the rule's; the longest wins.
HOST_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.8, 1.5
#: Labelled rows that a rule stands on at least, and what its confidence is at least with 95 % certainty (lower Wilson bound).
MIN_ROWS, MIN_BOUND, Z = 5, 0.6, 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "label=block"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: ``h:`` the host and each domain above it, ``p:`` path segments, ``q:`` query keys; runs of digits read 0."""
    labels = F.split(host_of(url), r"\.", -1)
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, n), ".")))
    folded = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    segments = F.transform(F.filter(F.split(path_of(url), "/", -1), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), folded(s)))
    query = F.regexp_extract(_after_scheme(url), r"\A[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&", -1), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), folded(F.substring_index(s, "=", 1))))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(hosts, segments, keys)))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """struct<size, rule, verdict> of the longest rule that fits, or null. ``rules`` is a list that the caller holds."""
    listed = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
                       for v, h, p in rules])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def mine(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS, min_bound: float = MIN_BOUND) -> DataFrame:
    """(anchor, tokens, confidence, lift, support) of the kept rules; no rows where nothing is labelled or nothing holds.

    A rule holds for at least ``min_support`` of the labelled rows and for ``min_rows`` of them, so that few labels teach
    nothing by chance; its confidence is at least ``min_confidence``, and the lower Wilson bound of it ``min_bound``.
    Rows with a null label or without tokens teach nothing.
    """
    spark = labelled.sparkSession
    items = labelled.where(labelled[blocked_col].isNotNull()).select(tokens_of(labelled[url_col]).alias("t"), labelled[blocked_col].cast("boolean").alias("b")) \
        .where(F.size("t") > 0).select(F.when(F.col("b"), F.array_append("t", F.lit(_BLOCK))).otherwise(F.col("t")).alias("items"))
    schema = "anchor string, tokens array<string>, confidence double, lift double, support double"
    total = items.count()
    if not total:
        return spark.range(0).select(*[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in schema.split(", ")])
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / total)), minConfidence=min_confidence).fit(items)
    seen, share = F.col("support") * total / F.col("confidence"), F.col("confidence")
    bound = (share + Z * Z / (2 * seen) - Z * F.sqrt((share * (1 - share) + Z * Z / (4 * seen)) / seen)) / (1 + Z * Z / seen)
    rules = saved(model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _BLOCK) & (F.col("lift") >= min_lift) & (bound >= min_bound))
                  .select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support"))
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchored = rules.withColumn("token", F.explode("tokens")).join(often, "token").groupBy("tokens", "confidence", "lift", "support") \
        .agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    # a rule is not needed where another one has only some of its tokens: look those up by their anchor
    shorter = anchored.select(F.col("anchor").alias("token"), F.col("tokens").alias("few"))
    covered = anchored.withColumn("token", F.explode("tokens")).join(shorter, "token") \
        .where((F.size("few") < F.size("tokens")) & (F.size(F.array_except("few", "tokens")) == 0)).select("tokens").distinct()
    return saved(anchored.join(covered, "tokens", "left_anti").select("anchor", "tokens", "confidence", "lift", "support"))


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=HOST_RULES, **mining) -> DataFrame:
    """One row per input row: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``n_matched`` (association rules), ``confidence`` (the largest).

    ``rule`` and its verdict come from ``rules``; where none fits, ``rule`` is
    null and the verdict is block if an association rule matches, else allow.
    ``labelled`` has ``url_col`` and a boolean ``blocked``. Null URLs and those
    without ``://`` have an empty host and path and are allowed. Null ids, ties
    and repeated rows stay as they are; other columns are not read. An empty
    table gives no rows; without labels only ``rules`` block.
    """
    index = mine(labelled, url_col, **mining)
    rows = pages.select(pages[id_col].alias("__id"), pages[url_col].cast("string").alias("__url"))
    urls = rows.where("__url is not null").select("__url").distinct().withColumn("has", tokens_of(F.col("__url")))
    matched = urls.withColumn("anchor", F.explode("has")).join(index, "anchor").where(F.size(F.array_except("tokens", "has")) == 0) \
        .groupBy("__url").agg(F.count("*").alias("n_matched"), F.max("confidence").alias("confidence"))
    judged = rows.join(matched, "__url", "left").withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url"))) \
        .withColumn("fit", host_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.coalesce("n_matched", F.lit(0)) > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("__id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce("fit.verdict", by_method).alias("verdict"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"), "confidence")
