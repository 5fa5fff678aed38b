"""Secret scan with corpus-wide ownership.

Patterns find secrets in each text, with their places in code points. A value
that stands in many owners' repositories is an example that people copy; one
that stays with an owner looks live. So every candidate value of the corpus is
hashed and its distinct repositories and owners are counted; candidates that
no base pattern covers are reported where their value is owner-specific.
DataFrame functions only: texts are scanned by ``regexp_extract_all`` and
``split`` (what lies between the matches gives their places).

The scan's small result is written once. Counting sums (value, repository,
owner) in each task before the shuffle, so a value that a third of all
documents hold is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import saved

#: Kinds in the order in which spans that start together are listed: name, pattern, least length, and the group whose length and value count.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]{14,}", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
)
#: Candidates of the method: long runs with upper and lower case letters and digits.
EXTRA = ("owned", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}", 20, 0)
#: A value of at least so many owners, or of so many repositories, is a widely copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 5
_SPAN = "struct<start:int,kind:int,end:int,name:string,value:string>"
#: Spans are gathered in pieces of this many, so that a text with very many costs little more than its length.
_PIECE = 256


def _spans(text: Column, kind: int, name: str, pattern: str, least: int, group: int) -> Column:
    """array<struct<start, kind, end, name, value>> of the matches that are long enough, in order. Places follow from the lengths of the matches and of what lies between them."""
    lit = F.lit(pattern)
    found = F.regexp_extract_all(text, lit, F.lit(0))
    values = F.regexp_extract_all(text, lit, F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    empty, piece = F.array().cast(f"array<{_SPAN}>"), F.array().cast(f"array<array<{_SPAN}>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        full = F.size(acc["now"]) >= _PIECE
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.lit(name).alias("name"), x["v"].alias("value"))
        now = F.when(full, empty).otherwise(acc["now"])
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(now, F.array(span))).otherwise(now).alias("now"),
                        F.when(full, F.concat(acc["past"], F.array(acc["now"]))).otherwise(acc["past"]).alias("past"))

    placed = F.aggregate(
        F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(between, F.lit(1), F.size(found)).alias("b")),
        F.struct(F.lit(0).alias("at"), empty.alias("now"), piece.alias("past")), step, lambda acc: F.concat(F.flatten(acc["past"]), acc["now"]))
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None) -> DataFrame:
    """(__row, __id, owner, repo, base, extra) of every row: spans by the base patterns, and candidates of the method outside them."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    owner = docs[owner_col].cast("string") if owner_col else F.lit(None).cast("string")
    repo = docs[repo_col].cast("string") if repo_col else owner
    t = F.col("__t")
    rows = docs.select(docs[id_col].cast("long").alias("__id"), owner.alias("owner"), repo.alias("repo"), text.alias("__t"))
    base = F.concat(*[_spans(t, k, *kind) for k, kind in enumerate(BASE)])
    rows = rows.withColumn("base", base).withColumn("found", _spans(t, len(BASE), *EXTRA))
    outside = F.filter("found", lambda x: ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return rows.select(F.monotonically_increasing_id().alias("__row"), "__id", "owner", "repo", "base", outside.alias("extra"))


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """(value_hash, owners, repos, copied): distinct owners and repositories of each candidate value of the corpus; a null owner or repository counts as one."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "extra")).alias("s")) \
        .select(F.xxhash64("s.value").alias("value_hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    return each.groupBy("value_hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("owner", "repo").alias("repos")) \
        .withColumn("copied", (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None,
                 copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per input row: ``id_col``, ``base`` and ``spans`` (arrays of start, kind, end, name, value; code points, end exclusive), ``n_live``, ``n_copied``.

    ``spans`` are the base spans and the method's, whose value is
    owner-specific. ``n_live`` and ``n_copied`` count all candidates of the
    text by what the corpus says of their value. A null or empty text has
    none. Rows without an owner or repository share one; without a
    ``repo_col`` the owner is the repository. Null ids, ties and repeated rows
    stay as they are. An empty table gives no rows.
    """
    found = saved(scan(docs, id_col, text_col, owner_col, repo_col))
    known = ownership(found, copied_owners, copied_repos).select("value_hash", "copied")
    candidates = found.select("__row", F.explode(F.concat("base", "extra")).alias("s")).withColumn("value_hash", F.xxhash64("s.value"))
    judged = candidates.join(known, "value_hash").groupBy("__row").agg(
        F.sum((~F.col("copied")).cast("long")).alias("n_live"), F.sum(F.col("copied").cast("long")).alias("n_copied"),
        F.collect_list(F.when(~F.col("copied") & (F.col("s.kind") == len(BASE)), F.col("s"))).alias("added"))
    return found.join(judged, "__row", "left").select(
        F.col("__id").alias(id_col), F.array_sort("base").alias("base"),
        F.array_sort(F.concat("base", F.coalesce("added", F.expr("slice(base, 1, 0)")))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans as text."""
    count = lambda name: F.size(F.filter("base", lambda s: s["name"] == name)).cast("long")
    return spans.select(id_col, *[count(k[0]).alias(f"n_{k[0]}") for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"), "n_live", "n_copied")
