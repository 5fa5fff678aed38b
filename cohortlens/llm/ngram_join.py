"""N-gram Jaccard self-join by a token-group matrix.

Documents are sets of word shingles. Similar documents are put into groups;
the matrix says which token lies in which group's union; a document is
compared with a group only when its overlap with that union could still reach
the threshold.

1. ``shared_items`` finds the shingles that occur in at least two documents.
   All other documents together are one group, and the first bound is with its
   union: a document with fewer than 80 % shared shingles links with nothing.
2. Equal sets collapse to one class.
3. Groups: classes with an equal min-hash are compared with the bucket's first
   class; verified links give provisional components, which are the groups.
   Groups are held in blocks of about BLOCK_SETS classes: a large group in
   blocks of its own, small groups beside those with an equal min-hash, whether
   they link or not.
4. Tokens are ordered from rare to frequent. Two sets that link share a token
   of their prefixes, so the matrix is kept for prefix tokens by block, and a
   token that meets only one group opens nothing: a large group of near copies
   costs its own tokens, not its pairs. A set with s shared tokens links with
   none larger than (100 + percent) / percent * s - n, and where the first token
   that both have comes after i others, with none larger than that for s - i.
   This parts near copies that have drifted too far before any pair is made.
5. Blocks that meet make one row per pair of blocks, not of sets, and a task
   holds two blocks at a time. There the exact overlap with the other block's
   token union bounds each set's similarity; what passes is opened and compared
   with the block's members exactly. Near copies of one text that do not link
   cost rows as the square of their blocks. Rounds take each block with itself
   and with one partner first and drop what lies within a component after
   merging, so links stay as few as groups, also where near copies came apart
   into many groups.
6. Links of 3 and 5 give the components. No link between different components
   can be missed, because every block met every block that shares a prefix
   token with it, and links within a component change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import connected_components, dropped, keyed_text, saved
from cohortlens.llm.shared_items import shared_items
from cohortlens.llm.words import WordHashes, mix, shingles

SHINGLE, PERCENT = 5, 80
MIN_HASHES = 2
#: Classes in a block, and shared tokens beyond which it has fewer.
BLOCK_SETS, BLOCK_TOKENS = 64, 1 << 16
#: Bytes of text in a block and words whose hash a task keeps, which bound its memory.
BLOCK_BYTES, MEMO_WORDS = 10 << 20, 100_000
#: Rounds of merging go on while they find more links than this share of the components.
MERGING = 0.1
_META = np.dtype([("id", "i8"), ("null", "u1"), ("n", "u4"), ("h1", "u8"), ("h2", "u8")])


def _extract(size: int):
    hashes = WordHashes()
    hashes.limit = MEMO_WORDS

    def extract(ids, texts):
        meta = np.zeros(len(ids), _META)
        found, owner = [], []
        for i, (key, text) in enumerate(zip(ids, texts, strict=True)):
            s = shingles(hashes.of(text.lower().split()), size)
            if len(s) > 1:
                s = np.sort(s)
                s = s[np.r_[True, s[1:] != s[:-1]]]
            meta[i] = (key or 0, key is None, len(s), np.add.reduce(s), np.add.reduce(mix(s ^ (s >> np.uint64(17)))))
            found.append(s)
            owner.append(np.full(len(s), i, np.uint64))
        none = np.zeros(0, np.uint64)
        return meta, np.concatenate(found or [none]), np.concatenate(owner or [none]), len(ids)

    return extract


def _needed(n, percent: int):
    return -(-percent * n // 100)


def _per_block(percent: int):
    def per_block(block, meta, where, items, code):
        at = np.searchsorted(where, np.arange(len(meta) + 1))
        shared = []
        for i, n in enumerate(meta["n"].astype(np.int64)):
            a, b = at[i], at[i + 1]
            if n == 0 or b - a < _needed(n, percent):
                shared.append(None)
                continue
            order = np.lexsort((items[a:b], code[a:b]))
            shared.append(items[a:b][order].tobytes())
        return pd.DataFrame({"id": pd.Series(meta["id"].astype(np.int64)).astype("Int64").mask(pd.Series(meta["null"] == 1)),
                             "n": meta["n"].astype(np.int64), "h1": meta["h1"].astype(np.int64), "h2": meta["h2"].astype(np.int64), "shared": shared})

    return per_block


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _signatures(count: int):
    """(band, value) of each class: the least of ``count`` hashes over its shared tokens."""
    def run(batches):
        for pdf in batches:
            out = []
            for k, n, most, blob in zip(pdf["k"], pdf["n"], pdf["most"], pdf["shared"], strict=True):
                t = np.frombuffer(blob, np.uint64)
                out += [(k, n, most, j, int(mix(t ^ np.uint64(0xA5A5_0001 * (j + 1))).min().astype(np.int64))) for j in range(count)]
            yield pd.DataFrame(out, columns=["k", "n", "most", "band", "value"])

    return run


def _linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
        out = []
        for x, n, y, m in zip(a, na, b, nb, strict=True):
            both = len(np.intersect1d(_tokens(x), _tokens(y), assume_unique=True))
            out.append(100 * both >= percent * (n + m - both))
        return pd.Series(out, dtype=bool)

    return linked


def _prefix(share: int, of: int):
    """The shared tokens among the first n - ceil(share * n / of) + 1 of a set; tokens of one document only come first in the order and meet nothing."""
    @F.pandas_udf("array<long>")
    def prefix(blob: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_tokens(b)[:max(0, len(b) // 8 - -(-share * int(m) // of) + 1)] for b, m in zip(blob, n, strict=True)])

    return prefix


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block as one row: its sets' sizes, shared sizes and tokens, by rising ``k``."""
    pdf = pdf.sort_values("k")
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [pdf["n"].to_numpy(np.int64).tobytes()],
                         "s": [np.array([len(b) // 8 for b in pdf["shared"]], np.int64).tobytes()], "tokens": [b"".join(pdf["shared"])]})


def _compared(percent: int):
    """Links (a, b) between the roots of a pair of blocks; none that the others already say."""
    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, others = pdf.iloc[0], pdf.iloc[-1]
        root = {int(r): int(r) for roots in pdf["roots"] for r in roots}

        def top(r: int) -> int:
            while root[r] != r:
                root[r] = root[root[r]]
                r = root[r]
            return r

        n, size, token = (_tokens(others[c]) for c in ("n", "s", "tokens"))
        order = np.argsort(token, kind="stable")
        token, owner = token[order], np.repeat(np.arange(len(size)), size)[order]
        theirs = np.array(others["roots"], np.int64)
        kinds = np.unique(theirs).tolist()
        links, ends = [], np.cumsum(_tokens(mine["s"]))
        for own, m, t in zip(mine["roots"], _tokens(mine["n"]), np.split(_tokens(mine["tokens"]), ends[:-1]), strict=True):
            if all(top(r) == top(int(own)) for r in kinds):
                continue
            first, last = np.searchsorted(token, t, "left"), np.searchsorted(token, t, "right")
            held = np.flatnonzero(last > first)
            if 100 * len(held) < percent * m:       # its overlap with the block's union
                continue
            count = (last - first)[held]
            at = np.arange(count.sum()) + np.repeat(first[held] - np.cumsum(count) + count, count)
            both = np.bincount(owner[at], minlength=len(n))
            for r in np.unique(theirs[100 * both >= percent * (n + m - both)]):
                x, y = top(int(own)), top(int(r))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((min(int(own), int(r)), max(int(own), int(r))))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return compared


def _links_across(pairs: DataFrame, member: DataFrame, compared: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between groups that join all that ``pairs`` (b1, b2) of blocks can join; ``member``: (k, g, block).

    A group is connected, so one link per pair of groups says all, and none is
    needed within a component. Each round takes every block with itself and
    with the same partner that its other neighbours take, compares these, merges
    the components they link and drops pairs of blocks that lie inside one.
    Near copies that came apart into many groups so melt together by links as
    many as the groups. Once rounds merge little, all that is left is compared
    at once.
    """
    links, tops = None, None
    while True:
        now = member.select("block", "k", F.col("g").alias("root")) if tops is None else \
            member.join(tops.select(F.col("node").alias("g"), F.col("root").alias("top")), "g", "left").select("block", "k", F.coalesce("top", "g").alias("root"))
        roots = saved(now.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "root"))).alias("m")).select("block", F.col("m.root").alias("roots")))
        span = roots.select("block", F.array_min("roots").alias("r1"), F.array_max("roots").alias("r2"))
        pairs = saved(pairs.join(span.select(F.col("block").alias("b1"), F.col("r1").alias("x1"), F.col("r2").alias("x2")), "b1")
                      .join(span.select(F.col("block").alias("b2"), F.col("r1").alias("y1"), F.col("r2").alias("y2")), "b2")
                      .where("least(x1, y1) <> greatest(x2, y2)").select("b1", "b2"))
        partner = pairs.where("b1 <> b2").select(F.explode(F.array(F.struct("b1", "b2"), F.struct(F.col("b2").alias("b1"), F.col("b1").alias("b2")))).alias("p")) \
            .groupBy("p.b1").agg(F.min("p.b2").alias("b2")).select(F.least("b1", "b2").alias("b1"), F.greatest("b1", "b2").alias("b2"))
        best = saved(pairs.where("b1 = b2").union(partner).distinct())
        found = saved(compared(best, roots).distinct())
        few = found.count() <= MERGING * roots.select(F.explode("roots")).distinct().count()
        pairs = pairs.join(best, ["b1", "b2"], "left_anti")
        if few:
            found = saved(found.union(compared(pairs, roots)).distinct())
        links = found if links is None else saved(links.union(found))
        if few:
            return links
        tops = connected_components(links)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``class_id``, ``component_id``.

    Sets are the distinct ``size``-word shingles of the whole text, A-Z
    lower-cased; fewer words make one shingle of all; a null, empty or blank
    text has the empty set and links with nothing. Two documents link when
    100 * intersection >= ``percent`` * union. ``class_id`` is equal for equal
    sets (null for empty ones); ``component_id`` is the smallest id that links
    reach. Rows without an id are linked like others, but give no name: their
    component is null if it has no other id. Repeated rows stay, each with the
    same result. Other columns of ``docs`` are not read. An empty table gives
    no rows. Sets are compared by 64-bit hashes.
    """
    found = saved(shared_items(keyed_text(docs, id_col, text_col), _extract(size), _META, _per_block(percent),
                               "id long, n long, h1 long, h2 long, shared binary", BLOCK_BYTES).withColumn("k", F.when(F.col("n") > 0, F.xxhash64("n", "h1", "h2"))))
    # overlap >= percent / (100 + percent) * (n + m): with s shared tokens, no partner is larger than this
    most = F.expr(f"({100 + percent}L * (octet_length(shared) div 8)) div {percent} - n")
    classes = saved(found.where("shared is not null").dropDuplicates(["k"]).select("k", "n", most.alias("most"), "shared"))
    rows = saved(found.select("id", "n", "k"))
    dropped(found)
    blob = classes.select("k", "shared")
    hub = classes.select(F.col("k").alias("hub"), F.col("n").alias("hub_n"), F.col("shared").alias("hub_shared"))
    linked = _linked(percent)

    bands = saved(classes.mapInPandas(_signatures(MIN_HASHES), "k long, n long, most long, band int, value long"))
    heads = bands.groupBy("band", "value").agg(F.max(F.struct((F.col("most") / F.col("n")).alias("share"), "k", "n", "most")).alias("head"))
    stars = bands.join(heads, ["band", "value"]).where("k <> head.k and n <= head.most and head.n <= most").select("k", F.col("head.k").alias("hub")).distinct()
    stars = saved(stars.join(classes.select("k", "n", "shared"), "k").join(hub, "hub").where(linked("shared", "n", "hub_shared", "hub_n"))
                  .select(F.col("k").alias("a"), F.col("hub").alias("b")))
    roots = connected_components(stars).select(F.col("node").alias("k"), "root")
    sized = classes.select("k", "n", "most", F.expr("octet_length(shared) div 8").alias("s")).join(roots, "k", "left").withColumn("g", F.coalesce("root", "k"))
    # a large group has blocks of its own, a small one is in a block of those whose first classes have an equal min-hash
    units = sized.groupBy("g").agg(F.count("*").alias("sets")).join(bands.where("band = 0").select(F.col("k").alias("g"), "value"), "g") \
        .select("g", (F.col("sets") > BLOCK_SETS).alias("large"), F.when(F.col("sets") > BLOCK_SETS, F.col("g")).otherwise(F.col("value")).alias("unit"))
    placed = saved(sized.select("k", "n", "s", "g").join(units, "g"))
    parts = placed.groupBy("large", "unit").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("s") / BLOCK_TOKENS)).alias("parts"))
    member = saved(placed.join(parts, ["large", "unit"])
                   .select("k", "n", "g", F.expr("xxhash64(large, unit, pmod(xxhash64(if(large, k, g)), parts))").alias("block")))
    dropped(bands, placed)

    # each pair is looked for from its larger set, at the first token that both have: after i earlier ones no partner is larger than ``room``
    ordered = saved(member.join(blob, "k").select("n", "g", "block", F.expr("octet_length(shared) div 8").alias("s"), _prefix(percent, 100)("shared", "n").alias("probe"),
                                                  _prefix(2 * percent, 100 + percent)("shared", "n").alias("index")))
    room = F.expr(f"({100 + percent}L * (s - i)) div {percent} - n").alias("room")
    index = ordered.select("g", "block", "n", "s", F.posexplode("index").alias("i", "token")).select("token", "g", "block", "n", room)
    matrix = saved(index.groupBy("token", F.col("block").alias("to_block"))
                   .agg(F.min("g").alias("to_g1"), F.max("g").alias("to_g2"), F.min("n").alias("n1"), F.max("n").alias("n2"), F.max("room").alias("to_room")))
    several = matrix.groupBy("token").agg(F.min("to_g1").alias("g1"), F.max("to_g2").alias("g2"), F.min("n1").alias("least_n"), F.max("to_room").alias("best_room"))
    probe = ordered.select("n", "s", "g", "block", F.posexplode("probe").alias("i", "token")).select("token", "n", "g", "block", room).join(several, "token") \
        .where("(g <> g1 or g <> g2) and least_n <= least(n, room) and best_room >= n") \
        .groupBy("token", "block").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.min("n").alias("least_n"), F.max(F.least("n", "room")).alias("most"))
    pairs = saved(probe.join(matrix, "token")
                  .where(f"least(g1, to_g1) <> greatest(g2, to_g2) and n1 <= most and 100 * n2 >= {percent} * least_n and to_room >= least_n")
                  .select(F.least("block", "to_block").alias("b1"), F.greatest("block", "to_block").alias("b2")).distinct())
    dropped(matrix, ordered)
    met = pairs.select(F.explode(F.array("b1", "b2")).alias("block")).distinct()
    meeting = saved(member.join(met, "block").select("k", "n", "g", "block"))
    # written, so that no task runs two Python workers at once
    packed = saved(meeting.select("k", "n", "block").join(blob, "k").groupBy("block").applyInPandas(_packed, "block long, n binary, s binary, tokens binary"))

    def compared(candidates: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between the ``roots`` of the blocks of each pair; a task holds one pair's two blocks."""
        sides = candidates.select("b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
        return sides.join(packed, "block").join(roots, "block").groupBy("b1", "b2").applyInPandas(_compared(percent), "a long, b long")

    across = _links_across(pairs, meeting, compared)
    dropped(packed)
    top = connected_components(across).select(F.col("node").alias("g"), F.col("root").alias("top"))
    grouped = sized.select("k", "g").join(top, "g", "left").select("k", F.coalesce("top", "g").alias("root"))
    named = rows.where("n > 0").groupBy("k").agg(F.min("id").alias("least")).join(grouped, "k", "left") \
        .select("k", "least", F.coalesce("root", "k").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    by_class = named.select("k", "root").join(least, "root").select(F.col("k").alias("ck"), "component")
    return rows.select("id", "n", "k").join(by_class, F.col("k") == F.col("ck"), "left") \
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("k").alias("class_id"),
                F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Rows of ``docs`` with the smallest id of their component, once each; all columns stay.

    Rows without an id cannot be named as a copy and stay. A repeated row
    (same id) stays once.
    """
    ids = jaccard_components(docs, id_col, text_col, **settings)
    keep = ids.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__keep")).distinct()
    found = docs.where(docs[id_col].isNotNull()).join(keep, docs[id_col] == F.col("__keep")).drop("__keep").dropDuplicates([id_col])
    return found.unionByName(docs.where(docs[id_col].isNull()))
