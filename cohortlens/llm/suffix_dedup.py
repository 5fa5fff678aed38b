"""Exact substring deduplication over byte suffixes, by difference covers.

Every byte that a string of LENGTH bytes covers is removed if that string also
starts anywhere else in the corpus. Suffixes are compared over LENGTH bytes by
a difference-cover sort (Karkkainen and Sanders): triples at two of three
places are sorted and named, names are sorted in turn until they are unique or
span LENGTH bytes, the remaining suffixes are merged in, and neighbours of the
order are compared.

What the sort works on is dealt out by content, so that equal strings always
meet and no task sees the whole:

1. Anchors: every GRAM + WINDOW - 1 bytes hold the least hash of WINDOW byte
   grams. ``shared_items`` finds the anchors that occur twice. A repeated
   string holds only such anchors, which leaves the places where one can start.
2. Texts that are equal are looked at once; those with a copy elsewhere are
   covered whole.
3. A place belongs to its first anchor, the least hash after it. Neighbours
   with the same anchor form a unit of at most WINDOW places. Units with equal
   content (all bytes that their strings hold) are repeated without a sort.
4. Units of the same anchor whose content differs may still share strings.
   They meet by the KEY bytes that follow the anchor, which lie in each of
   their strings, and the difference-cover sort decides every place. Each
   distinct content goes there once, however many texts have it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import keyed_text, saved, width
from cohortlens.llm.shared_items import shared_items

LENGTH, GRAM, WINDOW, KEY = 200, 32, 31, 128
_META = np.dtype([("id", "i8"), ("null", "u1"), ("n", "u4"), ("h1", "u8"), ("h2", "u8"), ("sha", "V32")])
_SPREAD = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)
_MUL, _S29, _S31 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(31)
PARTS_PER_PARTITION = 4


def gram_hashes(text: bytes, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from each place on."""
    h = _SPREAD[np.frombuffer(text, np.uint8)]
    s = 1
    while s < size:
        h = h[:-s] * _MUL + (h[s:] ^ (h[s:] >> _S29))
        s *= 2
    return (h ^ (h >> _S31)) * _MUL


def sliding(x: np.ndarray, w: int, f, fill: int) -> np.ndarray:
    """``f`` (np.minimum or np.maximum) over each ``w`` neighbours."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, fill, np.uint64)]).reshape(-1, w)
    before = f.accumulate(y, axis=1).reshape(-1)[:n]
    after = np.ascontiguousarray(f.accumulate(y[:, ::-1], axis=1)[:, ::-1]).reshape(-1)[:n]
    return f(after[:n - w + 1], before[w - 1:])


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places that are the least of some WINDOW grams, least hash of the WINDOW grams from each place on)."""
    low = sliding(h, WINDOW, np.minimum, (1 << 64) - 1)
    side = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([side, low, side]), WINDOW, np.maximum, 0) == h), low


def _extract(ids, texts):
    meta, items, where = np.zeros(len(ids), _META), [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    base = 0
    for i, (key, t) in enumerate(zip(ids, texts, strict=True)):
        h1 = xxhash.xxh64_intdigest(t, 42)
        meta[i] = (key or 0, key is None, len(t), h1, xxhash.xxh64_intdigest(t, h1), hashlib.sha256(t).digest())
        if len(t) >= LENGTH:
            h = gram_hashes(t, GRAM)
            at, _ = anchors(h)
            items.append(h[at])
            where.append((at + base).astype(np.uint64))
        base += len(t)
    return meta, np.concatenate(items), np.concatenate(where), base


def _runs(block, meta, where, items, code):
    """Per text, the runs of repeated anchors that could hold a repeated string, as first and last places."""
    ends = np.cumsum(meta["n"].astype(np.int64))
    cut = np.searchsorted(where, np.r_[0, ends])
    runs = []
    for i, (n, end) in enumerate(zip(meta["n"].tolist(), ends.tolist(), strict=True)):
        at = where[cut[i]:cut[i + 1]].astype(np.int64) - (end - n)
        found = None
        if len(at):
            heads = np.flatnonzero(np.r_[True, np.diff(at) > WINDOW])
            first, last = at[heads], at[np.r_[heads[1:] - 1, len(at) - 1]]
            # the string's last whole window of grams and its first one both hold an anchor of the run
            long = last - first >= LENGTH - GRAM + 1 - 2 * WINDOW
            found = np.stack([first[long], last[long]], 1).astype(np.int32).tobytes() if long.any() else None
        runs.append(found)
    return pd.DataFrame({"id": pd.Series(meta["id"].astype(np.int64)).astype("Int64").mask(pd.Series(meta["null"] == 1)), "n": meta["n"].astype(np.int64),
                         "h1": meta["h1"].astype(np.int64), "h2": meta["h2"].astype(np.int64), "sha": [bytes(x).hex() for x in meta["sha"]], "runs": runs})


def places_and_anchors(text: bytes, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where a repeated string may start, the first anchor of each, hash of the KEY bytes from that anchor on)."""
    h = gram_hashes(text, GRAM)
    at, low = anchors(h)
    n = len(text) - LENGTH + 1
    edge = np.zeros(n + 1, np.int64)
    for first, last in runs:
        a, b = max(0, first - WINDOW), min(n, last + GRAM + WINDOW - LENGTH + 1)
        if b > a:
            edge[a] += 1
            edge[b] -= 1
    p = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    i = np.searchsorted(at, p)
    wrong = np.flatnonzero(h[at[i]] != low[p])
    while len(wrong):
        i[wrong] += 1
        wrong = wrong[h[at[i[wrong]]] != low[p[wrong]]]
    anchor = at[i]
    return p, anchor, gram_hashes(text, KEY)[anchor]


def units(text: bytes, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number of places, key, content hash) of each unit."""
    p, anchor, key = places_and_anchors(text, runs)
    if not len(p):
        return p, p, key, key
    heads = np.flatnonzero(np.r_[True, (np.diff(p) > 1) | (np.diff(anchor) > 0)])
    size = np.diff(np.r_[heads, len(p)])
    start = p[heads]
    content = np.fromiter((xxhash.xxh64_intdigest(text[s:s + k - 1 + LENGTH]) for s, k in zip(start.tolist(), size.tolist(), strict=True)), np.uint64, len(start))
    return start, size, key[heads], content


def _unit_rows(frames):
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            start, size, key, content = units(r.text, np.frombuffer(r.runs, np.int32).reshape(-1, 2).tolist())
            out.append(pd.DataFrame({"h1": r.h1, "h2": r.h2, "start": start, "size": size, "key": key.view(np.int64), "content": content.view(np.int64)}))
        yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("h1", "h2", "start", "size", "key", "content")})


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One number per row of ``columns`` (numbers of 0 or more) that orders like the row."""
    key, top = columns[0], int(columns[0].max(initial=0))
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if top.bit_length() + bits > 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = int(key.max(initial=0))
        key = (key << bits) | c
        top = (top << bits) | int(c.max(initial=0))
    return key


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Dense names, from 1, of rows in their order; the order; the number of names."""
    key = _packed(columns)
    order = np.argsort(key)
    s = key[order]
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(np.r_[1, (s[1:] != s[:-1]).astype(np.int64)])[:len(order)]
    return name, order, int(name[order[-1]]) if len(order) else 0


def difference_cover_order(s: np.ndarray, span: int) -> np.ndarray:
    """The order of the suffixes of ``s`` (numbers above 0), right over their first ``span`` numbers; beyond the end stand zeros."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    if span <= 1 or n < 3:
        padded = np.r_[s, np.zeros(3, s.dtype)]
        return np.argsort(_packed([padded[k:k + n] for k in range(3)]), kind="stable")
    padded = np.r_[s, np.zeros(3, s.dtype)]
    # sort sampled triples and name them
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 2, 3)  # a place past the end keeps the samples complete
    one, two = one[one < n], two[two < n]
    sample = np.r_[one, two]
    name, by_name, distinct = _names([padded[sample], padded[sample + 1], padded[sample + 2]])
    if distinct < len(sample) and span > 3:
        # names of places 1 mod 3, a zero, names of places 2 mod 3: neighbours there are three places apart
        text = np.r_[name[:len(one)], [0], name[len(one):]] + 1
        text[len(one)] = 1
        order = difference_cover_order(text, -(-span // 3))
        order = order[order != len(one)]
        order = np.where(order > len(one), order - 1, order)
    else:
        order = by_name
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    # remaining suffixes, by their first number and the rank of what follows
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_packed([padded[zero], rank[zero + 1]]))]
    # merge: how many samples of either kind stand before each of them
    first_kind = sample[order] % 3 == 1
    sorted_one, sorted_two = sample[order][first_kind], sample[order][~first_kind]
    before = _before([padded[sorted_one], rank[sorted_one + 1]], [padded[zero], rank[zero + 1]]) \
        + _before([padded[sorted_two], padded[sorted_two + 1], rank[sorted_two + 2]], [padded[zero], padded[zero + 1], rank[zero + 2]])
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(before) + np.arange(len(zero))  # what is equal over the span may stand in any order
    free = np.ones(n, bool)
    free[at] = False
    out[at] = zero
    out[free] = sample[order]
    return out


def _before(sorted_keys: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """For each row of ``keys`` (in rising order), how many rows of ``sorted_keys`` are lower."""
    n = len(sorted_keys[0])
    both = _packed([np.r_[a, b] for a, b in zip(sorted_keys, keys, strict=True)])
    return np.searchsorted(both[:n], both[n:], side="left")


def repeated_places(contents: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """For each content, which of its first ``size`` places start a string of LENGTH bytes that starts elsewhere in ``contents`` too.

    Places are taken eight bytes apart: the text is read as eight interleaved
    strings of 64-bit words, whose suffixes order like the bytes' do.
    """
    words, begin, place = [], [], []
    n = 0
    for c in contents:
        data = c + b"\0" * 7
        m = len(c)
        w = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (m, 8), (1, 1)).copy().view(">u8").reshape(-1).astype(np.uint64)
        by = np.argsort(np.arange(m) % 8, kind="stable")
        words += [w[by], np.zeros(1, np.uint64)]
        where = np.empty(m, np.int64)
        where[by] = n + np.arange(m)
        place.append(where)
        begin.append(n)
        n += m + 1
    alphabet, s = np.unique(np.concatenate(words), return_inverse=True)
    steps = LENGTH // 8
    s = s.astype(np.int64) + 1
    order = difference_cover_order(s, steps)
    unit = np.full(n, -1, np.int64)
    for i, (where, k) in enumerate(zip(place, sizes, strict=True)):
        unit[where[:k]] = i
    order = order[unit[order] >= 0]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(steps):
        same &= s[order[1:] + k] == s[order[:-1] + k]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [hit[where[:k]] for where, k in zip(place, sizes, strict=True)]


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places of each unit of a part that are repeated, as bits."""
    pdf = pdf.drop_duplicates(["key", "content"])
    found = repeated_places([bytes(x) for x in pdf["bytes"]], pdf["size"].astype(int).tolist())
    bits = [int((x.astype(np.int64) << np.arange(len(x))).sum()) for x in found]
    return pd.DataFrame({"key": pdf["key"], "content": pdf["content"], "bits": np.array(bits, np.int64)})


def _contents(frames):
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            out += [(u["key"], u["content"], u["size"], r.text[u["start"]:u["start"] + u["size"] - 1 + LENGTH]) for u in r.wanted]
        yield pd.DataFrame(out, columns=["key", "content", "size", "bytes"])


def _cut(frames):
    """Spans and the hash of what stays, per text."""
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            edge = np.zeros(len(r.text) + 1, np.int64)
            for u in r.found:
                p = u["start"] + np.flatnonzero((u["bits"] >> np.arange(u["size"])) & 1)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            change = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
            kept = np.frombuffer(r.text, np.uint8)[~gone].tobytes()
            out.append((r.h1, r.h2, int(gone.sum()), [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)], hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=["h1", "h2", "n_removed", "spans", "kept_sha256"])


_SPANS = "array<struct<start:int,end:int>>"


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs of bytes), ``kept_sha256``.

    Texts are UTF-8 bytes; strings never cross texts. Null and empty texts and
    those shorter than LENGTH bytes lose nothing. Equal texts, also in
    repeated rows, are copies of each other and go whole if they are long
    enough. Null ids stay as they are; other columns are not read. An empty
    table gives no rows.
    """
    text = keyed_text(docs, id_col, text_col)
    rows = saved(shared_items(text, _extract, _META, _runs, "id long, n long, h1 long, h2 long, sha string, runs binary"))
    # each distinct text that may hold a repeat, once
    one = rows.where("runs is not null").groupBy("h1", "h2").agg(F.min("id").alias("one"), F.first("runs").alias("runs"))
    keyed = text.select("__id", F.col("__bytes").alias("text"), F.xxhash64("__bytes").alias("h1"), F.xxhash64("__bytes", "__bytes").alias("h2"))
    texts = saved(keyed.join(one, ["h1", "h2"]).where(F.col("__id").eqNullSafe(F.col("one"))).dropDuplicates(["h1", "h2"]).select("h1", "h2", "text", "runs"))
    unit = saved(texts.mapInPandas(_unit_rows, "h1 long, h2 long, start int, size int, key long, content long"))

    content = saved(unit.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2", "start", "size")).alias("at")))
    open_keys = content.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("key")
    wanted = content.join(open_keys, "key").select("at.h1", "at.h2", F.struct("key", "content", "at.size", "at.start").alias("u")) \
        .groupBy("h1", "h2").agg(F.collect_list("u").alias("wanted"))
    parts = PARTS_PER_PARTITION * width(docs.sparkSession)
    bits = texts.select("h1", "h2", "text").join(wanted, ["h1", "h2"]).mapInPandas(_contents, "key long, content long, size long, bytes binary") \
        .groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).applyInPandas(lambda part, pdf: _decide(pdf), "key long, content long, bits long")
    # equal contents: every place is repeated; others: as the sort has decided; alone with its key: none
    status = content.where("n > 1").select("key", "content", F.lit(-1).cast("long").alias("bits")).union(
        bits.join(content.where("n = 1").select("key", "content"), ["key", "content"]).where("bits <> 0").select("key", "content", "bits"))
    found = unit.join(status, ["key", "content"]).select("h1", "h2", F.struct("start", "size", "bits").alias("u")) \
        .groupBy("h1", "h2").agg(F.collect_list("u").alias("found"))
    cut = texts.select("h1", "h2", "text").join(found, ["h1", "h2"]).mapInPandas(_cut, f"h1 long, h2 long, n_removed long, spans {_SPANS}, kept_sha256 string")

    copies = rows.where(f"n >= {LENGTH}").groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1")
    none = F.array().cast(_SPANS)
    whole = F.col("copies").isNotNull()
    return rows.drop("runs").join(copies, ["h1", "h2"], "left").join(cut, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
