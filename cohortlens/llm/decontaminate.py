"""Benchmark decontamination by CGK embedding and bit sampling.

A document is contaminated by an item if some window of its words is within
MAX_EDITS of the item's length in word edits of the item.

The random walk of Chakraborty, Goldenberg and Koucky (STOC 2016) turns edit
distance into Hamming distance: it copies the current word to each of 3n
output places and moves on or stays by a random bit of (place, word). Windows
of each item's size are embedded by WALKS walks; each walk is sampled
SAMPLES times at BITS places, and a window meets the items of its size that
share a sample. What meets is verified by the exact edit distance, with the
window's ends free by that many words.

Windows are not taken at every word: within MAX_EDITS of an item, a window
shares an n-gram with it at a known place (n - q + 1 - q * edits of them are
left whole for q-grams, and q is chosen per item so that this is positive).
So only windows that start where a shared q-gram says are embedded, and none
that could verify is left out by it. A window may start before its text, where
an item's first words are missing: their places count as words of no item.

The benchmark goes to the tasks as a broadcast of at most BLOCK_BYTES; a larger
one is searched block by block, each against all documents.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import held, keyed_text, saved, slices
from cohortlens.llm.words import mix

MAX_EDITS, MIN_ITEM_WORDS, GRAM = 0.2, 6, 3
#: Share of places that agree for a window at the largest distance, from the recall test; the number of samples follows from it.
AGREEMENT, BITS, SAMPLES, RECALL = 0.7, 6, 4, 0.999
WALKS = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREEMENT**BITS) / SAMPLES)
BLOCK_BYTES = 16 << 20
#: A-Z lower-cased; ASCII characters other than letters and digits part words.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
_MATCHES = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def edits(n: int) -> int:
    return int(MAX_EDITS * n)


def gram_size(n: int) -> int:
    """The largest q-gram, up to GRAM, of which an item of n words keeps one whole under its edits."""
    return next(q for q in range(GRAM, 0, -1) if q == 1 or n - q + 1 - q * edits(n) > 0)


def embed(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """The places of one walk over windows of ``symbols``: a row per window, 3 * the largest size places; 0 past a window's end."""
    places = 3 * int(sizes.max())
    out = np.zeros((len(starts), places), np.uint64)
    at = np.zeros(len(starts), np.int64)
    for j in range(places):
        inside = at < sizes
        now = np.where(inside, symbols[np.minimum(starts + at, len(symbols) - 1)], np.uint64(0))
        out[:, j] = now
        at += (mix(now ^ np.uint64((walk * 1_000_003 + j) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(63)).astype(np.int64)
    return out


@lru_cache(maxsize=None)
def _chosen(n: int, walk: int, sample: int) -> np.ndarray:
    """The places of a window of n words that a sample looks at."""
    return np.random.default_rng((walk, sample, n)).choice(3 * n, min(BITS, 3 * n), replace=False)


def keys_of(symbols: np.ndarray, windows: dict[int, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, sample number, a key per window) of all walks and samples over windows given as starts by size."""
    sizes = np.repeat(list(windows), [len(x) for x in windows.values()])
    starts = np.concatenate(list(windows.values()))
    for walk in range(WALKS):
        places = embed(symbols, starts, sizes, walk)
        at = 0
        for n, own in windows.items():
            rows = places[at:at + len(own)]
            at += len(own)
            for s in range(SAMPLES):
                key = np.full(len(own), walk * SAMPLES + s, np.uint64)
                for j in _chosen(n, walk, s):
                    key = mix(key ^ rows[:, j])
                yield n, walk * SAMPLES + s, key


def edit_distance(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``text`` nearest to ``item``, or None beyond ``most``; the first and shortest of equals."""
    row = [(0, j) for j in range(len(text) + 1)]
    for i, x in enumerate(item, 1):
        new = [(i, 0)]
        for j, y in enumerate(text, 1):
            d, s = row[j - 1]
            best = (d + (x != y or x == 0), s)
            if row[j][0] + 1 < best[0]:
                best = (row[j][0] + 1, row[j][1])
            if new[-1][0] + 1 < best[0]:
                best = (new[-1][0] + 1, new[-1][1])
            new.append(best)
        row = new
        if min(row)[0] > most:
            return None
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return (row[end][0], row[end][1], end) if row[end][0] <= most else None


class Items:
    """A block of the benchmark: words, q-grams and samples of its items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, w) for i, t in items if len(w := item_words(t)) >= MIN_ITEM_WORDS]
        self.numbers: dict[bytes, int] = {}
        self.ids, self.words = [], []
        grams = defaultdict(lambda: defaultdict(set))
        for at, (i, words) in enumerate(self.items):
            w = [self.numbers.setdefault(x, len(self.numbers) + 1) for x in words]
            self.ids.append(i)
            self.words.append(w)
            q = gram_size(len(w))
            for o in range(len(w) - q + 1):
                grams[q][tuple(w[o:o + q])].add((o, len(w)))
        self.grams = {}
        for q, found in grams.items():
            key = self._gram_keys(np.array(list(found), np.uint64).reshape(-1, q))
            order = np.argsort(key)
            self.grams[q] = key[order], [sorted(v) for v in (list(found.values())[k] for k in order)]
        by_size = defaultdict(list)
        start = np.cumsum([0, *map(len, self.words)])
        for at, w in enumerate(self.words):
            by_size[len(w)].append(at)
        self.samples: dict[tuple[int, int], dict[int, list[int]]] = {}
        if self.words:
            flat = np.array([x for w in self.words for x in w], np.uint64)
            for n, s, key in keys_of(flat, {n: start[ats] for n, ats in by_size.items()}):
                table = defaultdict(list)
                for at, k in zip(by_size[n], key.tolist(), strict=True):
                    table[k].append(at)
                self.samples[n, s] = dict(table)

    @staticmethod
    def _gram_keys(rows: np.ndarray) -> np.ndarray:
        key = np.full(len(rows), rows.shape[1], np.uint64)
        for j in range(rows.shape[1]):
            key = mix(key ^ rows[:, j])
        return key

    def windows(self, symbols: np.ndarray) -> dict[int, np.ndarray]:
        """Window starts by item size, from the q-grams that the text shares with items of that size; less than an item's size before a text's first word at least."""
        found = defaultdict(set)
        known = symbols > 0
        for q, (keys, places) in self.grams.items():
            if len(symbols) < q:
                continue
            run = known[:len(symbols) - q + 1].copy()
            for j in range(1, q):
                run &= known[j:len(symbols) - q + 1 + j]
            at = np.flatnonzero(run)
            if not len(at):
                continue
            key = self._gram_keys(np.stack([symbols[at + j] for j in range(q)], 1))
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            for p, g in zip(at[hit].tolist(), i[hit].tolist(), strict=True):
                for o, n in places[g]:
                    found[n].add(p - o)
        return {n: np.array(sorted(s), np.int64) for n, s in found.items()}

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text, (item_id, first word, end, edits) of the verified windows, the best of those that overlap."""
        number, most = self.numbers.get, max(map(len, self.words), default=0)
        gap = 2 * most  # windows that start up to ``most`` words before a text, or end as many after it, hold no words of another one
        parts, base, size = [np.zeros(gap, np.uint64)], [], gap
        for t in texts:
            w = np.fromiter((number(x, 0) for x in item_words(t)), np.uint64)
            base.append(size)
            parts += [w, np.zeros(gap, np.uint64)]
            size += len(w) + gap
        symbols = np.concatenate(parts)
        first, length = np.array(base, np.int64) - most, np.array([len(p) for p in parts[1::2]], np.int64)
        found: dict[tuple[int, int], dict] = defaultdict(dict)
        pairs = set()
        if windows := self.windows(symbols):
            for n, sample, key in keys_of(symbols, windows):
                table = self.samples[n, sample]
                starts = windows[n]
                pairs.update((int(starts[i]), at) for i, k in enumerate(key.tolist()) if k in table for at in table[k])
        for start, at in sorted(pairs):
            item = self.words[at]
            n = len(item)
            doc, e = int(np.searchsorted(first, start, side="right")) - 1, edits(n)
            if start + n <= base[doc] + length[doc] and symbols[start:start + n].tolist() == item:
                found[doc, at][start - base[doc], start + n - base[doc]] = 0
                continue
            low, high = max(start - e, base[doc]), min(start + n + e, base[doc] + int(length[doc]))
            if high > low and (got := edit_distance(item, symbols[low:high].tolist(), e)):
                d, a, b = got
                found[doc, at][low + a - base[doc], low + b - base[doc]] = d
        out: list[list] = [[] for _ in texts]
        for (doc, at), spans in found.items():
            taken: list[tuple[int, int]] = []
            for (a, b), d in sorted(spans.items(), key=lambda x: (x[1], x[0])):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    out[doc].append((self.ids[at], a, b, d))
        return [sorted(x) for x in out]


def _searched(text: DataFrame, block: list[tuple[int, bytes]]) -> DataFrame:
    key = hashlib.sha256(repr(block).encode()).hexdigest()
    shared = text.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held(("items", key), lambda: Items(shared.value))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        for ids, texts in slices(batches):
            hits = [[dict(zip(("item_id", "start", "end", "edits"), h, strict=True)) for h in x] for x in items.search(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, kind)], names=["__id", "matches"])

    return text.mapInArrow(run, f"__id long, matches {_MATCHES}")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``contaminated``, ``n_items``, ``item_ids`` (sorted), ``matches`` (item, words from and to, edits).

    Words are split at white space and ASCII punctuation, A-Z lower-cased. An
    item matches where a part of the text is within 20 % of the item's words
    in word edits. Items that are null or have fewer than MIN_ITEM_WORDS words
    are too short to tell a leak from chance and are not searched; an item
    without an id is reported as null. Equal items all match. A null or empty
    text has no matches; null ids and repeated rows stay as they are; other
    columns are not read. An empty table gives no rows, an empty benchmark no
    matches.
    """
    items = benchmark.where(benchmark[item_text_col].isNotNull()).select(
        benchmark[item_id_col].cast("long").alias("i"), benchmark[item_text_col].cast("string").cast("binary").alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-int(size) // BLOCK_BYTES) or 1
    text = keyed_text(docs, id_col, text_col)

    def block(k):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        return [(r["i"], bytes(r["t"])) for r in part.collect()]  # bounded: BLOCK_BYTES on average

    if blocks == 1:
        rows = _searched(text, block(0))
    else:
        # rows meet their matches of all blocks by a hash of the id and the text
        row = F.xxhash64("__id", "__bytes")
        hits = None
        for k in range(blocks):
            found = saved(_searched(text.select(row.alias("__id"), "__bytes"), block(k)).where(F.size("matches") > 0).distinct())
            hits = found if hits is None else hits.union(found)
        hits = hits.groupBy("__id").agg(F.flatten(F.collect_list("matches")).alias("matches")).withColumnRenamed("__id", "__row")
        rows = text.select("__id", row.alias("__row")).join(hits, "__row", "left").select("__id", F.coalesce("matches", F.array().cast(_MATCHES)).alias("matches"))
    ids = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return rows.select(F.col("__id").alias(id_col), (F.size("matches") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"),
                       ids.alias("item_ids"), "matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """Rows of ``docs`` without a match, all columns. Rows that share an id (or have none) go together if one of them matches."""
    bad = contamination(docs, benchmark, id_col, **columns).where("contaminated").select(F.col(id_col).alias("__bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad")), "left_anti")
