"""Spelling variants of a corpus's words by search schemes over an FM-index.

Words that differ by one inserted, deleted or replaced code point share a half: the
error lies in the second half of one, and the first halves are equal, or the
other way round. The two schemes of the bidirectional index follow: match
the first half exactly and extend to the right with one error, or match the
second half exactly and extend to the left. Halves begin or end at a word's
delimiter, so each scheme runs over one direction's suffix ranks: extending
words to the right is backward search over the reversed words, extending them
to the left is backward search over the words. A near word that shares the
first half belongs to the first scheme only, so no pair is found twice.

The vocabulary is dealt out by what a scheme matches exactly: a word goes to
the key of (length, exact part) of each length that its near words may have.
A key that holds too many words is split like the word was: the open middle
has two halves again, and one of them is equal. So a third of all words with
one beginning spreads over many tasks, and every task indexes few words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import keyed_text, saved, slices
from cohortlens.session import ship_package

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is at least this many times as frequent as its variant.
TIMES = 5
#: Words of one key in one task at most (as long as the key can be split), and words in an index on average.
KEY_WORDS, BUCKET_WORDS = 20_000, 60_000
#: Words that a task counts before it hands its counts on, and queries that a task searches at a time.
COUNTED, CHUNK = 200_000, 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, misspell: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points in all texts, and how often they occur.

    Words are the maximal runs of [A-Za-z\\u00C0-\\u00FF], with A-Z lower-cased. With
    ``misspell`` a run loses a code point wherever it divides the crc32 of
    "<id>:<run>", for planting variants whose origin is known. A null text has
    no words, a null id reads as an empty one, bytes that are not UTF-8 count as
    U+FFFD.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for ids, texts in slices(batches):
            for i, t in zip(ids, texts, strict=True):
                head = zlib.crc32(b"%d:" % i if i is not None else b":")
                for w, k in Counter(_RUN.findall(t.translate(_LOWER).decode("utf-8", "replace"))).items():
                    if len(w) < min_length:
                        continue
                    if misspell:
                        h = zlib.crc32(w.encode(), head)
                        if h % misspell == 0:
                            w = w[:h % len(w)] + w[h % len(w) + 1:]
                            if len(w) < min_length:
                                continue
                    total[w] += k
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class FMIndex:
    """Suffix ranks of words that are extended to the right, a code point at a time.

    The text is every reversed word with its delimiter. ``lo`` and ``hi`` bound
    the suffixes that begin with the reversed part matched so far; a
    delimiter is smaller than any code point, and delimiters rank by word.
    """

    def __init__(self, words: list[str]):
        n = len(words)
        flat = np.frombuffer("".join(w[::-1] + "\0" for w in words).encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(flat, return_inverse=True)     # 0: the delimiter
        size = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + n - 1
        rank[ends] = np.arange(n)
        span = 1
        order = np.argsort(rank, kind="stable")
        while True:
            s = rank[order]
            new = np.empty(size, np.int64)
            new[order] = np.r_[0, np.cumsum(s[1:] != s[:-1])]
            if new[order[-1]] == size - 1:
                break
            rank = new * (size + 1) + new[np.minimum(np.arange(size) + span, size - 1)]
            span *= 2
            order = np.argsort(rank, kind="stable")
        self.size, self.n = size + 1, n
        self.bwt = text[order - 1].astype(np.int64)     # before a word's first place stands a delimiter
        by = np.argsort(self.bwt, kind="stable")
        self.steps = self.bwt[by] * self.size + by
        self.word = np.searchsorted(ends, order[by[:n]])    # of the suffixes that are whole words, by rank
        self.whole = np.r_[0, np.cumsum(self.bwt == 0)]

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' places in the alphabet, end to end, and where each begins."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        return np.searchsorted(self.alphabet, flat), np.cumsum(size) - size

    def extend(self, lo, hi, c):
        """The interval of the matched part and then ``c``."""
        return np.searchsorted(self.steps, c * self.size + lo), np.searchsorted(self.steps, c * self.size + hi)

    def children(self, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which, c, lo, hi) of every code point that follows the part matched by each interval."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        c = self.bwt[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
        seen = np.unique(which * self.size + c)
        seen = seen[seen % self.size != 0]
        which, c = seen // self.size, seen % self.size
        return which, c, *self.extend(lo[which], hi[which], c)


def one_error(index: FMIndex, queries: list[str], first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) pairs at one error: it lies after a query's ``first`` code points and before its last ``rest``, all of which match exactly."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    codes, start = index.codes(queries)
    codes = np.r_[codes, -1]       # read, never used, at a last word's end
    length = np.fromiter(map(len, queries), np.int64, len(queries))
    last = length - rest

    def finish(q, p, lo, hi):
        """Match the remaining code points exactly, to a word's end."""
        while len(q):
            done = p == length[q]
            w = index.whole[lo[done]]
            hit = w < index.whole[hi[done]]
            found.append((q[done][hit], index.word[w[hit]]))
            q, p, lo, hi = (x[~done] for x in (q, p, lo, hi))
            lo, hi = index.extend(lo, hi, codes[start[q] + p])
            alive = lo < hi
            q, p, lo, hi = q[alive], p[alive] + 1, lo[alive], hi[alive]

    for at in range(0, len(queries), CHUNK):
        q = np.arange(at, min(at + CHUNK, len(queries)))
        lo, hi, p = np.zeros(len(q), np.int64), np.full(len(q), index.n), np.zeros(len(q), np.int64)
        while (more := np.flatnonzero(p < first[q])).size:
            lo[more], hi[more] = index.extend(lo[more], hi[more], codes[start[q[more]] + p[more]])
            p[more] += 1
        while len(q):
            node, of = np.unique(np.column_stack([lo, hi]), axis=0, return_inverse=True)
            which, c, clo, chi = index.children(node[:, 0], node[:, 1])
            begin = np.searchsorted(which, np.arange(len(node) + 1))
            count = (begin[1:] - begin[:-1])[of]
            each = np.repeat(np.arange(len(q)), count)
            child = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[of], count)
            inside = p < last[q]
            here, after = codes[start[q] + p], codes[np.minimum(start[q] + p + 1, len(codes) - 1)]
            same = inside[each] & (c[child] == here[each])
            k, x = each[~same], child[~same]        # insertions; before an equal code point they are the same as behind it
            finish(q[k], p[k], clo[x], chi[x])
            k, x = each[inside[each] & ~same], child[inside[each] & ~same]      # replacements
            finish(q[k], p[k] + 1, clo[x], chi[x])
            k = np.flatnonzero(inside & ~((p + 1 < last[q]) & (here == after)))    # deletions; of equal code points, the last
            finish(q[k], p[k] + 1, lo[k], hi[k])
            x = child[same]
            q, p, lo, hi = q[each[same]], p[each[same]] + 1, clo[x], chi[x]
    q, w = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (list(zip(*found, strict=True)) or ((), ())))
    return q, w


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """The number of near words and the best one of every query of a bucket; its rows extend their words the same way."""
    to_left = bool(pdf["to_left"].iloc[0])
    counts = dict(zip(pdf["word"], pdf["n"], strict=True))
    words = list(counts)
    index = FMIndex([w[::-1] for w in words] if to_left else words)
    asked = pdf[pdf["word"].str.len() == pdf["size"]].reset_index(drop=True)
    query, i, j, x = asked["word"].tolist(), asked["i"].to_numpy(np.int64), asked["j"].to_numpy(np.int64), asked["x"].to_numpy(np.int64)
    q, w = one_error(index, [v[::-1] for v in query] if to_left else query, j if to_left else i, i if to_left else j)
    best: list = [None] * len(query)
    n_near = np.zeros(len(query), np.int64)
    for a, b in zip(q.tolist(), w.tolist(), strict=True):
        mine, near = query[a], words[b]
        if x[a] and near[:x[a]] == mine[:x[a]]:
            continue        # the other scheme's
        n_near[a] += 1
        rank = (-counts[near], near)
        if best[a] is None or rank < best[a]:
            best[a] = rank
    return pd.DataFrame({"word": pd.Series(query, dtype=object), "n": asked["n"].to_numpy(np.int64), "n_near": n_near,
                         "form": pd.Series([b and b[1] for b in best], dtype=object), "form_n": pd.array([b and -b[0] for b in best], "Int64")})


def _key(size: Column, i: Column, j: Column) -> Column:
    word = F.col("word")
    return F.xxhash64(size, i, j, F.substring(word, F.lit(1), i), F.when(j > 0, F.substring(word, F.length(word) - j + 1, j)).otherwise(""))


def _dealt(vocabulary: DataFrame, min_length: int) -> DataFrame:
    """Each word under the keys of both schemes for its own length (as query and indexed) and one less and more (indexed only)."""
    size = F.explode(F.expr(f"filter(array(length(word) - 1, length(word), length(word) + 1), s -> s >= {min_length})")).alias("size")
    half = F.floor(F.col("size") / 2).cast("int")
    zero = F.lit(0)
    schemes = F.explode(F.array(F.struct(half.alias("i"), zero.alias("j"), zero.alias("x")), F.struct(zero.alias("i"), (F.col("size") - half).alias("j"), half.alias("x"))))
    rows = vocabulary.select("word", "n", size).select("*", schemes.alias("s")).select("word", "n", "size", "s.i", "s.j", "s.x")
    return rows.withColumn("key", _key(F.col("size"), F.col("i"), F.col("j")))


def _split(rows: DataFrame) -> DataFrame:
    """The rows under longer keys: the first or the second half of what was open matches too."""
    i, j, x = F.col("i"), F.col("j"), F.col("x")
    middle = F.col("size") - i - j
    front = F.floor(middle / 2).cast("int")
    parts = F.explode(F.array(F.struct((i + front).alias("i"), j.alias("j"), x.alias("x")), F.struct(i.alias("i"), (j + middle - front).alias("j"), (i + front).alias("x"))))
    return rows.select("word", "n", "size", parts.alias("s")).select("word", "n", "size", "s.i", "s.j", "s.x").withColumn("key", _key(F.col("size"), F.col("i"), F.col("j")))


def near_words(vocabulary: DataFrame, min_length: int = MIN_LENGTH, key_words: int = KEY_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n): how many words of ``vocabulary`` (word, n; distinct, of ``min_length`` code points or more) are near, and the one of largest n (ties: smallest)."""
    rows, parts = saved(_dealt(vocabulary, min_length)), []
    while True:
        hot = saved(rows.groupBy("key").agg(F.count("*").alias("k"), F.max(F.col("size") - F.col("i") - F.col("j")).alias("open"))
                    .where((F.col("k") > key_words) & (F.col("open") > 1)).select("key"))
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, "key", "left_anti"))
        rows = saved(_split(rows.join(hot, "key", "left_semi")))
    dealt = parts[0]
    for p in parts[1:]:
        dealt = dealt.unionByName(p)
    buckets = -(-sum(p.count() for p in parts) // bucket_words) or 1
    dealt = dealt.withColumn("to_left", F.col("j") > F.col("i")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    found = dealt.groupBy("bucket", "to_left").applyInPandas(_search, "word string, n long, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))).alias("best")
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", "best.form", (-F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms of each word of ``links`` (word, form) ends; every round doubles the steps taken."""
    at = saved(links.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = saved(at.select("word", "root").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, misspell: int = 0, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words (see ``word_counts``) have at least ``min_length`` (6 or more: a half
    has three code points) code points and ``min_count`` occurrences.
    ``form`` is the near word of largest n (ties: the smallest in code-point
    order) if it is at least ``times`` as frequent, and ``root`` the end of the
    chain of forms, the word itself if it has none. Counts rise along a chain,
    so it ends. Null and empty texts have no words; null ids, ties and
    repeated rows count as they stand; very long words are indexed whole; an
    empty table gives no rows; other columns are not read.
    """
    ship_package(docs.sparkSession)
    vocabulary = saved(word_counts(docs, min_length, misspell, id_col, text_col).where(F.col("n") >= min_count))
    near = saved(near_words(vocabulary, min_length))
    good = F.col("form_n") >= times * F.col("n")
    near = near.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    end = roots(near.where("form is not null"))
    return near.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
