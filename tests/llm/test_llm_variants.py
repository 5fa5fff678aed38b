"""Spelling variants against brute force: the index, splitting of hot keys, chains, and whole tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def neighbours(words):
    """Near words of each word, by the words that one deletion leaves."""
    left = defaultdict(set)
    for w in words:
        for s in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            left[s].add(w)
    return {w: {v for s in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for v in left[s] if near(w, v)} for w in words}


def brute(counts, times=5):
    out = {}
    of = neighbours(counts)
    for w, n in counts.items():
        best = min(of[w], key=lambda v: (-counts[v], v), default=None)
        good = best is not None and counts[best] >= times * n
        out[w] = (best if good else None, n, len(of[w]), counts[best] if good else None)
    roots = {}
    for w in out:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        roots[w] = r
    return {w: (f, roots[w], n, k, fn) for w, (f, n, k, fn) in out.items()}


def word_counts(rows, every):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= 5}


@pytest.mark.parametrize("seed", range(8))
def test_search_schemes(seed):
    rng = random.Random(seed)
    words = list({"".join(rng.choice("abé") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(2, 150))})
    index = variants.FMIndex(words)
    for first, rest in ((0, 0), (1, 0), (2, 1)):
        q, w = variants.one_error(index, words, np.full(len(words), first), np.full(len(words), rest))
        got = sorted(zip(q.tolist(), w.tolist(), strict=True))
        expected = [(i, k) for i, a in enumerate(words) for k, b in enumerate(words)
                    if a[:first] == b[:first] and (not rest or a[-1] == b[-1]) and len(b) >= first + rest and near(a[first:len(a) - rest], b[first:len(b) - rest])]
        assert got == sorted(expected)


def test_variants(documents, rows):
    for every in (0, 7):
        expected = brute(word_counts([r[:2] for r in rows], every))
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.spelling_variants(documents, misspell=every).collect()}
        assert got == expected
    assert sum(v[0] is not None for v in expected.values()) >= 10
    assert variants.spelling_variants(documents.limit(0)).count() == 0


def test_hot_keys_are_split_without_loss(spark):
    rng = random.Random(5)
    words = {"common" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(900)}
    words |= {"".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) + "ending" for _ in range(300)} | {w[:2] + w[3:] for w in list(words)[:200]}
    counts = {w: rng.randint(5, 90) for w in words}
    of = neighbours(counts)
    expected = {w: (n, len(of[w]), min(of[w], key=lambda v: (-counts[v], v), default=None)) for w, n in counts.items()}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    for key_words, bucket_words in ((20, 100), (3, 40), (10_000, 10_000)):
        got = variants.near_words(table, key_words=key_words, bucket_words=bucket_words).collect()
        assert {r["word"]: (r["n"], r["n_near"], r["form"]) for r in got} == expected, key_words


def test_chains_end_at_their_root(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w4"), ("b", "c")]
    got = dict(map(tuple, variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {f"w{i}": "w13" for i in range(13)} | {"a": "w13", "b": "c"}
    assert variants.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_words_of_odd_texts(spark):
    long = "x" * 30_000
    rows = [(i, f"{long} ÉCOLES ecoles×s Straße {'y' + long}") for i in range(6)] + [(None, "straße Straße"), (7, None), (8, "")]
    got = {r["word"]: r for r in variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))).collect()}
    assert set(got) == {long, "y" + long, "École".upper()[0] + "coles", "ecoles×s", "straße"}
    assert got[long]["n_near"] == 1 and got["straße"]["n"] == 8
