"""Packing against the library and its own contract; whitening against NumPy's eigenvectors."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import packing, whitening

WORDS = public_tokenizers.path("word_bpe_49k.json")


def gapless(spans):
    at = 0
    for start, n in sorted(spans):
        assert start == at and n > 0
        at += n
    return at


@pytest.mark.parametrize("length", [2048, 100])
def test_packing(documents, rows, length):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    got = packing.pack_documents(documents, WORDS, length).collect()
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= length
        text = next(t for t in ids[r["doc_id"]] if len(t) == 4 * r["doc_tokens"])
        assert zlib.crc32(text[4 * r["start"]:4 * (r["start"] + r["length"])]) == zlib.crc32(r["ids"])
        by_document[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(t) // 4 for v in ids.values() for t in v)
    assert set(k for k, _ in by_document) == set(ids)
    for (k, n), spans in by_document.items():
        if len(ids[k]) == 1:
            assert gapless(spans) == n
    sizes = [gapless(by_sequence[i]) for i in range(len(by_sequence))]
    assert set(sizes[:-1]) == {length} and 0 < sizes[-1] <= length


def test_packing_of_few_rows(spark, documents):
    assert packing.pack_documents(documents.limit(0), WORDS).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"a \xff\xfe b")), (2, bytearray(b""))], "doc_id long, text binary").select("doc_id", F.col("text").cast("string").alias("text"))
    got = {r["doc_id"]: r for r in packing.pack_documents(bad, WORDS).collect()}
    expected = [*Tokenizer.from_file(WORDS).encode("a �� b", add_special_tokens=False).ids, 1]
    assert np.frombuffer(got[1]["ids"], "<u4").tolist() == expected and got[2]["length"] == 1


def test_offsets_over_many_partitions(spark):
    t = spark.range(0, 5000, 2).select(F.col("id").alias("part"), (F.col("id") % 7).alias("n")).repartition(6)
    got = sorted(tuple(r) for r in packing.offsets(t, group=64).collect())
    at = 0
    for part, before in got:
        assert before == at
        at += part % 7
    assert len(got) == 2500


def test_sequences_are_padded_but_at_powers_of_two(documents):
    pieces = packing.pack_documents(documents, WORDS, 1000).cache()
    got = packing.sequences(pieces, 1000, pad_id=7).collect()
    total = pieces.agg(F.sum("length")).first()[0]
    assert sum(r["n_tokens"] for r in got) == total and sum(sum(r["mask"]) for r in got) == total
    for r in got:
        assert len(r["ids"]) == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 1000)
        assert set(r["ids"][r["n_tokens"]:]) <= {7}
    few = pieces.where("doc_id = 10004").withColumn("offset", F.lit(0))
    assert len(packing.sequences(few, 1000).first()["ids"]) in (2, 4, 1000)


def expected(vectors):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    return x, fit, e[::-1], v[:, ::-1]


def check(got, vectors, k, tolerance=1e-9):
    x, fit, e, v = expected(vectors)
    n, sums = len(fit), fit.sum(axis=0)
    w = np.array([[r["whitened"] for r in sorted(g, key=lambda r: r["component"])] for g in got])
    assert w.shape == (len(vectors), k)
    reference = (x - sums / n) @ v[:, :k] / np.sqrt(e[:k])
    assert np.abs(w * np.sign((w * reference).sum(axis=0)) - reference).max() < tolerance
    for g, row in zip(got, x, strict=True):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        for r in g:
            assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)


def by_vector(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["vec_id"]].append(r)
    return out


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24)) * np.linspace(1, 3, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[5].tolist()) for i in range(200)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 22), (2003, [float("nan")] * 24), (2004, [float("inf")] + [0.0] * 23), (2005, [1.0, 2.0]), (2006, [1e300] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("component", F.lit("clash"))
    got = by_vector(whitening.whiten(df.repartition(7)))
    assert set(got) == {i for i, _ in rows}
    check([got[i] for i, _ in rows], [v for _, v in rows], 16)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id >= 1000")).count() == 0      # one distinct vector has no variance
    assert whitening.whiten(df.where("vec_id in (1, 2)")).select("component").distinct().count() == 1


def test_whitening_with_repeated_eigenvalues_and_low_rank(spark):
    corners = [[float(b >> i & 1) * 4 for i in range(5)] + [1.0] * 3 for b in range(32)]
    got = by_vector(whitening.whiten(spark.createDataFrame(list(enumerate(corners)), "vec_id long, embedding array<double>")))
    w = np.array([[r["whitened"] for r in sorted(got[i], key=lambda r: r["component"])] for i in range(32)])
    assert w.shape == (32, 5)          # three entries never change; five variances are equal
    assert np.abs(w.T @ w / 32 - np.eye(5)).max() < 1e-9
    assert got[0][0]["explained"] == pytest.approx(0.2)


def test_deviation_is_exact_with_large_entries(spark):
    rows = [(i, [float(i) * 3e12, float(i * i), float(i % 2) * 2.0**40]) for i in range(3)] + [(9, [-2.0**41, 1.0, 0.0])]
    got = by_vector(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    x = [[int(np.floor(64 * c)) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for (i, _), v in zip(rows, x, strict=True):
        d = sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert got[i][0]["deviation"] == (d if d < 1 << 63 else None)
