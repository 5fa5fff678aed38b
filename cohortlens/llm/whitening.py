"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers on a fixed grid, so counts, sums and deviations are
exact and equal vectors are found by their bytes. The fit list holds each
distinct vector once, in blocks of rows; Y is that list, centred and divided
by sqrt(n), so that YᵀY is its covariance. The method alternates Yv and Yᵀu: each
step is one pass over the blocks, whose tasks return a few sums of the size of
one vector. u is never stored: u = Yp for a p that the driver knows, so tasks
make the earlier u anew and every new one is orthogonalised against all of
them, as every v is on the driver. An upper bidiagonal matrix with as many
columns as a vector has entries remains; its SVD gives components and
deviations.

All columns are taken, not only those until the leading ones settle: then
repeated eigenvalues are found too. The number of passes is the vectors' number
of entries, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import saved
from cohortlens.session import ship_package

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Vectors in a block of the fit list.
BLOCK = 2048
_WIDTHS = ((2, 1 << 15), (4, 1 << 31), (8, 1 << 62))
OUT = "{id} long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _grid(scale: int):
    """Vectors as bytes: a width (2, 4 or 8), then floor(scale * entry) as little-endian integers of the least width that holds them all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * values)
            big = np.abs(x)
            first = np.cumsum(size) - size
            keys: list = [None] * len(size)
            for d in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == d)
                at = first[rows][:, None] + np.arange(d)
                most = big[at].max(axis=1)      # NaN where an entry is
                for width, limit in _WIDTHS:
                    fits = most < limit
                    some = x[at[fits]].astype(f"<i{width}")
                    for i, v in zip(rows[fits].tolist(), some, strict=True):
                        keys[i] = bytes([width]) + v.tobytes()
                    rows, at, most = rows[~fits], at[~fits], most[~fits]
            keep = pa.array([k is not None for k in keys])
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), pa.array(keys, pa.binary())], names=["id", "dims", "key"])
            yield out.filter(keep)

    return run


def _ints(keys: list[bytes], dims: int) -> np.ndarray:
    """The integers of ``keys``, a row each."""
    x = np.empty((len(keys), dims), np.int64)
    width = np.fromiter((k[0] for k in keys), np.int64, len(keys))
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        x[rows] = np.frombuffer(b"".join(keys[i][1:] for i in rows), f"<i{w}").reshape(len(rows), dims)
    return x


def _blocks(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            for i in range(0, len(keys), BLOCK):
                x = _ints(keys[i:i + BLOCK], dims)
                most = int(np.abs(x).max())
                width = next(w for w, limit in _WIDTHS if most < limit)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([width]), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())], names=["n", "width", "x"])

    return run


def _unpacked(pdf: pd.DataFrame, dims: int) -> Iterator[np.ndarray]:
    for width, x in zip(pdf["width"], pdf["x"], strict=True):
        yield np.frombuffer(x, f"<i{width}").astype(np.int64).reshape(-1, dims)


def _from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where that holds it, else Python's integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _totals(fit: DataFrame, function, names: int) -> np.ndarray:
    """Sums over all blocks of the ``names`` numbers that ``function`` gives for a block; added up in each task, then by Spark."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(names)
        for pdf in frames:
            for values in function(pdf):
                total += values
        yield pd.DataFrame({"i": np.arange(names), "v": total})

    out = np.zeros(names)
    for r in fit.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():   # ``names`` rows
        out[r["i"]] = r["v"]
    return out


def _moments(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows of the fit list and its exact sums per entry."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, [0] * dims
        for pdf in frames:
            for x in _unpacked(pdf, dims):
                n += len(x)
                part = x.sum(axis=0) if int(np.abs(x).max()) < 1 << 50 else x.astype(object).sum(axis=0)
                sums = [a + int(b) for a, b in zip(sums, part, strict=True)]
        yield pd.DataFrame({"i": range(-1, dims), "v": [Decimal(v) for v in (n, *sums)]})

    got = {r["i"]: int(r["v"]) for r in fit.mapInPandas(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(dims)]


def bidiagonalise(passed, dims: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(B, V): the bidiagonal matrix and the orthonormal right vectors, a column each, for the matrix Y behind ``passed``.

    ``passed(q, P)`` returns (|w|², Yᵀw, (YP)ᵀw) for w = Yq. A v in Y's null space
    gets no u; where the recurrence ends, it goes on from a random vector
    that is orthogonal to all before.
    """
    rng = np.random.default_rng(seed)
    V = np.zeros((dims, 0))
    P, Z = np.zeros((dims, 0)), np.zeros((dims, 0))     # u_k = Y P[:, k], Z[:, k] = Yᵀ u_k
    columns: list[dict[int, float]] = []

    def orthogonal(r):
        for _ in range(2):
            r = r - V @ (V.T @ r)
        return r

    def fresh():
        r = orthogonal(rng.standard_normal(dims))
        return r / np.linalg.norm(r)

    v, beta, largest = fresh(), 0.0, 0.0
    while True:
        V = np.column_stack([V, v])
        q = v - beta * P[:, -1] if beta else v
        norm2, z, c = passed(q, P)
        alpha = float(np.sqrt(max(0.0, norm2 - c @ c)))
        largest = max(largest, alpha, beta)
        column = {P.shape[1] - 1: beta} if beta else {}
        least = dims * np.finfo(float).eps * largest
        r = None
        if alpha > least:
            column[P.shape[1]] = alpha
            P, Z = np.column_stack([P, (q - P @ c) / alpha]), np.column_stack([Z, (z - Z @ c) / alpha])
            r = orthogonal(Z[:, -1] - alpha * v)
        columns.append(column)
        if V.shape[1] == dims:
            break
        beta = float(np.linalg.norm(r)) if r is not None else 0.0
        if beta > least:
            v = orthogonal(r / beta)
            v /= np.linalg.norm(v)
        else:
            v, beta = fresh(), 0.0
    B = np.zeros((P.shape[1], dims))
    for k, column in enumerate(columns):
        for i, value in column.items():
            B[i, k] = value
    return B, V


def _passes(fit: DataFrame, dims: int, n: int, sums: list[int]):
    """``passed`` of ``bidiagonalise`` over the blocks of the fit list."""
    def passed(q: np.ndarray, P: np.ndarray):
        k = P.shape[1]
        both = np.column_stack([q, P])

        def sums_of(pdf):
            for x in _unpacked(pdf, dims):
                y = _from_mean(x, n, sums).astype(np.float64) / (n * np.sqrt(n))
                wu = y @ both
                w = wu[:, 0]
                yield np.concatenate([[w @ w], w @ y, w @ wu[:, 1:]])

        out = _totals(fit, sums_of, 1 + dims + k)
        return out[0], out[1:1 + dims], out[1 + dims:]

    return passed


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``id_col``, ``component`` (from 1, by falling variance), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries are taken as floor(scale * entry); a constant added to all of them
    (SHIFT in the contract) changes no column. The covariance is that of the
    distinct vectors. ``deviation`` is exact, null where it exceeds a long.
    Dropped: null and empty vectors, vectors with null or non-finite entries
    or with one whose integer exceeds 2**62, and vectors of another length than the most
    frequent (ties: the longest). Components without variance have no rows, so
    a table with fewer than two distinct vectors gives none, nor does an empty
    one. Null ids, ties and repeated rows stay; other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    out = OUT.format(id=id_col)
    rows = saved(vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
                 .mapInArrow(_grid(scale), "id long, dims int, key binary"))
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], out)
    dims = common["dims"]
    rows = rows.where(F.col("dims") == dims)
    fit = saved(rows.select("key").distinct().mapInArrow(_blocks(dims), "n long, width long, x binary")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, sums = _moments(fit, dims)
        B, V = bidiagonalise(_passes(fit, dims, n, sums), dims)
        _, s, right = np.linalg.svd(B, full_matrices=False)
        e = s * s
        e, comps = e[e > dims * np.finfo(float).eps * e.max(initial=0)], V @ right.T
        k, trace = min(components, len(e)), float(e.sum())
        if not k:
            return spark.createDataFrame([], out)
        project = comps[:, :k] / np.sqrt(e[:k])

        def products(pdf):
            for x in _unpacked(pdf, dims):
                w = _from_mean(x, n, sums).astype(np.float64) / n @ project
                yield np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        total = _totals(fit, products, k + k * k)
        mean = total[:k] / n
        error = float(np.abs(total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    finally:
        fit.unpersist()
    share = e[:k] / trace

    def project_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                m = part.num_rows
                t = _from_mean(_ints(part.column(1).to_pylist(), dims), n, sums)
                if t.dtype == object or dims * int(np.abs(t).max()) ** 2 >= 1 << 63:
                    squares = (t.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(v) if v < 1 << 63 else None for v in squares], pa.int64())
                else:
                    deviation = pa.array((t * t).sum(axis=1))
                w = t.astype(np.float64) / n @ project
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                     deviation.take(each), pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "key").mapInArrow(project_rows, out)
