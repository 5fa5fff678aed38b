"""Logistic GLMs fitted by distributed IRLS, with cluster-robust covariances
(F0-F5, M16, T12).

Each Newton/IRLS iteration is one aggregate pass: X'WX as p(p+1)/2 ``sum``
columns plus X'(y - mu) and the deviance, so the data never leave the
executors; the p x p solve happens on the driver. Firth's bias reduction
adds a second pass per iteration for the hat values h_i = w_i x_i' M x_i
(M = (X'WX)^-1 enters the expression as literals). Cluster-robust meat
matrices are aggregates too: per-cluster score sums (and, for CR2, per-cluster
Gram matrices) are grouped by cluster and their outer products summed by a
second aggregate - only p x p objects reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.stats import normal_two_sided_p


@dataclass
class GlmFit:
    names: list[str]          # all terms (aliased ones included, estimate NaN)
    kept: list[int]           # indices of estimable terms
    beta: np.ndarray          # estimates of kept terms
    bread: np.ndarray         # (X'WX)^-1 at the solution, kept terms
    iterations: int
    converged: bool
    n: int


def treatment_design(df: DataFrame, factors: list[tuple[str, list[str] | None]], numerics: list[str]):
    """Treatment-coded design: intercept, one 0/1 column per non-baseline level
    (first level = baseline; ``None`` -> sorted observed levels), then numerics.
    Returns (df with x columns, x column names, term names)."""
    cols, terms = [F.lit(1.0).alias("__x0")], ["(Intercept)"]
    for name, levels in factors:
        if levels is None:
            levels = sorted(r[0] for r in df.select(F.col(name).cast("string")).where(F.col(name).isNotNull())
                            .distinct().collect())   # factor levels: bounded
        if len(levels) < 2:
            raise ValueError(f"factor {name} has fewer than 2 levels")
        for lv in levels[1:]:
            cols.append((F.col(name).cast("string") == lv).cast("double").alias(f"__x{len(terms)}"))
            terms.append(f"{name}{lv}")
    for c in numerics:
        cols.append(F.col(c).cast("double").alias(f"__x{len(terms)}"))
        terms.append(c)
    xnames = [f"__x{i}" for i in range(len(terms))]
    return df.select("*", *cols), xnames, terms


def _eta(x: list[Column], beta: np.ndarray) -> Column:
    e = F.lit(0.0)
    for xc, b in zip(x, beta):
        e = e + F.lit(float(b)) * xc
    return e


def _quad(x: list[Column], M: np.ndarray) -> Column:
    """x' M x as a column expression (symmetric M)."""
    p = len(x)
    terms = []
    for j in range(p):
        terms.append(F.lit(float(M[j, j])) * x[j] * x[j])
        for k in range(j + 1, p):
            terms.append(F.lit(float(2.0 * M[j, k])) * x[j] * x[k])
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


WIDE_P = 40   # above this many columns the Gram matrix is summed from per-partition numpy blocks


def _gram_pass_blocks(d: DataFrame, x: list[Column], y: Column, beta: np.ndarray, extra: Column | None = None):
    """Wide designs: each partition forms X'WX, X'r and its deviance in numpy and
    emits them as (i, j, value) triples; one grouped sum adds the partitions
    (p^2 + p + 2 rows reach the driver, independent of the row count)."""
    p = len(x)
    cols = [xc.alias(f"__g{j}") for j, xc in enumerate(x)] + [y.cast("double").alias("__y")]
    if extra is not None:
        cols.append(extra.alias("__h"))
    src = d.select(*cols)
    has_h = extra is not None
    b = np.asarray(beta, dtype=float)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                           T.StructField("v", T.DoubleType())])

    def run(batches):
        G = np.zeros((p, p))
        s = np.zeros(p)
        dev, n = 0.0, 0
        for pdf in batches:
            X = pdf[[f"__g{j}" for j in range(p)]].to_numpy(dtype=float)
            yy = pdf["__y"].to_numpy(dtype=float)
            mu = 1.0 / (1.0 + np.exp(-(X @ b)))
            w = mu * (1.0 - mu)
            r = yy - mu
            if has_h:
                r = r + pdf["__h"].to_numpy(dtype=float) * (0.5 - mu)
            G += X.T @ (w[:, None] * X)
            s += X.T @ r
            eps = 1e-300
            dev += float(-2.0 * np.sum(yy * np.log(np.maximum(mu, eps)) + (1 - yy) * np.log(np.maximum(1 - mu, eps))))
            n += len(yy)
        ii, jj = np.triu_indices(p)
        rows = {"i": np.concatenate([ii, np.arange(p), [-1, -2]]).astype("int32"),
                "j": np.concatenate([jj, np.full(p, -1), [-1, -2]]).astype("int32"),
                "v": np.concatenate([G[ii, jj], s, [dev, float(n)]])}
        yield pd.DataFrame(rows)

    tot = src.mapInPandas(run, schema).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()   # p^2 rows
    G = np.zeros((p, p))
    s = np.zeros(p)
    dev, n = 0.0, 0
    for r in tot:
        i, j, v = r["i"], r["j"], r["v"]
        if i >= 0 and j >= 0:
            G[i, j] = G[j, i] = v
        elif i >= 0:
            s[i] = v
        elif i == -1:
            dev = v
        else:
            n = int(v)
    return G, s, dev, n


def _gram_pass(d: DataFrame, x: list[Column], y: Column, beta: np.ndarray, extra: Column | None = None):
    p = len(x)
    if p > WIDE_P:
        return _gram_pass_blocks(d, x, y, beta, extra)
    mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-_eta(x, beta)))
    d2 = d.select(*[xc.alias(f"__g{j}") for j, xc in enumerate(x)], y.cast("double").alias("__y"),
                  mu.alias("__mu"), *( [extra.alias("__h")] if extra is not None else []))
    xs = [F.col(f"__g{j}") for j in range(p)]
    w = F.col("__mu") * (F.lit(1.0) - F.col("__mu"))
    resid = F.col("__y") - F.col("__mu")
    if extra is not None:
        resid = resid + F.col("__h") * (F.lit(0.5) - F.col("__mu"))
    aggs = []
    for j in range(p):
        for k in range(j, p):
            aggs.append(F.sum(w * xs[j] * xs[k]).alias(f"g{j}_{k}"))
    aggs += [F.sum(xs[j] * resid).alias(f"s{j}") for j in range(p)]
    eps = F.lit(1e-300)
    dev = F.lit(-2.0) * (F.col("__y") * F.log(F.greatest(F.col("__mu"), eps))
                         + (F.lit(1.0) - F.col("__y")) * F.log(F.greatest(F.lit(1.0) - F.col("__mu"), eps)))
    aggs += [F.sum(dev).alias("dev"), F.count(F.lit(1)).alias("n")]
    r = d2.agg(*aggs).first()
    G = np.zeros((p, p))
    for j in range(p):
        for k in range(j, p):
            G[j, k] = G[k, j] = r[f"g{j}_{k}"] or 0.0
    s = np.array([r[f"s{j}"] or 0.0 for j in range(p)])
    return G, s, float(r["dev"] or 0.0), int(r["n"])


def _estimable(G: np.ndarray, tol: float = 1e-7) -> list[int]:
    """Columns kept in order; a column is aliased when its residual after
    projecting on earlier kept columns is tiny (like a pivoted QR)."""
    kept = []
    for j in range(G.shape[0]):
        if G[j, j] <= 0:
            continue
        if not kept:
            kept.append(j)
            continue
        A = G[np.ix_(kept, kept)]
        b = G[kept, j]
        resid = G[j, j] - b @ np.linalg.solve(A, b)
        if resid > tol * G[j, j]:
            kept.append(j)
    return kept


def fit_logistic(df: DataFrame, xnames: list[str], terms: list[str], y: str, firth: bool = False,
                 max_iter: int = 50, tol: float = 1e-10) -> GlmFit:
    """F0 (plain IRLS) / F1 (Firth-type bias reduction). Rows with nulls in the
    design or outcome must be dropped by the caller (P7)."""
    d = df.select(*xnames, F.col(y).cast("double").alias(y)).persist()
    x_all = [F.col(c) for c in xnames]
    G0, _, _, n = _gram_pass(d, x_all, F.col(y), np.zeros(len(xnames)))
    kept = _estimable(G0)
    x = [x_all[j] for j in kept]
    beta = np.zeros(len(kept))
    converged, it = False, 0
    prev = None   # (beta, objective, step) of the last accepted iterate
    halvings = 0
    for it in range(1, max_iter + 1):
        G, s, dev, _ = _gram_pass(d, x, F.col(y), beta)
        sign, logdet = np.linalg.slogdet(G)
        # objective: deviance, minus log|X'WX| for the Jeffreys-penalised (Firth) fit
        obj = dev - (logdet if (firth and sign > 0) else 0.0)
        if prev is not None and obj > prev[1] + 1e-9 * (1.0 + abs(prev[1])) and halvings < 20:
            halvings += 1                      # step-halving: retreat towards the last iterate
            half = prev[2] / (2.0 ** halvings)
            beta = prev[0] + half
            continue
        halvings = 0
        M = np.linalg.pinv(G)
        if firth:
            mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-_eta(x, beta)))
            h = mu * (F.lit(1.0) - mu) * _quad(x, M)
            _, s, _, _ = _gram_pass(d, x, F.col(y), beta, extra=h)
        step = M @ s
        prev = (beta.copy(), obj, step)
        beta = beta + step
        if np.max(np.abs(step)) < tol:
            converged = True
            break
    G, _, _, _ = _gram_pass(d, x, F.col(y), beta)
    d.unpersist()
    return GlmFit(list(terms), kept, beta, np.linalg.pinv(G), it, converged, n)


def _score_table(df: DataFrame, fit: GlmFit, xnames: list[str], y: str, cluster: str, with_gram: bool):
    """Per-cluster score sums (and Gram matrices): one row per cluster, distributed."""
    x = [F.col(xnames[j]) for j in fit.kept]
    p = len(x)
    mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-_eta(x, fit.beta)))
    d = df.select(F.col(cluster).alias("__cl"), *[xc.alias(f"__g{j}") for j, xc in enumerate(x)],
                  (F.col(y).cast("double") - mu).alias("__r"), (mu * (F.lit(1.0) - mu)).alias("__w"))
    aggs = [F.sum(F.col(f"__g{j}") * F.col("__r")).alias(f"s{j}") for j in range(p)]
    if with_gram:
        for j in range(p):
            for k in range(j, p):
                aggs.append(F.sum(F.col("__w") * F.col(f"__g{j}") * F.col(f"__g{k}")).alias(f"g{j}_{k}"))
    return d.groupBy("__cl").agg(*aggs)


def _outer_sum(table: DataFrame, cols: list[str]) -> np.ndarray:
    p = len(cols)
    aggs = []
    for j in range(p):
        for k in range(j, p):
            aggs.append(F.sum(F.col(cols[j]) * F.col(cols[k])).alias(f"o{j}_{k}"))
    aggs.append(F.count(F.lit(1)).alias("__G"))
    r = table.agg(*aggs).first()
    B = np.zeros((p, p))
    for j in range(p):
        for k in range(j, p):
            B[j, k] = B[k, j] = r[f"o{j}_{k}"] or 0.0
    return B, int(r["__G"])


def vcov_cluster_hc0(df: DataFrame, fit: GlmFit, xnames: list[str], y: str, cluster: str,
                     cadjust: bool = True) -> np.ndarray:
    """M (sum_g s_g s_g') M, times G/(G-1) (the usual small-cluster adjustment)."""
    t = _score_table(df, fit, xnames, y, cluster, with_gram=False)
    B, G = _outer_sum(t, [f"s{j}" for j in range(len(fit.kept))])
    V = fit.bread @ B @ fit.bread
    return V * (G / (G - 1.0)) if cadjust and G > 1 else V


def _inv_sqrt_sym(S: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    vals, vecs = np.linalg.eigh((S + S.T) / 2.0)
    inv = np.where(vals > eps, 1.0 / np.sqrt(np.clip(vals, eps, None)), 0.0)   # pseudo-inverse when singular
    return (vecs * inv) @ vecs.T


def vcov_cluster_cr2(df: DataFrame, fit: GlmFit, xnames: list[str], y: str, cluster: str) -> np.ndarray:
    """CR2 (bias-reduced linearisation). u_g = (I - G_g M)^(-1/2) s_g via the
    push-through identity (no n_g x n_g matrices); computed per cluster in
    ``mapInPandas`` over the distributed cluster table with M broadcast, then
    sum_g u_g u_g' is one more aggregate."""
    p = len(fit.kept)
    t = _score_table(df, fit, xnames, y, cluster, with_gram=True)
    M = fit.bread
    vals, vecs = np.linalg.eigh((M + M.T) / 2.0)
    Mh = (vecs * np.sqrt(np.clip(vals, 0, None))) @ vecs.T
    Mhi = (vecs * np.where(vals > 0, 1.0 / np.sqrt(np.clip(vals, 1e-300, None)), 0.0)) @ vecs.T
    bc = df.sparkSession.sparkContext.broadcast((Mh, Mhi))
    schema = T.StructType([T.StructField(f"u{j}", T.DoubleType()) for j in range(p)])

    def run(batches):
        Mh_, Mhi_ = bc.value
        for pdf in batches:
            out = np.zeros((len(pdf), p))
            for i, row in enumerate(pdf.itertuples(index=False)):
                rd = row._asdict()
                s = np.array([rd[f"s{j}"] for j in range(p)])
                Gg = np.zeros((p, p))
                for j in range(p):
                    for k in range(j, p):
                        Gg[j, k] = Gg[k, j] = rd[f"g{j}_{k}"]
                # (I - Gg M)^(-1/2) = M^(-1/2) (I - M^(1/2) Gg M^(1/2))^(-1/2) M^(1/2)
                Sg = np.eye(p) - Mh_ @ Gg @ Mh_
                out[i] = Mhi_ @ (_inv_sqrt_sym(Sg) @ (Mh_ @ s))
            yield pd.DataFrame(out, columns=[f"u{j}" for j in range(p)])

    u = t.mapInPandas(run, schema)
    B, _ = _outer_sum(u, [f"u{j}" for j in range(p)])
    return M @ B @ M


def coef_table(spark, fit: GlmFit, V: np.ndarray | None = None, z_crit: float = 1.96) -> DataFrame:
    """Term, estimate, se, z, p, OR, CI (aliased terms -> nulls)."""
    V = fit.bread if V is None else V
    rows = []
    pos = {j: i for i, j in enumerate(fit.kept)}
    for j, term in enumerate(fit.names):
        if j in pos:
            i = pos[j]
            est = float(fit.beta[i])
            se = float(np.sqrt(max(V[i, i], 0.0)))
            z = est / se if se > 0 else float("nan")
            rows.append((term, est, se, z, normal_two_sided_p(z), float(np.exp(est)),
                         float(np.exp(est - z_crit * se)), float(np.exp(est + z_crit * se))))
        else:
            rows.append((term, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, "term string, estimate double, se double, z double, p_value double, "
                                       "OR double, CI_low double, CI_high double")


def or_table(coefs: DataFrame) -> DataFrame:
    """Odds-ratio table without the intercept."""
    return coefs.where(F.col("term") != "(Intercept)").select("term", "OR", "CI_low", "CI_high", "p_value")
