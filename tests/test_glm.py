import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import glm


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n, G = 600, 40
    cl = rng.integers(0, G, n)
    g = rng.choice(["a", "b", "c"], n)
    x = rng.normal(0, 1, n)
    eta = -0.3 + 0.8 * (g == "b") - 0.5 * (g == "c") + 0.6 * x + rng.normal(0, 0.5, G)[cl]
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    rows = [(int(a), str(b), float(c), int(d)) for a, b, c, d in zip(cl, g, x, y)]
    df = spark.createDataFrame(rows, "cl long, g string, x double, y int")
    X = np.column_stack([np.ones(n), g == "b", g == "c", x]).astype(float)
    return df, X, y, cl


def _newton(X, y, firth=False):
    b = np.zeros(X.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-X @ b))
        W = mu * (1 - mu)
        I = X.T @ (W[:, None] * X)
        M = np.linalg.inv(I)
        r = y - mu
        if firth:
            h = W * np.einsum("ij,jk,ik->i", X, M, X)
            r = r + h * (0.5 - mu)
        step = M @ (X.T @ r)
        b = b + step
        if np.max(np.abs(step)) < 1e-12:
            break
    mu = 1 / (1 + np.exp(-X @ b))
    W = mu * (1 - mu)
    return b, np.linalg.inv(X.T @ (W[:, None] * X)), mu


def _fit(df, firth=False):
    dm, xn, terms = glm.treatment_design(df, [("g", None)], ["x"])
    return dm, xn, glm.fit_logistic(dm, xn, terms, "y", firth=firth)


@pytest.mark.parametrize("firth", [False, True])
def test_irls_matches_newton(data, firth):
    df, X, y, cl = data
    _, _, fit = _fit(df, firth)
    b, M, _ = _newton(X, y, firth)
    assert fit.converged
    assert fit.beta == pytest.approx(b, abs=1e-8)
    assert fit.bread == pytest.approx(M, rel=1e-6)
    assert fit.names == ["(Intercept)", "gb", "gc", "x"]


def test_hc0_and_cr2(data):
    df, X, y, cl = data
    dm, xn, fit = _fit(df)
    b, M, mu = _newton(X, y)
    S = np.zeros((X.shape[1], X.shape[1]))
    Sc = np.zeros_like(S)
    groups = np.unique(cl)
    for g in groups:
        idx = cl == g
        s = X[idx].T @ (y[idx] - mu[idx])
        S += np.outer(s, s)
        # CR2 with explicit n_g x n_g adjustment matrices
        w = mu[idx] * (1 - mu[idx])
        C = np.sqrt(w)[:, None] * X[idx]
        H = C @ M @ C.T
        vals, vecs = np.linalg.eigh(np.eye(len(H)) - H)
        A = (vecs / np.sqrt(vals)) @ vecs.T
        e = (y[idx] - mu[idx]) / np.sqrt(w)
        u = C.T @ A @ e
        Sc += np.outer(u, u)
    G = len(groups)
    hc0 = glm.vcov_cluster_hc0(dm, fit, xn, "y", "cl")
    assert hc0 == pytest.approx(M @ S @ M * G / (G - 1), rel=1e-6)
    cr2 = glm.vcov_cluster_cr2(dm, fit, xn, "y", "cl")
    assert cr2 == pytest.approx(M @ Sc @ M, rel=1e-6)


def test_aliased_column_is_null(spark, data):
    df, X, y, cl = data
    df2 = df.withColumn("x2", F.col("x") * 2.0)
    dm, xn, terms = glm.treatment_design(df2, [("g", None)], ["x", "x2"])
    fit = glm.fit_logistic(dm, xn, terms, "y")
    tab = {r["term"]: r for r in glm.coef_table(spark, fit).collect()}
    assert tab["x2"]["estimate"] is None
    assert tab["x"]["estimate"] is not None


def test_factor_with_one_level_raises(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0)], "g string, y int")
    with pytest.raises(ValueError):
        glm.treatment_design(df, [("g", None)], [])


def test_separation_firth_finite(spark):
    rows = [(float(x), int(x > 0)) for x in [-3, -2, -1.5, -1, -0.5, 0.5, 1, 1.5, 2, 3]]
    df = spark.createDataFrame(rows, "x double, y int")
    dm, xn, terms = glm.treatment_design(df, [], ["x"])
    firth = glm.fit_logistic(dm, xn, terms, "y", firth=True)
    assert firth.converged and np.all(np.isfinite(firth.beta)) and abs(firth.beta[1]) < 20
    plain = glm.fit_logistic(dm, xn, terms, "y", max_iter=30)
    assert np.all(np.isfinite(plain.beta))


def test_wide_block_gram_path_matches(data, monkeypatch):
    df, X, y, cl = data
    _, _, narrow = _fit(df, firth=True)
    monkeypatch.setattr(glm, "WIDE_P", 1)
    _, _, wide = _fit(df, firth=True)
    assert wide.beta == pytest.approx(narrow.beta, abs=1e-8)
    assert wide.bread == pytest.approx(narrow.bread, rel=1e-8)
