"""Bootstrap confidence intervals for every metric (B1, B2).

Poisson bootstrap: replicate ``r`` gives row ``i`` the weight
``Poisson(1)^{-1}(u(i, r))`` where ``u`` is a hash of (seed, row key, r). Tasks
draw the weights of a batch of rows in arrays and fold them into (cell, replicate)
sums at once, so the shuffle carries reps x distinct scores, never reps x rows.
Draws depend only on the row key, not on partitioning or retries. The metrics
of every replicate then come from the same histogram code as the point estimate
(keys + rep).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import finite, hash_int
from cohortlens.operators.metrics import METRIC_NAMES, metric_table, metrics_long
from cohortlens.operators.prefix import running_sums

MASK31 = 2147483647
POISSON_KMAX = 15


def poisson1_cdf(kmax: int = POISSON_KMAX) -> list[float]:
    """P(X <= k) for X ~ Poisson(1), k = 0..kmax (from the pmf e^-1 / k!)."""
    out, acc = [], 0.0
    for k in range(kmax + 1):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


MIX_STEPS = [
    lambda x: x.bitwiseXOR(F.shiftright(x, 15)),
    lambda x: (x * F.lit(0x2C1B3C6D)).bitwiseAND(F.lit(MASK31)),
    lambda x: x.bitwiseXOR(F.shiftright(x, 12)),
    lambda x: (x * F.lit(0x297A2D39)).bitwiseAND(F.lit(MASK31)),
    lambda x: x.bitwiseXOR(F.shiftright(x, 15)),
]


def mix31(x: Column) -> Column:
    """Integer hash on 31 bits (xor-shift / multiply rounds, no overflow: every
    product stays below 2^62). DuckDB repeats it with xor(), >> and &."""
    for step in MIX_STEPS:
        x = step(x)
    return x


def replicate_uniform(row_hash: Column, rep: Column) -> Column:
    """U[0,1) for a row hash and a replicate number, as one expression."""
    x = row_hash.bitwiseAND(F.lit(MASK31)).bitwiseXOR((rep.cast("bigint") * F.lit(0x9E3779B1)).bitwiseAND(F.lit(MASK31)))
    return mix31(mix31(x).bitwiseXOR(F.shiftright(row_hash, 31))).cast("double") / F.lit(2147483648.0)


def poisson_weight(u: Column, kmax: int = POISSON_KMAX) -> Column:
    """Inverse CDF of Poisson(1): the number of CDF steps at or below u, written as
    a CASE chain so most rows stop after one or two comparisons."""
    cdf = poisson1_cdf(kmax)[:-1]
    expr = F.when(u < F.lit(cdf[0]), F.lit(0))
    for k, c in enumerate(cdf[1:], start=1):
        expr = expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(cdf)))


#: Replicates drawn at a time, which bounds a task's memory at (rows of a batch) x this.
REPLICATES_AT_ONCE = 50


def mix31_array(x: np.ndarray) -> np.ndarray:
    """``mix31`` on int64 arrays."""
    x = x ^ (x >> 15)
    x = (x * 0x2C1B3C6D) & MASK31
    x = x ^ (x >> 12)
    x = (x * 0x297A2D39) & MASK31
    return x ^ (x >> 15)


def hash_array(row_hash: np.ndarray, number: np.ndarray) -> np.ndarray:
    """31-bit hashes (rows, numbers): the low 31 bits of a row's 60-bit hash are mixed with the number, the high ones with the result."""
    return mix31_array(mix31_array((row_hash & MASK31)[:, None] ^ ((number * 0x9E3779B1) & MASK31)[None, :]) ^ (row_hash >> 31)[:, None])


def _mix32(x: np.ndarray) -> None:
    """``mix31`` on uint32 arrays, in place: products are kept modulo 2**32, whose low 31 bits are the ones that count."""
    mask = np.uint32(MASK31)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x &= mask
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x &= mask
    x ^= x >> np.uint32(15)


#: ``POISSON_STEPS[k]``: the least 31-bit hash with a weight above k.
POISSON_STEPS = np.ceil(np.array(poisson1_cdf()[:-1]) * 2147483648.0).astype(np.uint32)
#: Weights by the high 16 of the 31 bits; 255 where the low ones decide.
_WEIGHTS = np.searchsorted(POISSON_STEPS, np.arange(1 << 16, dtype=np.uint32) << np.uint32(15), side="right").astype(np.uint8)
_WEIGHTS[POISSON_STEPS[(POISSON_STEPS & np.uint32(0x7FFF)) > 0] >> np.uint32(15)] = 255


def poisson_weights(row_hash: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """(rows, replicates): the weights of ``poisson_weight(replicate_uniform(...))``, as small integers."""
    x = (row_hash & MASK31).astype(np.uint32)[:, None] ^ ((rep * 0x9E3779B1) & MASK31).astype(np.uint32)[None, :]
    _mix32(x)
    x ^= (row_hash >> 31).astype(np.uint32)[:, None]
    _mix32(x)
    weight = _WEIGHTS[x >> np.uint32(15)]
    near = weight == 255
    weight[near] = np.searchsorted(POISSON_STEPS, x[near], side="right")
    return weight


def _replicate_sums(batches, n_boot: int):
    """(cell * n_boot + replicate, summed weight) of each batch of (cell, row hash):
    weights are drawn once per distinct hash where a unit has many rows."""
    for pdf in batches:
        if not len(pdf):
            continue
        order = np.argsort(pdf["__cell"].to_numpy(), kind="stable")
        cell, h = pdf["__cell"].to_numpy()[order], pdf["__h"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        units, of = np.unique(h, return_inverse=True)
        shared = 2 * len(units) < len(h)
        for first in range(0, n_boot, REPLICATES_AT_ONCE):
            rep = np.arange(first, min(n_boot, first + REPLICATES_AT_ONCE), dtype=np.int64)
            weight = poisson_weights(units, rep)[of] if shared else poisson_weights(h, rep)
            sums = np.add.reduceat(weight, starts, axis=0, dtype=np.int64)
            i, j = np.nonzero(sums)
            yield pd.DataFrame({"__k": cell[starts][i] * n_boot + rep[j], "__w": sums[i, j]})


def replicate_histogram(df: DataFrame, row_key: list[str], keys: list[str] | None = None,
                        y: str = "y_true", p: str = "y_prob", n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(keys..., rep, score, pos, neg) with Poisson(1) replicate weights.

    Each (keys, label, score) cell gets a dense integer id first (one row per cell,
    ranked with distributed prefix sums); tasks draw and sum the weights of their
    rows in arrays, the sums are grouped by the single bigint ``cell * n_boot +
    rep``, and cells are decoded on the reduced table. With a continuous score a
    cell is nearly a row, and the shuffle carries nearly rows x replicates."""
    keys = list(keys or [])
    h = hash_int(F.lit(seed), *[F.col(c) for c in row_key])
    d = df.where(finite(p) & F.col(y).isNotNull()) \
          .select(*keys, F.col(y).cast("int").alias("__y"), F.col(p).cast("double").alias("score"), h.alias("__h"))
    cell_cols = keys + ["__y", "score"]
    cells = running_sums(d.select(*cell_cols).distinct(), [], [F.col(c) for c in cell_cols],
                              {"__cell": F.lit(1).cast("bigint")}, inclusive=True, persist=True)
    rows = d.join(cells, cell_cols, "inner").select("__cell", "__h")
    parts = rows.mapInPandas(lambda batches: _replicate_sums(batches, n_boot), "__k long, __w long")
    agg = parts.groupBy("__k").agg(F.sum("__w").alias("__w")).select(
        F.floor(F.col("__k") / F.lit(n_boot)).cast("bigint").alias("__cell"), F.pmod(F.col("__k"), F.lit(n_boot)).cast("int").alias("rep"), "__w")
    decoded = agg.join(cells, "__cell", "inner")
    return decoded.groupBy(*keys, "rep", "score").agg(
        F.sum(F.when(F.col("__y") == 1, F.col("__w")).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col("__y") == 0, F.col("__w")).otherwise(0)).cast("double").alias("neg"))


def bootstrap_metrics(df: DataFrame, row_key: list[str], keys: list[str] | None = None, y: str = "y_true",
                      p: str = "y_prob", n_boot: int = 1000, seed: int = 42, threshold: float = 0.5,
                      n_bins: int = 10, strict: bool = False) -> DataFrame:
    """B1: one metric row per (keys, rep). ``row_key`` is the resampling unit:
    the row key resamples rows (as the reference does); passing the entity id
    gives every row of an entity the same weight (a cluster bootstrap).
    ``strict`` predicts positive with score > threshold."""
    keys = list(keys or [])
    hist = replicate_histogram(df, row_key, keys, y, p, n_boot, seed).persist()
    return metric_table(hist, keys + ["rep"], threshold, n_bins, strict=strict)


def bootstrap_summary(reps: DataFrame, point: DataFrame, keys: list[str] | None = None,
                      names: list[str] = METRIC_NAMES) -> DataFrame:
    """Mean, sd (ddof 0), 2.5/97.5% percentile interval and the point value per metric."""
    keys = list(keys or [])
    long = metrics_long(reps, keys + ["rep"], names)
    s = long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", F.lit(0.025)).alias("ci95_low"),   # n_boot values per group: bounded
        F.percentile("value", F.lit(0.975)).alias("ci95_high"))
    pt = metrics_long(point, keys, names).withColumnRenamed("value", "point")
    return s.join(pt, keys + ["metric"], "left")


#: Distinct scores in a leaf of the multinomial tree on average, and cells of the grid that leaves are made of.
LEAF_SCORES, GRID_CELLS = 4096, 1 << 16
#: Entries of a block of draws, (replicates x scores), which bounds a task's memory.
DRAWS_AT_ONCE = 1 << 21
_GROUP = "__group"


def _node_rng(seed: int, group: int, *node: int) -> np.random.Generator:
    """The generator of one node: whoever needs the node's draws gets the same ones."""
    return np.random.default_rng([seed, int(group) & 0xFFFFFFFFFFFFFFFF, *map(int, node)])


def _split(rng: np.random.Generator, n: np.ndarray, part: int, whole: int) -> np.ndarray:
    """How many of ``n`` draws (one number per replicate) fall into ``part`` of ``whole``."""
    return rng.binomial(n, part / whole) if whole else np.zeros_like(n)


def _leaf_of_grid(leaf_scores: int):
    """Leaves over one group's grid (at most GRID_CELLS rows): runs of cells of about ``leaf_scores`` scores, with the
    weights met on the way from the root of a binary tree over the leaves."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__g")
        k, w = pdf["k"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
        leaf = (np.cumsum(k) - k) // leaf_scores
        leaf = np.unique(leaf, return_inverse=True)[1]
        sums = np.r_[0, np.cumsum(np.bincount(leaf, w).astype(np.int64))]
        count = len(sums) - 1
        out = []
        for i in range(count):
            lo, hi, path = 0, count, []
            while hi - lo > 1:
                mid = (lo + hi) // 2
                path += [lo, hi, int(sums[mid] - sums[lo]), int(sums[hi] - sums[lo]), int(i < mid)]
                lo, hi = (lo, mid) if i < mid else (mid, hi)
            out.append(path)
        return pd.DataFrame({_GROUP: pdf[_GROUP].iloc[0], "__g": pdf["__g"].to_numpy(), "leaf": leaf.astype(np.int64), "n": int(sums[-1]), "path": [out[i] for i in leaf]})

    return run


def _leaf_labels(seed: int, n_boot: int):
    """(group, leaf, rep, pos, neg): every leaf's draws by label, from the binomials on its path."""
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                n = np.full(n_boot, r.n, np.int64)
                for lo, hi, left, whole, went_left in np.array(r.path, np.int64).reshape(-1, 5).tolist():
                    drawn = _split(_node_rng(seed, r.group, 0, lo, hi), n, left, whole)
                    n = drawn if went_left else n - drawn
                pos = _split(_node_rng(seed, r.group, 1, r.leaf), n, r.pos, r.pos + r.neg)
                yield pd.DataFrame({_GROUP: r.group, "leaf": r.leaf, "rep": np.arange(n_boot), "pos": pos, "neg": n - pos})

    return run


def _multinomial_leaves(df: DataFrame, keys: list[str], y: str, p: str, n_boot: int, seed: int, leaf_scores: int):
    """(scores, labels, groups): distinct scores with their counts and leaf; each leaf's draws per replicate, with those in higher leaves; group ids of the keys."""
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    hist = df.where(finite(p) & F.col(y).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("score")).agg(
        F.count_if(F.col(y).cast("int") == 1).alias("pos"), F.count_if(F.col(y).cast("int") == 0).alias("neg")).withColumn(_GROUP, group)
    hist = hist.where("pos + neg > 0").persist()
    groups = hist.select(_GROUP, *keys).distinct()
    span = hist.groupBy(_GROUP).agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    at = F.floor((F.col("score") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (GRID_CELLS - 1))
    hist = hist.join(span, _GROUP).withColumn("__g", F.when(F.col("__hi") > F.col("__lo"), at).otherwise(0).cast("bigint"))
    grid = hist.groupBy(_GROUP, "__g").agg(F.count("*").alias("k"), F.sum(F.col("pos") + F.col("neg")).alias("w"))
    leaves = grid.groupBy(_GROUP).applyInPandas(_leaf_of_grid(leaf_scores), f"{_GROUP} long, __g long, leaf long, n long, path array<long>")
    scores = hist.join(leaves.select(_GROUP, "__g", "leaf"), [_GROUP, "__g"]).select(_GROUP, "leaf", "score", "pos", "neg")
    tops = leaves.groupBy(_GROUP, "leaf").agg(F.first("n").alias("n"), F.first("path").alias("path"))
    sums = scores.groupBy(_GROUP, "leaf").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    drawn = tops.join(sums, [_GROUP, "leaf"]).select(F.col(_GROUP).alias("group"), "leaf", "n", "path", "pos", "neg") \
        .mapInPandas(_leaf_labels(seed, n_boot), f"{_GROUP} long, leaf long, rep long, pos long, neg long")
    above = Window.partitionBy(_GROUP, "rep").orderBy(F.col("leaf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(_GROUP, "rep")
    labels = drawn.select("*", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp_above"), F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp_above"),
                          F.sum("pos").over(every).alias("P"), F.sum("neg").over(every).alias("N"))
    return scores, labels, groups


def _leaf_draws(seed: int, group: int, leaf: int, scores: pd.DataFrame, labels: pd.DataFrame):
    """Blocks (rows of ``labels``, draws of label 1, draws of label 0), each (replicates x scores) over the leaf's scores in rising order."""
    pos, neg = scores["pos"].to_numpy(float), scores["neg"].to_numpy(float)
    rows = max(1, DRAWS_AT_ONCE // len(scores))
    for block, start in enumerate(range(0, len(labels), rows)):
        some = labels.iloc[start:start + rows]
        rng = _node_rng(seed, group, 2, leaf, block)
        draws = [rng.multinomial(some[name].to_numpy(np.int64), c / c.sum()) if c.sum() else np.zeros((len(some), len(c)), np.int64) for name, c in (("pos", pos), ("neg", neg))]
        yield some, *draws


def _sorted_leaf(scores: pd.DataFrame, labels: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return scores.sort_values("score").reset_index(drop=True), labels.sort_values("rep").reset_index(drop=True)


def _metric_sums(seed: int, threshold: float, n_bins: int, strict: bool):
    """One leaf's part of every sum behind the metrics, per replicate."""
    def run(key, scores: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        scores, labels = _sorted_leaf(scores, labels)
        s = scores["score"].to_numpy(float)
        pred = s > threshold if strict else s >= threshold
        step = 1.0 / n_bins
        bins = sum((s >= j * step).astype(int) for j in range(1, n_bins))
        inside = (s >= 0.0) & (s < 1.0)
        out = []
        for some, pos, neg in _leaf_draws(seed, key[0], key[1], scores, labels):
            tp = pos[:, ::-1].cumsum(axis=1)[:, ::-1] + some["tp_above"].to_numpy()[:, None]
            fp = neg[:, ::-1].cumsum(axis=1)[:, ::-1] + some["fp_above"].to_numpy()[:, None]
            below = some["N"].to_numpy()[:, None] - fp
            both = pos + neg
            part = {_GROUP: key[0], "rep": some["rep"].to_numpy(), "pairs": (pos * (below + 0.5 * neg)).sum(axis=1), "steps": (pos * (tp / np.maximum(tp + fp, 1))).sum(axis=1),
                    "squares": pos @ ((1.0 - s) ** 2) + neg @ (s ** 2), "tp": pos[:, pred].sum(axis=1), "fp": neg[:, pred].sum(axis=1),
                    "P": some["pos"].to_numpy(), "N": some["neg"].to_numpy()}
            for b in range(n_bins):
                at = inside & (bins == b)
                part |= {f"w{b}": both[:, at].sum(axis=1), f"s{b}": both[:, at] @ s[at], f"y{b}": pos[:, at].sum(axis=1)}
            out.append(pd.DataFrame(part))
        return pd.concat(out)

    return run


def multinomial_histogram(df: DataFrame, keys: list[str] | None = None, y: str = "y_true", p: str = "y_prob",
                          n_boot: int = 1000, seed: int = 42, leaf_scores: int = LEAF_SCORES) -> DataFrame:
    """B1(a): exact iid resampling of the n rows of each key group, with replacement, as (keys..., rep, score, pos, neg).

    A replicate is one multinomial draw over (score, label). It comes down a binary tree over runs of neighbouring scores:
    at each node a binomial, from a generator keyed by (seed, group, node), says how many draws go left,
    so every leaf finds its own share without the others, and its cells are drawn by the task that holds them. Totals are n in every replicate. Draws
    depend on the data and the seed, not on partitions; no task or driver holds a group's scores, at any number of them."""
    keys = list(keys or [])
    scores, labels, groups = _multinomial_leaves(df, keys, y, p, n_boot, seed, leaf_scores)

    def run(key, scores: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        scores, labels = _sorted_leaf(scores, labels)
        out = []
        for some, pos, neg in _leaf_draws(seed, key[0], key[1], scores, labels):
            i, j = np.nonzero(pos + neg)
            out.append(pd.DataFrame({_GROUP: key[0], "rep": some["rep"].to_numpy()[i], "score": scores["score"].to_numpy()[j], "pos": pos[i, j].astype(float), "neg": neg[i, j].astype(float)}))
        return pd.concat(out)

    drawn = scores.groupBy(_GROUP, "leaf").cogroup(labels.groupBy(_GROUP, "leaf")).applyInPandas(run, f"{_GROUP} long, rep long, score double, pos double, neg double")
    return drawn.join(groups, _GROUP).select(*keys, "rep", "score", "pos", "neg")


def bootstrap_metrics_multinomial(df: DataFrame, keys: list[str] | None = None, y: str = "y_true",
                                  p: str = "y_prob", n_boot: int = 1000, seed: int = 42, threshold: float = 0.5,
                                  n_bins: int = 10, strict: bool = False, leaf_scores: int = LEAF_SCORES) -> DataFrame:
    """B1(a) metrics: one row per (keys, rep), for scores of any number of distinct values.

    The draws are those of ``multinomial_histogram``, but they are summed where they are made: leaves are in score
    order and know from the tree what each replicate drew above them, so a leaf's part of every
    metric is a sum per replicate, and only (leaves x replicates) rows are shuffled."""
    keys = list(keys or [])
    scores, labels, groups = _multinomial_leaves(df, keys, y, p, n_boot, seed, leaf_scores)
    names = ["pairs", "steps", "squares", "tp", "fp", "P", "N", *[f"{c}{b}" for b in range(n_bins) for c in "wsy"]]
    parts = scores.groupBy(_GROUP, "leaf").cogroup(labels.groupBy(_GROUP, "leaf")).applyInPandas(
        _metric_sums(seed, threshold, n_bins, strict), f"{_GROUP} long, rep long, " + ", ".join(f"{c} double" for c in names))
    t = parts.groupBy(_GROUP, "rep").agg(*[F.sum(c).alias(c) for c in names]).join(groups, _GROUP)
    n, c = F.col("P") + F.col("N"), F.col
    ece = sum(F.when(c(f"w{b}") > 0, F.abs(c(f"y{b}") - c(f"s{b}")) / n).otherwise(0.0) for b in range(n_bins))
    return t.select(*keys, "rep", F.try_divide(c("pairs"), c("P") * c("N")).alias("roc_auc"), F.try_divide(c("steps"), c("P")).alias("pr_auc"), (c("squares") / n).alias("brier"), ece.alias("ece"),
                    "tp", (c("N") - c("fp")).alias("tn"), "fp", (c("P") - c("tp")).alias("fn"),
                    F.coalesce(F.try_divide(c("tp"), c("tp") + c("fp")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(c("tp"), c("P")), F.lit(0.0)).alias("sensitivity"))
