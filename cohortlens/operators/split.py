"""Entity-disjoint splits and grouped folds.

Entities are ordered by a hash of (seed, id) - a deterministic shuffle that
DuckDB can repeat - and ranked with a distributed prefix count (no global
sort into one partition). Sizes follow the usual rule: the test share is
ceil(share * n) entities, train the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import hash_int
from cohortlens.operators.prefix import running_sums


def _hash_key(seed: int, id_col: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def entity_split(df: DataFrame, id_col: str = "id", holdout: float = 0.4, seed: int = 42) -> DataFrame:
    """M1: (id, split) with train / valid / test; holdout entities are halved
    (test = ceil(half)). The id table is one row per entity."""
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct() \
            .withColumn("__h", _hash_key(seed, id_col))
    n = ids.count()   # one number
    n_hold = math.ceil(holdout * n)
    n_train = n - n_hold
    n_test = math.ceil(0.5 * n_hold)
    n_valid = n_hold - n_test
    ranked = running_sums(ids, [], [F.col("__h"), F.col(id_col)], {"__rank": F.lit(1).cast("bigint")}, inclusive=True, persist=True)
    r = F.col("__rank")
    split = F.when(r <= n_train, "train").when(r <= n_train + n_valid, "valid").otherwise("test")
    return ranked.select(id_col, split.alias("split"))


def attach_split(df: DataFrame, splits: DataFrame, id_col: str = "id") -> DataFrame:
    """One join to the (id, split) table instead of three membership filters."""
    return df.join(splits, id_col, "inner")


def group_folds(df: DataFrame, id_col: str = "id", k: int = 5, seed: int = 42) -> DataFrame:
    """fold = hash(seed, id) mod k: every row of an entity in one fold,
    computable per row with no coordination (scales to any number of entities)."""
    return df.withColumn("fold", F.pmod(hash_int(F.lit(seed), F.col(id_col)), F.lit(k)).cast("int"))


def fold_cycles(size: int, count: int, loads: list[int]) -> list[tuple[int, list[int]]]:
    """Where ``count`` groups of ``size`` rows go, one after the other into the lightest fold (ties: the first): a list of
    (first rank, folds that take turns from there). ``loads`` is brought up to date.

    A fold with load L takes a turn in every round from L // size on, and the turns of a round follow
    (L % size, fold), so the folds that take turns change at most once per fold."""
    k = len(loads)
    first = [load // size for load in loads]
    turn = sorted(range(k), key=lambda i: (loads[i] % size, i))
    out, rank, rounds = [], 0, sorted(set(first))
    for now, then in zip(rounds, [*rounds[1:], None]):
        cycle = [i for i in turn if first[i] <= now]
        left = count - rank
        n = left if then is None else min(left, (then - now) * len(cycle))
        if n <= 0:
            break
        out.append((rank, cycle))
        for at, i in enumerate(cycle):
            loads[i] += size * (n // len(cycle) + (at < n % len(cycle)))
        rank += n
    return out


def balanced_folds(df: DataFrame, id_col: str = "id", k: int = 5) -> DataFrame:
    """(id, n, fold): grouped folds of nearly equal size, by the greedy rule: the largest entity first, each into the
    lightest fold; entities of one size in the order of their ids.

    The rule needs no entity but only how many there are of each size: that table, which has at most the square root of
    twice the number of rows, is walked on the driver, whatever the number of entities. An entity's fold follows from its rank
    among those of its size, a distributed prefix count. Null ids are in no fold."""
    spark = df.sparkSession
    sizes = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    table = sorted(((r["n"], r["m"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    loads, rows = [0] * k, []
    for n, m in table:
        cycles = fold_cycles(n, m, loads)
        rows.append((n, [c[0] for c in cycles], [c[1] for c in cycles]))
    cycles = spark.createDataFrame(rows, "n bigint, starts array<bigint>, cycles array<array<int>>")
    ranked = running_sums(sizes, ["n"], [F.col(id_col)], {"__rank": F.lit(1).cast("bigint")}, inclusive=True, persist=True)
    at = F.size(F.filter("starts", lambda s: s < F.col("__rank")))
    cycle = F.element_at("cycles", at)
    turn = (F.col("__rank") - 1 - F.element_at("starts", at)) % F.size(cycle)
    return ranked.join(cycles, "n").select(id_col, "n", F.element_at(cycle, (turn + 1).cast("int")).alias("fold"))
