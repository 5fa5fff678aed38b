import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import prefix
from cohortlens.operators.prefix import running_sums
from cohortlens.operators.quantile import quantiles


def running_sums_window(df, keys, order, values, inclusive):
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in values.items()])


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 4000
    # key 0 holds about a third of all rows
    keys = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    vals = np.round(rng.normal(10, 3, n), 1)
    vals[rng.random(n) < 0.05] = np.nan
    rows = [(int(i), int(k), None if np.isnan(v) else float(v)) for i, (k, v) in enumerate(zip(keys, vals))]
    return spark.createDataFrame(rows, "rid long, k long, v double")


def test_running_sums_match_window(skewed):
    vals = {"s": F.col("v"), "c": F.when(F.col("v").isNotNull(), 1).otherwise(0)}
    for inclusive in (False, True):
        a = running_sums(skewed, ["k"], [F.col("rid")], vals, inclusive, rows_per_task=60)
        b = running_sums_window(skewed, ["k"], [F.col("rid")], vals, inclusive)
        ra = {r["rid"]: (r["s"], r["c"]) for r in a.collect()}
        rb = {r["rid"]: (r["s"], r["c"]) for r in b.collect()}
        assert ra.keys() == rb.keys()
        for key in ra:
            sa, ca = ra[key]
            sb, cb = rb[key]
            assert ca == cb
            assert (sa is None and sb is None) or sa == pytest.approx(sb, abs=1e-9)


def test_running_sums_global(skewed):
    a = running_sums(skewed, [], [F.col("rid")], {"r": F.lit(1)}, inclusive=True, rows_per_task=300)
    assert sorted(r["r"] for r in a.collect()) == list(range(1, skewed.count() + 1))


def test_partition_count_invariance(skewed):
    one = running_sums(skewed, ["k"], [F.col("rid")], {"s": F.col("v")})
    many = running_sums(skewed, ["k"], [F.col("rid")], {"s": F.col("v")}, rows_per_task=20)
    a = {r["rid"]: r["s"] for r in one.collect()}
    b = {r["rid"]: r["s"] for r in many.collect()}
    for key in a:
        assert (a[key] is None and b[key] is None) or a[key] == pytest.approx(b[key], abs=1e-9)


@pytest.mark.parametrize("kind", ["long", "double", "string", "date", "timestamp", "boolean"])
def test_cells_follow_any_order_type(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(i, None if rng.random() < 0.1 else int(rng.integers(0, 3)), None if rng.random() < 0.1 else int(rng.integers(-40, 40)), int(rng.integers(0, 9))) for i in range(600)]
    made = {"long": F.col("o"), "double": F.when(F.col("o") == 7, F.lit(float("nan"))).otherwise(F.col("o") / 3), "string": F.concat(F.lit("é"), F.col("o").cast("string"), F.col("rid").cast("string")),
            "date": F.date_add(F.lit("2000-01-01"), F.col("o").cast("int")), "timestamp": F.timestamp_micros(F.col("o") * 1_000_003), "boolean": F.col("o") > 0}[kind]
    d = spark.createDataFrame(rows, "rid long, k long, o long, v long").withColumn("t", made).repartition(5)
    order, w = [F.col("t"), F.col("rid")], Window.partitionBy("k")
    ran = w.orderBy(*order)
    expected = d.select("rid", F.sum("v").over(ran.rowsBetween(Window.unboundedPreceding, -1)).alias("s"), F.min("v").over(w).alias("m"), F.lag("v").over(ran).alias("p"))
    for size in (1, 30, 10_000):
        got = running_sums(d, ["k"], order, {"s": F.col("v")}, least={"m": F.col("v")}, previous={"p": F.col("v")}, rows_per_task=size).select("rid", "s", "m", "p")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())), size


def test_a_hot_key_spreads_in_one_shuffle(skewed):
    spread = running_sums(skewed, ["k"], [F.col("rid")], {"s": F.col("v")}, rows_per_task=200)
    cells = prefix._cells(skewed, ["k"], [F.col("rid")], prefix.hot_keys(skewed, ["k"], 200)[0], 8)
    per = {(r["k"], r["__cell"]): r["count"] for r in cells.groupBy("k", "__cell").count().collect()}
    assert max(n for (k, _), n in per.items()) <= 400 and sum(1 for k, _ in per if k == 0) >= 7 and all(c == 0 for k, c in per if k)
    assert spread.count() == skewed.count()


@pytest.mark.parametrize("method", ["rank", "builtin"])
def test_quantiles_match_numpy(skewed, method):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    q = {r["k"]: r for r in quantiles(skewed, "v", probs, ["k"], method=method).collect()}
    pdf = skewed.toPandas().dropna()
    for k, g in pdf.groupby("k"):
        expect = np.percentile(g["v"].to_numpy(), [p * 100 for p in probs])
        got = [q[k][f"q{i}"] for i in range(len(probs))]
        assert got == pytest.approx(expect, abs=1e-9)


def test_quantiles_ungrouped_and_empty(spark, skewed):
    r = quantiles(skewed, "v", [0.5]).first()
    assert r["q0"] == pytest.approx(np.median(skewed.toPandas()["v"].dropna()))
    empty = spark.createDataFrame([], "v double")
    assert quantiles(empty, "v", [0.5]).count() <= 1


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=60),
       st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_quantiles_property(spark, values, probs):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles(df, "v", probs).first()
    expect = np.percentile(np.array(values), [p * 100 for p in probs])
    assert [got[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(expect), rel=1e-9, abs=1e-9)
