
import pytest

from cohortlens.functions.stats import f_sf, normal_two_sided_p
from cohortlens.operators import fairness as FA


def test_f_tail_golden():
    # One-way ANOVA of the reference: F(2, 130) = 12.7865176930097, p = 8.52288747164186e-06.
    assert f_sf(12.7865176930097, 2, 130) == pytest.approx(8.52288747164186e-06, rel=1e-9)


def test_normal_p_golden():
    # OR table of the reference: p from estimate / se; z = 1.96 gives 0.05.
    assert normal_two_sided_p(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert normal_two_sided_p(0.0) == 1.0


def test_anova_small(spark):
    rows = [(1, "a", 0.1), (2, "a", 0.3), (3, "b", 0.5), (4, "b", 0.9), (5, "c", 0.2), (6, "c", 0.4)]
    r = spark.createDataFrame(rows, "id long, g string, mean_target double")
    out = {x["term"]: x for x in FA.anova_oneway(r, "g").collect()}
    vals = {"a": [0.1, 0.3], "b": [0.5, 0.9], "c": [0.2, 0.4]}
    allv = [v for vs in vals.values() for v in vs]
    grand = sum(allv) / len(allv)
    ssb = sum(len(vs) * (sum(vs) / len(vs) - grand) ** 2 for vs in vals.values())
    ssw = sum(sum((v - sum(vs) / len(vs)) ** 2 for v in vs) for vs in vals.values())
    assert out["g"]["sum_sq"] == pytest.approx(ssb)
    assert out["Residuals"]["sum_sq"] == pytest.approx(ssw)
    assert out["g"]["f_value"] == pytest.approx((ssb / 2) / (ssw / 3))


def test_fairness_null_rules(spark):
    # entity 3 (positive) has one missing score -> its mean is missing -> sensitivity missing;
    # negatives all scored -> specificity present; AUC over scored entities only.
    rows = [
        (1, "f", 1, 0.9), (1, "f", 1, 0.7), (2, "f", 0, 0.2), (3, "f", 1, 0.8), (3, "f", 0, None),
        (4, "m", 1, 0.3), (5, "m", 0, 0.9),
    ]
    df = spark.createDataFrame(rows, "id long, sex string, target_num int, y_prob double")
    out = {r["level"]: r for r in FA.fairness_metrics(df, ["sex"], 0.5).collect()}
    f = out["f"]
    assert (f["n"], f["n_pos"], f["n_neg"], f["n_scored"]) == (3, 2, 1, 2)
    assert f["Sensitivity"] is None
    assert f["Specificity"] == 1.0
    assert f["AUC"] == 1.0
    m = out["m"]
    # case scored below control: auto direction flips, AUC stays >= 0.5
    assert m["AUC"] == 1.0
    assert m["Sensitivity"] == 0.0 and m["Specificity"] == 0.0
