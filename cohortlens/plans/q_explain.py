"""Queries: explanations of the fixed-coefficient scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import explain as X
from cohortlens.operators import features, profile
from cohortlens.plans import sql as S
from cohortlens.plans.base import query
from cohortlens.sources import views

SCORER = X.Scorer.of(views.DESIGN_COEFS)
LEVELS = [f"d_{lv}" for lv in views.DESIGN_LEVELS]
FEATS = SCORER.features
SEED = 42


# The scorer over every one-hot group and both exposures, with given coefficients.
FULL = X.Scorer.of(views.DESIGN_COEFS | {"z_prev": 0.35, "p_under": -0.25, "h_2": 0.2, "h_3": -0.1, "h_4": 0.15, "h_5": -0.3,
                                         "s_spring": 0.1, "s_summer": -0.2, "s_winter": 0.05})
GROUPS = {"medication": LEVELS, "phase": ["p_none", "p_under"], "hatype": [f"h_{i}" for i in range(1, 6)],
          "season": ["s_autumn", "s_spring", "s_summer", "s_winter"]}
_DUMMIES = {"p_none": "phase = 'No treatment'", "p_under": "phase = 'Under treatment'",
            **{f"h_{i}": f"substr(hatype, 1, 1) = '{i}'" for i in range(1, 6)}, **{c: f"study_season = '{c[2:]}'" for c in GROUPS["season"]}}


def full_design(spark, sf_dir):
    """Feature panel with the design columns, the previous mean (no earlier visit: the centre) and a dummy per phase, subtype and season."""
    d = views.design_columns(features.build_feature_panel(views.panel(spark, sf_dir)))
    return d.select("*", ((F.coalesce("airq_prev_mean", F.lit(250000.0)) - F.lit(250000.0)) / F.lit(150000.0)).alias("z_prev"),
                    *[F.expr(f"cast(coalesce({e}, false) as double)").alias(c) for c, e in _DUMMIES.items()])


DF = S.with_(S.PANEL, S.SCALAR, S.FEAT, S.DESIGN.replace("FROM panel)", "FROM feat)").replace("design AS (\n  SELECT *,", "design0 AS (\n  SELECT *,", 1)) + """,
  design AS (SELECT *, (coalesce(airq_prev_mean, 250000.0) - 250000.0) / 150000.0 AS z_prev, """ + ", ".join(
    f"CAST(coalesce({e}, false) AS DOUBLE) AS {c}" for c, e in _DUMMIES.items()) + " FROM design0)"


def logit_sql(over: dict[str, str] | None = None, scorer=SCORER) -> str:
    over = over or {}
    terms = [repr(float(scorer.beta("intercept")))]
    for f in scorer.features:
        terms.append(f"{float(scorer.beta(f))!r} * CAST({over.get(f, f)} AS DOUBLE)")
    return "(1.0 / (1.0 + exp(-(" + " + ".join(terms) + "))))"


def onehot_sql(level_col: str = "level") -> dict[str, str]:
    return {lv: f"CAST({level_col} = '{lv}' AS DOUBLE)" for lv in LEVELS}


D = S.with_(S.PANEL, S.DESIGN)
LEVELS_SQL = "lv AS (SELECT * FROM (VALUES " + ", ".join(f"('{lv}', {i})" for i, lv in enumerate(LEVELS)) + ") t(level, level_pos))"
GRID_SQL = """grid AS (SELECT point, lo + point * ((hi - lo) / 24.0) AS x FROM
  (SELECT min({f}) AS lo, max({f}) AS hi FROM design) m, range(25) r(point))"""


def design(spark, sf_dir):
    return views.design(spark, sf_dir)


@query("logit_score", "rownames:bigint y_prob:double", D + f"SELECT rownames, {logit_sql()} AS y_prob FROM design")
def logit_score(spark, sf_dir):
    """Logistic scorer with given coefficients as one Column expression."""
    return design(spark, sf_dir).select("rownames", SCORER.score().alias("y_prob"))


@query("pdp_onehot", "level:string pdp:double",
       D + ", " + LEVELS_SQL + f"\nSELECT level, avg({logit_sql(onehot_sql())}) AS pdp FROM design, lv GROUP BY level")
def pdp_onehot(spark, sf_dir):
    """Partial dependence over the segment dummies."""
    return X.pdp_onehot(design(spark, sf_dir), SCORER, LEVELS)


def _group_levels_sql(levels):
    return "(VALUES " + ", ".join(f"('{lv}')" for lv in levels) + ") lv(level)"


def _group_over(levels):
    return {lv: f"CAST(level = '{lv}' AS DOUBLE)" for lv in levels}


@query("pdp_all", "variable:string level:string pdp:double",
       DF + "\n" + "\nUNION ALL ".join(f"SELECT '{g}' AS variable, level, avg({logit_sql(_group_over(lvs), FULL)}) AS pdp FROM design, {_group_levels_sql(lvs)} GROUP BY level"
                                       for g, lvs in GROUPS.items()))
def pdp_all(spark, sf_dir):
    """Partial dependence for medication, phase, subtype and season in one pass."""
    return X.pdp_all(full_design(spark, sf_dir), FULL, GROUPS)


@query("ice_numeric", "rownames:bigint id:bigint point:bigint x:double ice:double",
       D + ", " + GRID_SQL.format(f="z_airq") + f"\nSELECT rownames, id, point, x, {logit_sql({'z_airq': 'x'})} AS ice FROM design, grid")
def ice_numeric(spark, sf_dir):
    """ICE curves of every row over a 25-point exposure grid."""
    return X.ice_numeric(design(spark, sf_dir), SCORER, "z_airq", ["rownames", "id"])


@query("ice_onehot", "rownames:bigint id:bigint level:string ice:double",
       D + ", " + LEVELS_SQL + f"\nSELECT rownames, id, level, {logit_sql(onehot_sql())} AS ice FROM design, lv")
def ice_onehot(spark, sf_dir):
    """ICE of every row over the segment levels."""
    return X.ice_onehot(design(spark, sf_dir), SCORER, LEVELS, ["rownames", "id"])


@query("ice_mean", "point:bigint x:double ice_mean:double",
       D + ", " + GRID_SQL.format(f="z_airq") + f"\nSELECT point, x, avg({logit_sql({'z_airq': 'x'})}) AS ice_mean FROM design, grid GROUP BY point, x")
def ice_mean(spark, sf_dir):
    """Mean ICE curve."""
    return X.ice_mean(X.ice_numeric(design(spark, sf_dir), SCORER, "z_airq", ["rownames"]), ["point", "x"])


SENS_NUM_SQL = """, {name} AS (SELECT id, max(m) - min(m) AS sensitivity FROM (
   SELECT id, point, avg({score}) AS m FROM design, ({grid}) g GROUP BY id, point) t GROUP BY id)"""


def _sens_num_sql(name, f, scorer=None):
    grid = f"SELECT point, lo + point * ((hi - lo) / 24.0) AS x FROM (SELECT min({f}) AS lo, max({f}) AS hi FROM design) m, range(25) r(point)"
    return SENS_NUM_SQL.format(name=name, score=logit_sql({f: "g.x"}, scorer or SCORER), grid=grid)


SENS_CAT_SQL = ", " + LEVELS_SQL + f""", s_med AS (SELECT id, max(m) - min(m) AS sensitivity FROM (
   SELECT id, level, avg({logit_sql(onehot_sql())}) AS m FROM design, lv GROUP BY id, level) t GROUP BY id)"""


@query("sensitivity", "id:bigint sensitivity:double", D + _sens_num_sql("s_airq", "z_airq") + "\nSELECT * FROM s_airq")
def sensitivity(spark, sf_dir):
    """Per-entity range of the mean prediction over the exposure grid."""
    return X.sensitivity(design(spark, sf_dir), SCORER, "id", feature="z_airq")


@query("sensitivity_cat", "id:bigint sensitivity:double", D + SENS_CAT_SQL + "\nSELECT * FROM s_med")
def sensitivity_cat(spark, sf_dir):
    """Per-entity range of the mean prediction over the segment levels."""
    return X.sensitivity(design(spark, sf_dir), SCORER, "id", levels=LEVELS)


@query("max_prev", "id:bigint max_prev_attacks:double",
       S.with_(S.PANEL, S.SCALAR, S.FEAT) + "SELECT id, max(prev_attacks) AS max_prev_attacks FROM feat GROUP BY id")
def max_prev(spark, sf_dir):
    """Largest prior-event count per entity."""
    fp = features.build_feature_panel(views.panel(spark, sf_dir))
    return fp.groupBy("id").agg(F.max("prev_attacks").alias("max_prev_attacks"))


def _sens_group_sql(name, levels):
    return f""", {name} AS (SELECT id, max(m) - min(m) AS sensitivity FROM (
   SELECT id, level, avg({logit_sql(_group_over(levels), FULL)}) AS m FROM design, {_group_levels_sql(levels)} GROUP BY id, level) t GROUP BY id)"""


def _sens_table(spark, sf_dir):
    d = full_design(spark, sf_dir).select("id", "prev_attacks", *FULL.features).cache()   # one pass over the panel for five measures
    extra = d.groupBy("id").agg(F.max("prev_attacks").alias("max_prev_attacks"))
    return X.sensitivity_table({
        "sens_medication": X.sensitivity(d, FULL, "id", levels=GROUPS["medication"]),
        "sens_phase": X.sensitivity(d, FULL, "id", levels=GROUPS["phase"]),
        "sens_airq": X.sensitivity(d, FULL, "id", feature="z_airq"),
        "sens_airq_prev_mean": X.sensitivity(d, FULL, "id", feature="z_prev"),
    }, extra)


SENS_TABLE_SQL = (DF + _sens_group_sql("s_med", GROUPS["medication"]) + _sens_group_sql("s_phase", GROUPS["phase"])
                  + _sens_num_sql("s_airq", "z_airq", FULL) + _sens_num_sql("s_prev", "z_prev", FULL) + """,
  mp AS (SELECT id, max(prev_attacks) AS max_prev_attacks FROM feat GROUP BY id),
  st AS (SELECT m.id, m.sensitivity AS sens_medication, f.sensitivity AS sens_phase, a.sensitivity AS sens_airq,
                d.sensitivity AS sens_airq_prev_mean, mp.max_prev_attacks
         FROM s_med m JOIN s_phase f ON m.id = f.id JOIN s_airq a ON m.id = a.id JOIN s_prev d ON m.id = d.id LEFT JOIN mp ON m.id = mp.id)""")


@query("sensitivity_table", "id:bigint sens_medication:double sens_phase:double sens_airq:double sens_airq_prev_mean:double max_prev_attacks:double",
       SENS_TABLE_SQL + "\nSELECT * FROM st")
def sensitivity_table(spark, sf_dir):
    """Per-entity sensitivities to segment, phase, exposure and previous mean as columns, plus prior events."""
    return _sens_table(spark, sf_dir)


SENS_COLS = ["sens_medication", "sens_phase", "sens_airq", "sens_airq_prev_mean"]


def _corr_sql(cols, src):
    parts = [f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS c FROM {src}" for a in cols for b in cols]
    return "SELECT var_a, var_b, CASE WHEN isnan(c) THEN NULL ELSE c END AS corr FROM (" + " UNION ALL ".join(parts) + ") t"


@query("sensitivity_corr", "var_a:string var_b:string corr:double",
       SENS_TABLE_SQL + ", cc AS (SELECT * FROM st WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SENS_COLS) + ")\n"
       + _corr_sql(SENS_COLS, "cc"))
def sensitivity_corr(spark, sf_dir):
    """I8/A10: complete-case correlations of the sensitivity table."""
    return profile.correlation_matrix(_sens_table(spark, sf_dir), SENS_COLS, complete_cases=True)


def _ale_sql(feature: str, strata: bool, mode: str = "reference") -> str:
    probs = ", ".join(repr(i / 20) for i in range(21))
    if strata:
        rows = " UNION ALL ".join(f"SELECT '{lv}' AS stratum, {feature} AS x, design.* FROM design WHERE {lv} = 1" for lv in LEVELS)
    else:
        rows = f"SELECT 'all' AS stratum, {feature} AS x, design.* FROM design"
    div = "(SELECT count(*) FROM design)" if mode == "reference" else "j.nb"
    return D + f""", r AS ({rows}),
  ok AS (SELECT stratum FROM r GROUP BY stratum HAVING count(*) >= 10),
  e AS (SELECT stratum, quantile_cont(x, [{probs}]) AS q FROM r WHERE stratum IN (SELECT stratum FROM ok) GROUP BY stratum),
  bins AS (SELECT stratum, b, q[b + 1] AS lo, q[b + 2] AS hi FROM e, range(20) t(b)),
  j AS (SELECT r.stratum, bins.b, sum({logit_sql({feature: 'bins.hi'})} - {logit_sql({feature: 'bins.lo'})}) AS s, count(*) AS nb
        FROM r JOIN bins ON r.stratum = bins.stratum AND r.x >= bins.lo AND r.x < bins.hi GROUP BY r.stratum, bins.b),
  a AS (SELECT bins.stratum, bins.b, (bins.lo + bins.hi) / 2 AS mid, coalesce(j.s / {div}, 0.0) AS delta
        FROM bins LEFT JOIN j ON bins.stratum = j.stratum AND bins.b = j.b),
  c AS (SELECT stratum, b, mid, sum(delta) OVER (PARTITION BY stratum ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM a)
SELECT stratum, b AS bin, mid, cum - avg(cum) OVER (PARTITION BY stratum) AS ale FROM c"""


ALE_COLS = "stratum:string bin:bigint mid:double ale:double"


@query("ale_numeric", ALE_COLS, _ale_sql("z_airq", False))
def ale_numeric(spark, sf_dir):
    """ALE of the exposure, 20 quantile bins, reference divisor (all rows)."""
    return X.ale(design(spark, sf_dir), SCORER, "z_airq")


@query("ale_standard", ALE_COLS, _ale_sql("z_airq", False, "standard"))
def ale_standard(spark, sf_dir):
    """I3 (standard mode): per-bin mean difference."""
    return X.ale(design(spark, sf_dir), SCORER, "z_airq", mode="standard")


@query("ale_stratified", ALE_COLS, _ale_sql("z_dos", True))
def ale_stratified(spark, sf_dir):
    """I4: ALE of dos within each segment (edges per segment, strata under 10 rows skipped)."""
    return X.ale(design(spark, sf_dir), SCORER, "z_dos", strata=LEVELS)


SHAP_SQL = D + ", m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in FEATS) + " FROM design),\n" \
    + "  sl AS (" + " UNION ALL ".join(
        f"SELECT rownames, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {float(SCORER.beta(f))!r} * ({f} - m_{f}) AS phi FROM design, m"
        for f in FEATS) + "),\n  base AS (SELECT " + repr(float(SCORER.beta("intercept"))) + " + " + " + ".join(
        f"{float(SCORER.beta(f))!r} * m_{f}" for f in FEATS) + " AS base FROM m)"


@query("shap_linear", "rownames:bigint feature:string value:double phi:double base:double",
       SHAP_SQL + "\nSELECT sl.*, base.base FROM sl, base")
def shap_linear(spark, sf_dir):
    """Exact linear SHAP values (log-odds) against the full data as background."""
    return X.linear_shap(design(spark, sf_dir), SCORER, ["rownames"])


@query("shap_importance", "feature:string mean_abs_shap:double",
       SHAP_SQL + "\nSELECT feature, avg(abs(phi)) AS mean_abs_shap FROM sl GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 20")
def shap_importance(spark, sf_dir):
    """Top features by mean |SHAP|."""
    return X.shap_importance(X.linear_shap(design(spark, sf_dir), SCORER, ["rownames"]), 20)


@query("shap_row", "rownames:bigint feature:string value:double phi:double base:double",
       SHAP_SQL + "\nSELECT sl.*, base.base FROM sl, base WHERE rownames = (SELECT min(rownames) FROM design)")
def shap_row(spark, sf_dir):
    """The explanation of one row (the first row key) with its base value."""
    d = design(spark, sf_dir)
    first = d.agg(F.min("rownames").alias("rownames"))
    return X.linear_shap(d, SCORER, ["rownames"]).join(F.broadcast(first), "rownames")


N_PERMUTATIONS = 10


def _shap_sampled_sql(n_background: int = 200) -> str:
    """The same hashed feature orders: the scores along each order, and the change where a feature comes in."""
    p = len(FEATS)
    h = "CAST('0x' || substr(md5(concat_ws('|', '42', CAST(rownames AS VARCHAR))), 1, 15) AS BIGINT)"
    eta = " + ".join([repr(float(SCORER.beta("intercept")))] + [
        f"{float(SCORER.beta(f))!r} * CASE WHEN p{j} <= t THEN d.{f} ELSE bg.{f} END" for j, f in enumerate(FEATS)])
    base_eta = " + ".join([repr(float(SCORER.beta("intercept")))] + [f"{float(SCORER.beta(f))!r} * {f}" for f in FEATS])
    parts = " UNION ALL ".join(f"SELECT a.rownames, '{f}' AS feature, avg(a.v - b.v) AS phi FROM v a JOIN v b ON a.rownames = b.rownames AND a.k = b.k "
                               f"AND a.t = a.p{j} AND b.t = a.p{j} - 1 GROUP BY a.rownames" for j, f in enumerate(FEATS))
    return D + f""", bg AS (SELECT {', '.join(FEATS)} FROM design ORDER BY {h}, {', '.join(FEATS)} LIMIT {n_background}),
  base AS (SELECT avg(1.0 / (1.0 + exp(-({base_eta})))) AS base FROM bg),
  x0 AS (SELECT rownames, k, j, {h} AS h, xor({h} & 2147483647, ((k * {p} + j + 1) * 2654435761) & 2147483647) AS x FROM design, range({N_PERMUTATIONS}) a(k), range({p}) b(j)),
  x1 AS (SELECT rownames, k, j, xor({S.mix31_sql('x')}, h >> 31) AS x FROM x0),
  x2 AS (SELECT rownames, k, j, {S.mix31_sql('x')} AS x FROM x1),
  o AS (SELECT rownames, k, j, row_number() OVER (PARTITION BY rownames, k ORDER BY x, j) AS pos FROM x2),
  w AS (SELECT rownames, k, {', '.join(f'max(CASE WHEN j = {j} THEN pos END) AS p{j}' for j in range(p))} FROM o GROUP BY rownames, k),
  v AS (SELECT w.rownames, w.k, t, {', '.join(f'max(p{j}) AS p{j}' for j in range(p))}, avg(1.0 / (1.0 + exp(-({eta})))) AS v
        FROM w JOIN design d ON w.rownames = d.rownames, range({p + 1}) s(t), bg GROUP BY w.rownames, w.k, t)
SELECT s.rownames, s.feature, s.phi, base.base FROM ({parts}) s, base"""


@query("shap_sampled", "rownames:bigint feature:string phi:double base:double", _shap_sampled_sql(200))
def shap_sampled(spark, sf_dir):
    """Probability-scale Shapley values against a 200-row hashed background
    sample, by ten seeded permutations of the features per row (mapInPandas)."""
    return X.shapley_sampled(design(spark, sf_dir), SCORER, ["rownames"], 200, SEED, N_PERMUTATIONS)


PERM_SQL = D + """, fl AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}')" for f in FEATS) + """) t(feature)),
  dl AS (SELECT *, CAST(headache = 'yes' AS INTEGER) AS y FROM design WHERE headache IS NOT NULL),
  ids AS (SELECT DISTINCT id FROM dl),
  rp AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM ids),
  rh AS (SELECT feature, id AS src_id, row_number() OVER (PARTITION BY feature ORDER BY md5(concat_ws('|', '42', feature, CAST(id AS VARCHAR))), id) AS k
         FROM ids, fl),
  mp AS (SELECT rh.feature, rp.id, rh.src_id FROM rp JOIN rh ON rp.k = rh.k),
  ix AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rownames) - 1 AS ixn FROM dl),
  donors AS (SELECT id AS src_id, ixn, feature, donor_value FROM (UNPIVOT (SELECT id, ixn, """ + ", ".join(
    f"CAST({f} AS DOUBLE) AS {f}" for f in FEATS) + """ FROM ix) ON """ + ", ".join(FEATS) + """ INTO NAME feature VALUE donor_value)),
  sizes AS (SELECT id, count(*) AS n_src FROM dl GROUP BY id),
  dst AS (SELECT d.*, m.feature, m.src_id,
            CAST('0x' || substr(md5(concat_ws('|', '42', m.feature, CAST(d.rownames AS VARCHAR))), 1, 15) AS BIGINT) % s.n_src AS ixn_d
          FROM dl d JOIN mp m ON d.id = m.id JOIN sizes s ON s.id = m.src_id),
  perm AS (SELECT dst.feature, dst.y, CASE dst.feature """ + " ".join(
    f"WHEN '{f}' THEN {logit_sql({f: 'dn.donor_value'})}" for f in FEATS) + """ END AS p
           FROM dst JOIN donors dn ON dn.src_id = dst.src_id AND dn.ixn = dst.ixn_d AND dn.feature = dst.feature),
  base AS (SELECT 'baseline' AS feature, y, """ + logit_sql() + """ AS p FROM dl),
  allp AS (SELECT * FROM perm UNION ALL SELECT * FROM base),
  h AS (SELECT feature, p AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM allp GROUP BY feature, p),
  cd AS (SELECT *, sum(pos) OVER (PARTITION BY feature ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge,
                   sum(neg) OVER (PARTITION BY feature ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_ge,
                   sum(pos) OVER (PARTITION BY feature) AS P FROM h),
  tz AS (SELECT feature, sum(pos / P * (tp_ge / (tp_ge + fp_ge) + CASE WHEN tp_ge - pos + fp_ge - neg = 0 THEN 1.0
              ELSE (tp_ge - pos) / (tp_ge - pos + fp_ge - neg) END) / 2.0) AS prauc FROM cd GROUP BY feature)
SELECT t.feature AS "Variable", b.prauc - t.prauc AS "Importance" FROM tz t, (SELECT prauc FROM tz WHERE feature = 'baseline') b
WHERE t.feature <> 'baseline'"""


@query("perm_importance", "Variable:string Importance:double", PERM_SQL)
def perm_importance(spark, sf_dir):
    """Entity-block permutation importance (PR-AUC drop), all features in one job."""
    d = design(spark, sf_dir).where(F.col("headache").isNotNull()).withColumn("y", (F.col("headache") == "yes").cast("int"))
    return X.permutation_importance(d, SCORER, "y", "id", "rownames", FEATS, SEED)


ALE_FEATURES = ["z_airq", "z_prev"]
ALE_STRATA = {"none": None, "season": GROUPS["season"], "hatype": GROUPS["hatype"], "phase": GROUPS["phase"]}


def _ale_all_sql():
    probs = ", ".join(repr(i / 20) for i in range(21))
    keyed = " UNION ALL ".join(f"SELECT '{n}' AS strat, '{c}' AS stratum, * FROM design WHERE {'true' if c == 'all' else c + ' = 1'}"
                               for n, cols in ALE_STRATA.items() for c in (cols or ["all"]))
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, k.* FROM k" for f in ALE_FEATURES)
    at = lambda edge: logit_sql({f: f"CASE WHEN feature = '{f}' THEN bins.{edge} ELSE {f} END" for f in ALE_FEATURES}, FULL)
    return DF + f""", k AS ({keyed}), r AS ({rows}),
  e AS (SELECT feature, strat, stratum, quantile_cont(x, [{probs}]) AS q FROM r GROUP BY ALL HAVING count(*) >= 10),
  bins AS (SELECT feature AS bf, strat AS bs, stratum AS bt, b, q[b + 1] AS lo, q[b + 2] AS hi FROM e, range(20) t(b)),
  j AS (SELECT bf, bs, bt, b, sum({at('hi')} - {at('lo')}) AS s
        FROM r JOIN bins ON r.feature = bf AND r.strat = bs AND r.stratum = bt AND r.x >= bins.lo AND r.x < bins.hi GROUP BY bf, bs, bt, b),
  a AS (SELECT bins.*, coalesce(j.s / (SELECT count(*) FROM design), 0.0) AS delta FROM bins LEFT JOIN j USING (bf, bs, bt, b)),
  c AS (SELECT *, sum(delta) OVER (PARTITION BY bf, bs, bt ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM a)
SELECT bf AS feature, bs AS strat, bt AS stratum, b AS bin, (lo + hi) / 2 AS mid, cum - avg(cum) OVER (PARTITION BY bf, bs, bt) AS ale FROM c"""


@query("ale_all", "feature:string strat:string " + ALE_COLS, _ale_all_sql())
def ale_all(spark, sf_dir):
    """ALE of both exposures, over all rows and by season, subtype and phase, in one job."""
    return X.ale_many(full_design(spark, sf_dir), FULL, ALE_FEATURES, ALE_STRATA)
