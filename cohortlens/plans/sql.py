"""DuckDB SQL fragments for the oracle: the same views the Spark side builds."""

PANEL = """panel AS (
  SELECT o_orderkey AS rownames, o_custkey AS id,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS dos,
         CAST(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS time,
         o_orderpriority AS hatype, c_mktsegment AS medication,
         CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex,
         CAST(18 + 2 * c_nationkey AS BIGINT) AS age,
         o_totalprice AS airq,
         CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS headache
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SCALAR = """scal AS (
  SELECT *,
    CASE WHEN time < 0 THEN 'No treatment' ELSE 'Under treatment' END AS phase,
    CAST(DATE '1997-01-01' + CAST(dos AS INTEGER) AS DATE) AS study_date,
    month(DATE '1997-01-01' + CAST(dos AS INTEGER)) AS study_month,
    CASE WHEN month(DATE '1997-01-01' + CAST(dos AS INTEGER)) IN (12, 1, 2) THEN 'winter'
         WHEN month(DATE '1997-01-01' + CAST(dos AS INTEGER)) IN (3, 4, 5) THEN 'spring'
         WHEN month(DATE '1997-01-01' + CAST(dos AS INTEGER)) IN (6, 7, 8) THEN 'summer'
         WHEN month(DATE '1997-01-01' + CAST(dos AS INTEGER)) IN (9, 10, 11) THEN 'autumn' END AS study_season,
    CASE WHEN age > 17 AND age <= 30 THEN '18-30' WHEN age > 30 AND age <= 40 THEN '31-40'
         WHEN age > 40 AND age <= 50 THEN '41-50' WHEN age > 50 AND age <= 66 THEN '51-66' END AS age_band,
    CASE WHEN headache = 'yes' THEN 1 WHEN headache = 'no' THEN 0 END AS target_num
  FROM panel)"""

FEAT = """feat AS (
  SELECT *,
    dos - min(dos) OVER (PARTITION BY id) AS days_since_first_visit,
    row_number() OVER (PARTITION BY id ORDER BY rownames) AS visit_number,
    avg(airq) OVER (PARTITION BY id ORDER BY rownames ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS airq_prev_mean,
    CAST(coalesce(sum(target_num) OVER (PARTITION BY id ORDER BY time, rownames
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS prev_attacks
  FROM scal)"""

SCORE = """score AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS id, l_extendedprice,
         l_linestatus AS grp,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y_true,
         l_discount * 10.0 AS y_prob,
         l_extendedprice / 105000.0 AS y_cont
  FROM lineitem)"""

SCORES_LONG = """scores_long AS (
  SELECT 'bucketed' AS model, grp, y_true, y_prob FROM score
  UNION ALL
  SELECT 'continuous' AS model, grp, y_true, y_cont AS y_prob FROM score)"""

DESIGN = """design AS (
  SELECT *,
    (airq - 250000.0) / 150000.0 AS z_airq,
    (CAST(dos AS DOUBLE) - 1200.0) / 700.0 AS z_dos,
    CAST(medication = 'BUILDING' AS DOUBLE) AS d_BUILDING,
    CAST(medication = 'MACHINERY' AS DOUBLE) AS d_MACHINERY,
    CAST(medication = 'FURNITURE' AS DOUBLE) AS d_FURNITURE,
    CAST(medication = 'HOUSEHOLD' AS DOUBLE) AS d_HOUSEHOLD
  FROM panel)"""

LOGIT_EXPR = ("1.0 / (1.0 + exp(-(-0.4 + 0.8 * z_airq - 0.3 * z_dos + 0.5 * d_BUILDING"
              " - 0.2 * d_MACHINERY + 0.1 * d_FURNITURE + 0.0 * d_HOUSEHOLD)))")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def metrics_sql(src: str, keys: list[str], thr: float = 0.5, prefix: str = "m") -> str:
    """CTE chain (starts with a comma) ending in ``<prefix>t``: keys + the ten metric
    columns from a weighted row table ``src(keys..., y_true, y_prob, w)``.
    Written independently of the Spark code: descending windows for curve
    sums, a join to explicit bin edges for ECE."""
    k = ", ".join(keys)

    def q(a):
        return ", ".join(f"{a}.{x}" for x in keys)

    def on(a, b):
        return " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)

    return f""",
  {prefix}h AS (SELECT {k}, y_prob AS s, sum(w * y_true) AS pos, sum(w * (1 - y_true)) AS neg FROM {src}
         WHERE y_prob IS NOT NULL AND NOT isnan(y_prob) GROUP BY {k}, y_prob),
  {prefix}c AS (SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge,
                   sum(neg) OVER (PARTITION BY {k} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_ge,
                   sum(pos) OVER (PARTITION BY {k}) AS P, sum(neg) OVER (PARTITION BY {k}) AS N FROM {prefix}h),
  {prefix}a AS (SELECT {k}, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp_ge + 0.5 * neg)) / (max(P) * max(N)) END AS roc_auc,
                CASE WHEN max(P) > 0 THEN sum(pos / P * tp_ge / (tp_ge + fp_ge)) END AS pr_auc FROM {prefix}c GROUP BY {k}),
  {prefix}b AS (SELECT {k}, sum(w * (y_true - y_prob) * (y_true - y_prob)) / sum(w) AS brier,
                sum(CASE WHEN y_true = 1 AND y_prob >= {thr!r} THEN w ELSE 0 END) AS tp,
                sum(CASE WHEN y_true = 0 AND y_prob >= {thr!r} THEN w ELSE 0 END) AS fp,
                sum(CASE WHEN y_true = 1 AND y_prob < {thr!r} THEN w ELSE 0 END) AS fn,
                sum(CASE WHEN y_true = 0 AND y_prob < {thr!r} THEN w ELSE 0 END) AS tn,
                sum(w) AS n FROM {src} GROUP BY {k}),
  {prefix}bins AS (SELECT i, i * 0.1::DOUBLE AS lo, CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM range(10) t(i)),
  {prefix}e1 AS (SELECT {q('s')}, b.i, sum(w * y_true) / sum(w) AS acc, sum(w * y_prob) / sum(w) AS conf, sum(w) AS nb
          FROM {src} s JOIN {prefix}bins b ON s.y_prob >= b.lo AND s.y_prob < b.hi GROUP BY {q('s')}, b.i),
  {prefix}e AS (SELECT {q('e')}, sum(abs(e.acc - e.conf) * e.nb / b.n) AS ece FROM {prefix}e1 e JOIN {prefix}b b ON {on('e', 'b')} GROUP BY {q('e')}),
  {prefix}t AS (SELECT {q('b')}, a.roc_auc, a.pr_auc, b.brier, coalesce(e.ece, 0.0) AS ece, b.tp, b.tn, b.fp, b.fn,
                coalesce(b.tp / nullif(b.tp + b.fp, 0), 0.0) AS precision,
                coalesce(b.tp / nullif(b.tp + b.fn, 0), 0.0) AS sensitivity
         FROM {prefix}b b JOIN {prefix}a a ON {on('b', 'a')} LEFT JOIN {prefix}e e ON {on('b', 'e')})"""


def mix31_sql(x: str) -> str:
    """The 31-bit integer hash of ``bootstrap.mix31`` as nested DuckDB expressions."""
    a = f"xor({x}, {x} >> 15)"
    b = f"(({a}) * 739982445) & 2147483647"
    c = f"xor({b}, ({b}) >> 12)"
    d = f"(({c}) * 695872825) & 2147483647"
    return f"xor({d}, ({d}) >> 15)"



def equal_width_bin_sql(x: str, lo: str, hi: str, bins: int = 20) -> str:
    """DuckDB form of ``scalar.equal_width_bin`` (NumPy's uniform-bin rule)."""
    g0 = f"CAST(floor(({x} - {lo}) * ({float(bins)!r} / ({hi} - {lo}))) AS BIGINT)"
    g = f"(CASE WHEN {g0} >= {bins} THEN {bins - 1} ELSE {g0} END)"

    def edge(k):
        return f"(CASE WHEN ({k}) >= {bins} THEN {hi} ELSE {lo} + CAST({k} AS DOUBLE) * (({hi} - {lo}) / {float(bins)!r}) END)"
    down = f"(CASE WHEN {x} < {edge(g)} THEN {g} - 1 ELSE {g} END)"
    up = f"(CASE WHEN {down} <> {bins - 1} AND {x} >= {edge(down + ' + 1')} THEN {down} + 1 ELSE {down} END)"
    return f"CAST(CASE WHEN {hi} = {lo} THEN 0 ELSE {up} END AS BIGINT)"
