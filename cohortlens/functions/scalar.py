"""Row-level (scalar) features T1-T12 as JVM-side Column expressions.

Everything here stays inside whole-stage codegen: no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Study start date, season of each month, age band edges/labels,
# phase labels, target coding, clinical flag cut-offs.
STUDY_START = "1997-01-01"
SEASON_OF_MONTH = {
    12: "winter", 1: "winter", 2: "winter",
    3: "spring", 4: "spring", 5: "spring",
    6: "summer", 7: "summer", 8: "summer",
    9: "autumn", 10: "autumn", 11: "autumn",
}
AGE_BINS = [17, 30, 40, 50, 66]
AGE_LABELS = ["18-30", "31-40", "41-50", "51-66"]
PHASE_BEFORE = "No treatment"
PHASE_UNDER = "Under treatment"
TARGET_MAP = {"yes": 1, "no": 0}
CLINICAL_FLAGS = {
    "flag_high_prev_attacks": ("prev_attacks", 10),
    "flag_many_visits": ("visit_number", 5),
    "flag_recent_attacks": ("prev_attacks", 3),
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def phase(time="time") -> Column:
    """Time < 0 -> 'No treatment', else (including null time) 'Under treatment'."""
    return F.when(_c(time) < 0, F.lit(PHASE_BEFORE)).otherwise(F.lit(PHASE_UNDER))


def study_date(dos="dos") -> Column:
    """Study start + dos days."""
    return F.date_add(F.lit(STUDY_START).cast("date"), _c(dos).cast("int"))


def season_of(month: Column) -> Column:
    """T4: month -> season via a literal map (one codegen'd lookup)."""
    m = F.create_map(*[x for k, v in SEASON_OF_MONTH.items() for x in (F.lit(k), F.lit(v))])
    return m[month]


def age_band(age="age") -> Column:
    """T5: right-closed bands (17,30], (30,40], (40,50], (50,66]; outside or null -> null."""
    a = _c(age)
    expr = None
    for lo, hi, lab in zip(AGE_BINS[:-1], AGE_BINS[1:], AGE_LABELS):
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def target_numeric(target="headache") -> Column:
    """Yes -> 1, no -> 0, anything else -> null."""
    t = _c(target)
    return F.when(t == "yes", 1).when(t == "no", 0).cast("int")


def clinical_flags() -> dict[str, Column]:
    """0/1 flags on raw units (strictly greater than the cut-off)."""
    return {name: F.coalesce((F.col(src) > k), F.lit(False)).cast("int")
            for name, (src, k) in CLINICAL_FLAGS.items()}


def finite(p) -> Column:
    """Not null, not NaN, not infinite."""
    x = _c(p)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def hash_uniform(*parts) -> Column:
    """Deterministic U[0,1) draw from md5 of the key parts (60 bits).

    Portable: DuckDB computes the same value with
    ``cast('0x' || substr(md5(k), 1, 15) as bigint) / 1152921504606846976.0``.
    Independent of partitioning, so re-runs after executor loss give the same draw.
    """
    key = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint").cast("double") / F.lit(1152921504606846976.0)


def hash_int(*parts) -> Column:
    """Deterministic 60-bit integer from md5 of the key parts: rows share it by chance only beyond 10^9 of them."""
    key = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def equal_width_bin(x, vmin, vmax, bins: int) -> Column:
    """Index of x among ``bins`` equal-width bins from vmin to vmax, last bin closed,
    with the same edge corrections as NumPy's uniform-bin histogram: a first
    guess from (x - min) * (bins / width), then moved down/up by comparing with
    the explicit edges min + k * (width / bins) (the last edge is max)."""
    x, lo, hi = _c(x), _c(vmin), _c(vmax)
    width = hi - lo
    guess = F.floor((x - lo) * (F.lit(float(bins)) / width)).cast("bigint")
    guess = F.when(guess >= bins, F.lit(bins - 1)).otherwise(guess)

    def edge(k):
        return F.when(k >= bins, hi).otherwise(lo + k.cast("double") * (width / F.lit(float(bins))))
    down = F.when(x < edge(guess), guess - 1).otherwise(guess)
    up = F.when((down != bins - 1) & (x >= edge(down + 1)), down + 1).otherwise(down)
    return F.when(width == 0, F.lit(0).cast("bigint")).otherwise(up)
