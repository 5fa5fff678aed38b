"""Column roles of an entity panel (one row per entity visit)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    """Names of the columns an operator needs.

    ``order`` must make rows unique within an entity (end it with the row key);
    Spark has no implicit file order, so every history window orders by it.
    """

    id: str = "id"
    row_key: str = "rownames"
    time: str = "time"
    dos: str = "dos"
    target: str = "headache"
    target_num: str = "target_num"
    order: tuple[str, ...] = ("rownames",)
    num: tuple[str, ...] = ("prev_attacks", "visit_number", "days_since_first_visit", "airq", "airq_prev_mean")
    cat: tuple[str, ...] = ("hatype", "medication", "sex", "study_season", "phase", "age_band")
    drop: tuple[str, ...] = field(default_factory=tuple)


# The reference's feature lists (numeric, then categorical).
DEFAULT_SPEC = PanelSpec()
