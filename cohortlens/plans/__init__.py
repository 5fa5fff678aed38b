"""Registered queries. Importing this package registers every query module."""

from __future__ import annotations

import importlib

from cohortlens.plans.base import REGISTRY

_MODULES = [
    "q_features",
    "q_profile",
    "q_scores",
    "q_thresholds",
    "q_fairness",
    "q_models",
    "q_explain",
    "q_infer",
]

for _m in _MODULES:
    importlib.import_module(f"cohortlens.plans.{_m}")


def queries():
    return {name: q.fn for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
