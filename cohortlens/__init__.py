"""cohortlens: entity-panel risk analytics as Spark DataFrame jobs.

Sub-packages:
    sources    readers, test-table views, sinks and model persistence
    functions  column expressions (scalar features, hash draws) and small
               driver-side math on bounded objects (p x p matrices, tails)
    operators  the analytics operators: windows, profiles, quantiles, score
               histograms, metrics, thresholds, bootstrap, calibration,
               fairness, GLMs, explanations
    plans      registered queries (Spark job + DuckDB oracle SQL)
    streaming  micro-batch scoring/metrics over a streaming source
"""

from cohortlens.spec import PanelSpec  # noqa: F401

__all__ = ["PanelSpec"]
