"""Binning of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def severity_bin(score: Column | str) -> Column:
    """CVSS score to low, medium, high, critical; a missing score is unknown."""
    s = nan_to_null((F.col(score) if isinstance(score, str) else score).cast("double"))
    return (
        F.when(s.isNull(), "unknown")
        .when(s < 4, "low")
        .when(s < 7, "medium")
        .when(s < 9, "high")
        .otherwise("critical")
    )


def level_bin(score: Column | str) -> Column:
    """Urgency level of a score; bins are closed left, NULL outside [0, 1.01)."""
    s = F.col(score) if isinstance(score, str) else score
    cuts = fixed.LEVEL_CUTS
    out = F.when((s < cuts[0]) | F.isnan(s), F.lit(None).cast("string"))
    for name, high in zip(fixed.LEVELS, cuts[1:]):
        out = out.when(s < high, name)
    return out


def level_rank(level: Column | str) -> Column:
    """Low 1, Medium 2, High 3, for ordering."""
    lv = F.col(level) if isinstance(level, str) else level
    out = None
    for i, name in enumerate(fixed.LEVELS, 1):
        out = F.when(lv == name, i) if out is None else out.when(lv == name, i)
    return out
