"""The status lattice: failed above manual_review above passed; not_applicable is neutral.

A value that is unknown is never a pass. An empty set of checks passes; an empty set of items does
not (``overall(..., items)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASSED, FAILED, REVIEW, NOT_APPLICABLE = "passed", "failed", "manual_review", "not_applicable"


def severity(status: Column) -> Column:
    return F.when(status == FAILED, 2).when(status == REVIEW, 1).otherwise(0)


def named(level: Column) -> Column:
    return F.when(level == 2, FAILED).when(level == 1, REVIEW).otherwise(PASSED)


def worst(status: Column, where: Column | None = None) -> Column:
    """Aggregate: the lattice's verdict over a group, or over its rows that meet ``where``."""
    level = severity(status) if where is None else F.when(where, severity(status))
    return named(F.coalesce(F.max(level), F.lit(0)))


def overall(status: Column, items: Column) -> Column:
    """As ``worst``, but without any item it is manual_review."""
    return F.when(F.coalesce(items, F.lit(0)) == 0, REVIEW).otherwise(worst(status))


def within(left: Column, right: Column, tolerance: str = "0.01") -> Column:
    """|left - right| <= tolerance, in exact decimals."""
    return F.abs(left - right) <= F.lit(tolerance).cast("decimal(18,2)")


def compared(unknown: Column, ok: Column, when_unknown: str = REVIEW) -> Column:
    """The null arm first, so that no row is lost to a null comparison."""
    return F.when(unknown, when_unknown).when(ok, PASSED).otherwise(FAILED)
