"""Size estimates that choose between two plans with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame


UNKNOWN_BYTES = 1 << 62


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate for the result of a plan. It comes from file sizes, runs no job,
    and is huge for inputs of unknown size such as local rows (and for remote sessions)."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return UNKNOWN_BYTES
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
