"""Mergeable sketches of long KPI tables: stored per day, merged without reading the rows again.

Estimates only: the exact figures of ``profile`` stay the default. Distinct counts are HyperLogLog
sketches (relative standard error about ``1.04 / sqrt(2 ** lg_k)``), quantiles are KLL sketches (rank
error about ``2.3 / k``); a merged sketch has the error of a single one. Counts, extremes and days
are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
K = 800
KEYS = ("kpi_id",)


def daily_sketches(
    rows: DataFrame, distinct: str, value: str = "value", when: str = "event_time",
    keys: Sequence[str] = KEYS, lg_k: int = LG_K, k: int = K,
) -> DataFrame:
    """``keys, day, n, missing, minimum, maximum, distinct_sketch, value_sketch``, one row per key and
    day. NULL and NaN values are missing; rows without a time have the day NULL. Sketches are built
    map-side, so a key with most of the rows costs one sketch per task and day."""
    number = F.col(value).cast("double")
    number = F.when(~F.isnan(number), number)
    return rows.groupBy(*keys, F.to_date(when).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(number.isNull()).alias("missing"),
        F.min(number).alias("minimum"),
        F.max(number).alias("maximum"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), lg_k).alias("distinct_sketch"),
        F.kll_sketch_agg_double(number, k).alias("value_sketch"),
    )


def refresh_days(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored sketches with the days of ``fresh`` replaced: only new or changed days are read again."""
    days = F.broadcast(fresh.select(F.col("day").alias("_day")).distinct())
    return stored.join(days, F.col("day").eqNullSafe(F.col("_day")), "left_anti").unionByName(fresh)


def merged_sketches(sketches: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key from its days; with no keys, one row for all. Merges can be merged again."""
    days = F.countDistinct("day") if "day" in sketches.columns else F.sum("days")
    return sketches.groupBy(*keys).agg(
        days.alias("days"),
        F.sum("n").alias("n"),
        F.sum("missing").alias("missing"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def sketch_figures(
    merged: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), keys: Sequence[str] = KEYS
) -> DataFrame:
    """``keys, days, n, missing, minimum, maximum, distinct_estimate`` and one ``q_<percent>`` per quantile;
    quantiles are NULL for a key without values."""
    some = F.col("n") > F.col("missing")
    return merged.select(
        *keys, "days", "n", "missing", "minimum", "maximum",
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
        *[F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(q)))).alias(f"q_{round(100 * q)}")
          for q in quantiles],
    )
