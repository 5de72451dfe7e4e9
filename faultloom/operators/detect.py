"""Threshold detection on KPI series: adaptive range, spike / drop tagging, anomaly runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import add_rolling
from .slices import ROWS_PER_SLICE, SLICES, Series, lookback_series
from .staging import staged

HISTORY = 10
WIDTH = 3.0
PERSISTENT = 3


def _with_range(
    df: DataFrame,
    ties: Sequence[str],
    history: int,
    width: float,
    extra_depth: int,
    rows_per_slice: int,
) -> Series:
    """Rows with ``lower``, ``upper`` and ``kind``. ``extra_depth`` more rows are carried into
    each slice, so that many of the carried rows see their own full history as well."""
    series = lookback_series(
        df, ["kpi_id"], ["event_time", *ties], history + extra_depth, rows_per_slice
    )
    rows = add_rolling(series.rows, series.window, "value", {"_recent": (1, history)})
    reach = F.lit(width) * F.col("_recent_std")
    rows = rows.withColumns(
        {"lower": F.col("_recent_mean") - reach, "upper": F.col("_recent_mean") + reach}
    ).drop("_recent_mean", "_recent_std")
    kind = F.when(F.col("value") > F.col("upper"), "spike").when(
        F.col("value") < F.col("lower"), "drop"
    )
    return Series(rows.withColumn("kind", kind), series.window)


def adaptive_threshold(
    df: DataFrame,
    ties: Sequence[str] = (),
    history: int = HISTORY,
    width: float = WIDTH,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Flags values outside mean ± ``width`` deviations of the ``history`` preceding values.
    A row without a full history has no range and is not flagged."""
    series = _with_range(df, ties, history, width, 0, rows_per_slice)
    flagged = F.col("kind").isNotNull().cast("int")
    return series.finish(series.rows.withColumn("flagged", flagged))


def anomaly_runs(
    df: DataFrame,
    ties: Sequence[str] = (),
    history: int = HISTORY,
    width: float = WIDTH,
    persistent: int = PERSISTENT,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Maximal runs of consecutive rows of the same kind; runs of at least ``persistent`` rows
    are ``persistent_spike`` / ``persistent_drop``.

    Runs are numbered inside each slice and reduced there first; the numbers of earlier slices are
    then added, which joins the parts of a run that crosses slices.
    """
    series = _with_range(df, ties, history, width, 1, rows_per_slice)
    changed = (
        ~F.col("kind").eqNullSafe(F.lag("kind").over(series.window))
    ).cast("int")
    so_far = series.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        series.rows.withColumn("_changed", F.when(F.col("_carried"), 0).otherwise(changed))
        .withColumn("_local", F.sum("_changed").over(so_far))
        .where(~F.col("_carried"))
    )
    # Read twice, for the numbers of the slices and for the runs; the windows run once.
    parts = staged(rows.groupBy("kpi_id", *SLICES, "_local").agg(
        F.min("event_time").alias("run_start"),
        F.max("event_time").alias("run_end"),
        F.count(F.lit(1)).alias("run_length"),
        F.max("kind").alias("kind"),
    ))
    earlier = (
        Window.partitionBy("kpi_id").orderBy(*SLICES).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.groupBy("kpi_id", *SLICES).agg(F.max("_local").alias("_changes")).select(
        F.col("kpi_id").alias("_kpi_id"),
        *[F.col(s).alias(f"_of{s}") for s in SLICES],
        F.coalesce(F.sum("_changes").over(earlier), F.lit(0)).alias("_offset"),
    )
    same_slice = F.col("kpi_id").eqNullSafe(F.col("_kpi_id"))
    for s in SLICES:
        same_slice = same_slice & (F.col(s) == F.col(f"_of{s}"))
    length = F.col("run_length")
    return (
        parts.where(F.col("kind").isNotNull())
        .join(offsets, same_slice)
        .groupBy("kpi_id", (F.col("_local") + F.col("_offset")).alias("_run"))
        .agg(
            F.min("run_start").alias("run_start"),
            F.max("run_end").alias("run_end"),
            F.sum("run_length").alias("run_length"),
            F.max("kind").alias("kind"),
        )
        .select(
            "kpi_id", "run_start", "run_end", "run_length",
            F.when(length >= persistent, F.concat(F.lit("persistent_"), "kind"))
            .otherwise(F.col("kind")).alias("kind"),
        )
    )
