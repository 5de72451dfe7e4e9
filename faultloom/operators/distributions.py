"""The tables behind the exploratory charts: record counts, histogram, box statistics, overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import label_name
from .joins import attach
from .profile import QUARTILES
from .quantiles import exact_quantiles, value_counts
from .slices import ROWS_PER_SLICE

WHISKER = 1.5


def kpi_record_counts(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("kpi_id").isNotNull())
        .groupBy("kpi_id")
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy("kpi_id")
    )


def label_counts(df: DataFrame) -> DataFrame | None:
    """Records per class name, most frequent first; None for an unlabelled table."""
    if "label" not in df.columns:
        return None
    return (
        df.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("records"))
        .select(label_name(F.col("label")).alias("category"), "records")
        .orderBy(F.col("records").desc(), "category")
    )


def value_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max], the last bin closed, empty bins included.

    The extremes are one row and reach the counting scan as a scalar subquery; counting combines
    map-side to ``bins`` groups.
    """
    values = df.select("value").where(F.col("value").isNotNull())
    low, high = F.min("value"), F.max("value")
    margin = F.when(low == high, 0.5).otherwise(0.0)
    limits = values.select(
        F.struct((low - margin).alias("lo"), (high + margin).alias("hi"))
    ).scalar()
    counts = (
        values.withColumn("_limits", limits)
        .select(
            F.least(
                F.width_bucket("value", F.col("_limits.lo"), F.col("_limits.hi"), F.lit(bins)),
                F.lit(bins),
            ).cast("int").alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    width = (F.col("_limits.hi") - F.col("_limits.lo")) / F.lit(bins)
    edges = (
        df.sparkSession.range(1, bins + 1, 1, 1)
        .select(F.col("id").cast("int").alias("bin"))
        .withColumn("_limits", limits)
        .select(
            "bin",
            (F.col("_limits.lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
            (F.col("_limits.lo") + F.col("bin") * width).alias("bin_hi"),
        )
    )
    return (
        edges.join(counts, "bin", "left")
        .select("bin", "bin_lo", "bin_hi",
                F.coalesce("frequency", F.lit(0).cast("bigint")).alias("frequency"))
        .orderBy("bin")
    )


def _fences(quartiles: DataFrame, whisker: float) -> DataFrame:
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    return quartiles.withColumns(
        {"fence_lo": F.col("q1") - reach, "fence_hi": F.col("q3") + reach}
    )


def _box(counts: DataFrame, keys: list[str]) -> DataFrame:
    v, inside = F.col("value"), F.col("value").between(F.col("fence_lo"), F.col("fence_hi"))
    return counts.groupBy(*keys, "q1", "median", "q3").agg(
        F.least(F.min(F.when(inside, v)), F.col("q1")).alias("whisker_lo"),
        F.greatest(F.max(F.when(inside, v)), F.col("q3")).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("bigint").alias("outliers"),
    )


def box_stats(
    df: DataFrame, whisker: float = WHISKER, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Quartiles, whiskers and number of outliers of all values, as one row."""
    counts = value_counts(df, [], "value")
    fences = _fences(exact_quantiles(counts, [], "value", QUARTILES, rows_per_slice), whisker)
    limits = fences.select(F.struct(*fences.columns)).scalar()
    with_fences = counts.withColumn("_f", limits).select("value", "n", "_f.*")
    return _box(with_fences, [])


def kpi_fences(
    df: DataFrame, whisker: float = WHISKER, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Quartiles and outlier fences per KPI ID."""
    counts = value_counts(df.where(F.col("kpi_id").isNotNull()), ["kpi_id"], "value")
    return _fences(
        exact_quantiles(counts, ["kpi_id"], "value", QUARTILES, rows_per_slice), whisker
    )


def box_stats_by_kpi(
    df: DataFrame, whisker: float = WHISKER, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``box_stats`` per KPI ID in one grouped pass, ordered by ID."""
    counts = value_counts(df.where(F.col("kpi_id").isNotNull()), ["kpi_id"], "value")
    fences = kpi_fences(df, whisker, rows_per_slice)
    return _box(attach(counts, fences, ["kpi_id"], ["value"]), ["kpi_id"]).orderBy("kpi_id")


def kpi_outliers(
    df: DataFrame,
    row_id: list[str],
    whisker: float = WHISKER,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The rows beyond their KPI's fences."""
    fences = kpi_fences(df, whisker, rows_per_slice).select("kpi_id", "fence_lo", "fence_hi")
    return (
        attach(df.select("kpi_id", *row_id, "value"), fences, ["kpi_id"], [*row_id, "value"])
        .where((F.col("value") < F.col("fence_lo")) | (F.col("value") > F.col("fence_hi")))
        .select("kpi_id", *row_id, "value")
    )


def series_overlay(df: DataFrame, bucket: str = "1 day", flag: str = "label") -> DataFrame:
    """A series thinned to time buckets, with a flag where a bucket holds an anomaly."""
    return (
        df.groupBy("kpi_id", F.window("event_time", bucket)["start"].alias("bucket"))
        .agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("avg"),
            F.max(flag).alias("flagged"),
        )
    )


def all_distributions(train: DataFrame, test: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every chart table as a lazy DataFrame, keyed ``<table>_<dataset>``."""
    tables: dict[str, DataFrame] = {}
    for name, df in (("training", train), ("testing", test)):
        if df is None:
            continue
        tables[f"kpi_record_counts_{name}"] = kpi_record_counts(df)
        tables[f"value_histogram_{name}"] = value_histogram(df)
        tables[f"box_stats_{name}"] = box_stats(df)
        tables[f"box_stats_by_kpi_{name}"] = box_stats_by_kpi(df)
    labels = label_counts(train)
    if labels is not None:
        tables["label_counts_training"] = labels
    return tables
