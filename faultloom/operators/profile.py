"""Dataset profiles: per-KPI and dataset-level counts, timestamps and descriptive statistics.

Training and test rows are tagged and aggregated together, so a report over both tables takes one
pass, and dataset figures are rolled up from the per-KPI aggregate of that pass; only the number of
distinct timestamps and the quantiles need another one.
All functions take the series form ``kpi_id, event_time, value[, label]``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import class_imbalance, epoch_micros, label_name, percentage
from .quantiles import exact_quantiles, value_counts
from .slices import ROWS_PER_SLICE

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
NO_LABELS = "N/A (No labels)"


TRAINING, TESTING = "Training", "Testing"


def _tagged(train: DataFrame, test: DataFrame | None, *columns: str) -> DataFrame:
    """Both tables in one, with ``dataset`` naming the table; absent columns are NULL."""
    rows = None
    for name, df in ((TRAINING, train), (TESTING, test)):
        if df is not None:
            kept = df.select(F.lit(name).alias("dataset"), *[c for c in columns if c in df.columns])
            rows = kept if rows is None else rows.unionByName(kept, allowMissingColumns=True)
    return rows


def _labelled(train: DataFrame, test: DataFrame | None) -> list[str]:
    tables = ((TRAINING, train), (TESTING, test))
    return [name for name, df in tables if df is not None and "label" in df.columns]


def span_seconds(df: DataFrame, first: str, last: str) -> Column:
    """Seconds between two columns that hold aggregated ``event_time`` values of ``df``."""
    kind = df.schema["event_time"].dataType
    return (epoch_micros(last, kind) - epoch_micros(first, kind)) / F.lit(1e6)


def _record_figures(rows: DataFrame) -> list[Column]:
    """Rows, anomalies, normal rows, first and last time; without labels their counts are NULL."""
    if "label" in rows.columns:
        label = F.col("label")
        classes = [F.count_if(label == 1).alias("anomalies"), F.count_if(label == 0).alias("normals")]
    else:
        missing = F.max(F.lit(None).cast("bigint"))
        classes = [missing.alias("anomalies"), missing.alias("normals")]
    return [
        F.count(F.lit(1)).alias("records"),
        *classes,
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    ]


def kpi_records(df: DataFrame) -> DataFrame:
    """Rows, anomalies, normal rows, first and last time per KPI ID (a NULL ID is one group)."""
    return df.groupBy("kpi_id").agg(*_record_figures(df))


def kpi_distribution(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row per KPI ID of either table, training and test figures side by side."""
    rows = _tagged(train, test, "kpi_id", "event_time", "label").where(F.col("kpi_id").isNotNull())
    in_train, in_test = F.col("dataset") == TRAINING, F.col("dataset") == TESTING
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int")
    train_time, test_time = (F.when(c, F.col("event_time")) for c in (in_train, in_test))
    return (
        rows.groupBy("kpi_id")
        .agg(
            F.count_if(in_train).alias("train_records"),
            F.count_if(in_train & (label == 1)).alias("train_anomalies"),
            F.count_if(in_test).alias("test_records"),
            F.min(train_time).alias("train_first"),
            F.max(train_time).alias("train_last"),
            F.min(test_time).alias("test_first"),
            F.max(test_time).alias("test_last"),
        )
        .withColumn(
            "train_anomaly_pct",
            F.round(percentage(F.col("train_anomalies"), F.col("train_records")), 2),
        )
        .orderBy("kpi_id")
    )


def summary_records(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """One flat row per dataset."""
    rows = _tagged(train, test, "kpi_id", "event_time", "label")
    labelled = F.col("dataset").isin(_labelled(train, test))
    columns = F.when(F.col("dataset") == TRAINING, len(train.columns)).otherwise(
        len((train if test is None else test).columns))
    per_kpi = rows.groupBy("dataset", "kpi_id").agg(*_record_figures(rows))
    rolled = per_kpi.groupBy("dataset").agg(
        F.sum("records").alias("total_records"),
        F.count("kpi_id").alias("kpi_count"),
        F.sum("anomalies").alias("anomaly_count"),
        F.sum("normals").alias("normal_count"),
        F.min("first_time").alias("min_timestamp"),
        F.max("last_time").alias("max_timestamp"),
    )
    times = rows.where(F.col("event_time").isNotNull()).select("dataset", "event_time").distinct()
    unique = times.groupBy("dataset").agg(F.count(F.lit(1)).alias("unique_timestamps"))
    with_times = rolled.join(unique, "dataset", "left").withColumns(
        {
            "anomaly_count": F.when(labelled, F.col("anomaly_count")),
            "normal_count": F.when(labelled, F.col("normal_count")),
        }
    ).withColumn("anomaly_percentage", percentage(F.col("anomaly_count"), F.col("total_records")))
    return with_times.select(
        "dataset",
        "total_records",
        columns.alias("total_columns"),
        "kpi_count",
        "anomaly_count",
        "normal_count",
        "anomaly_percentage",
        class_imbalance(F.col("anomaly_percentage")).alias("class_imbalance"),
        "min_timestamp",
        "max_timestamp",
        (F.col("max_timestamp") - F.col("min_timestamp")).alias("time_span"),
        F.coalesce("unique_timestamps", F.lit(0).cast("bigint")).alias("unique_timestamps"),
    )


def summary_record(df: DataFrame) -> DataFrame:
    """The dataset as one flat row."""
    return summary_records(df).drop("dataset")


def side_by_side(long: DataFrame, name: str) -> DataFrame:
    """``dataset, name, value`` rows of a few fixed names as ``name, training, testing``."""
    value = F.col("value")
    return long.groupBy(name).agg(
        F.max(F.when(F.col("dataset") == TRAINING, value)).alias("training"),
        F.max(F.when(F.col("dataset") == TESTING, value)).alias("testing"),
    )


def dataset_summary(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """Dataset figures as numbers: ``metric, training, testing``; times in epoch seconds, label
    figures NULL for an unlabelled table."""
    kind = train.schema["event_time"].dataType
    wide = summary_records(train, test).select(
        "dataset",
        F.col("total_records").alias("rows"),
        F.col("total_columns").alias("columns"),
        F.col("kpi_count").alias("kpi_ids"),
        F.col("anomaly_count").alias("anomalies"),
        F.col("normal_count").alias("normal_records"),
        F.round("anomaly_percentage", 6).alias("anomaly_percentage"),
        (epoch_micros("min_timestamp", kind) / 1e6).alias("min_timestamp"),
        (epoch_micros("max_timestamp", kind) / 1e6).alias("max_timestamp"),
        span_seconds(train, "min_timestamp", "max_timestamp").alias("span_seconds"),
        F.col("unique_timestamps"),
    )
    figures = [c for c in wide.columns if c != "dataset"]
    wide = wide.withColumns({c: F.col(c).cast("double") for c in figures})
    return side_by_side(wide.unpivot(["dataset"], figures, "metric", "value"), "metric")


def timestamp_analysis(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """First and last time, span and distinct times, one row per dataset."""
    rows = _tagged(train, test, "event_time").where(F.col("event_time").isNotNull())
    return (
        rows.distinct()
        .groupBy("dataset")
        .agg(
            F.min("event_time").alias("first_ts"),
            F.max("event_time").alias("last_ts"),
            F.count(F.lit(1)).alias("unique_timestamps"),
        )
        .withColumn("span_seconds", span_seconds(train, "first_ts", "last_ts"))
    )


# Statistic names of the report, in its (alphabetical) order.
STATISTICS: Mapping[str, str] = {
    "25th Percentile": "q1",
    "75th Percentile": "q3",
    "Count": "count",
    "IQR": "iqr",
    "Max": "max",
    "Mean": "mean",
    "Median": "median",
    "Min": "min",
    "Std Dev": "std",
}


def descriptive_statistics(
    train: DataFrame, test: DataFrame | None = None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Count, extremes, mean, quartiles, IQR and sample deviation: ``statistic, training,
    testing`` sorted by name."""
    rows = _tagged(train, test, "value")
    moments = rows.groupBy("dataset").agg(
        F.count("value").cast("double").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    quartiles = exact_quantiles(
        value_counts(rows, ["dataset"], "value"), ["dataset"], "value", QUARTILES, rows_per_slice
    ).withColumn("iqr", F.col("q3") - F.col("q1"))

    def long(wide: DataFrame) -> DataFrame:
        named = wide.withColumnsRenamed({column: name for name, column in STATISTICS.items()})
        figures = [c for c in named.columns if c != "dataset"]
        return named.unpivot(["dataset"], figures, "statistic", "value")

    return side_by_side(long(moments).unionByName(long(quartiles)), "statistic").orderBy("statistic")


def label_distribution(df: DataFrame) -> DataFrame:
    """``label, count, percentage`` for the classes Normal and Anomaly (and any other code)."""
    counts = (
        df.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    )
    total = counts.select(F.sum("count")).scalar()
    return counts.select(
        label_name(F.col("label")).alias("label"),
        "count",
        F.round(percentage(F.col("count"), total), 2).alias("percentage"),
    ).orderBy(F.col("count").desc(), "label")
