"""The batch analysis: load, validate, report, profile and chart tables of one data directory."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distributions, profile, quality
from ..sources import (
    UNLABELLED_COLUMNS,
    load_both,
    to_series,
    write_json_object,
    write_report,
    write_table,
)
from ..sources.kpi import KPI_ID

log = logging.getLogger("faultloom")


def _text_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _text_span(c: Column) -> Column:
    seconds = F.floor(c).cast("bigint")
    return F.format_string(
        "%d days %02d:%02d:%02d",
        F.floor(seconds / 86400).cast("bigint"),
        (F.floor(seconds / 3600) % 24).cast("bigint"),
        (F.floor(seconds / 60) % 60).cast("bigint"),
        seconds % 60,
    )


def _metric_rows(
    records: DataFrame, metrics: dict[str, Column], both: bool
) -> DataFrame:
    """``Metric, Training[, Testing]`` of text metrics, in the order given, from one row per
    dataset."""
    pairs = [
        F.struct(F.lit(i).alias("_at"), F.lit(m).alias("Metric"), c.alias("value"))
        for i, (m, c) in enumerate(metrics.items())
    ]
    long = records.select("dataset", F.inline(F.array(*pairs)))
    shown = [profile.TRAINING, profile.TESTING] if both else [profile.TRAINING]
    sides = [F.max(F.when(F.col("dataset") == d, F.col("value"))).alias(d) for d in shown]
    return long.groupBy("_at", "Metric").agg(*sides).orderBy("_at").drop("_at")


def summary_report(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    records = profile.summary_records(train, test).withColumn(
        "span_seconds", profile.span_seconds(train, "min_timestamp", "max_timestamp")
    )

    def label_text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(profile.NO_LABELS))

    pct = F.col("anomaly_percentage")
    # Metric names of the report, in its order.
    metrics = {
        "Number of Rows": F.col("total_records").cast("string"),
        "Number of Columns": F.col("total_columns").cast("string"),
        "Number of KPI IDs": F.col("kpi_count").cast("string"),
        "Number of Anomalies": label_text(F.col("anomaly_count")),
        "Number of Normal Records": label_text(F.col("normal_count")),
        "Anomaly Percentage (%)": label_text(F.when(pct.isNotNull(), F.format_string("%.2f", pct))),
        "Class Imbalance": label_text(F.col("class_imbalance")),
        "Min Timestamp": _text_time(F.col("min_timestamp")),
        "Max Timestamp": _text_time(F.col("max_timestamp")),
        "Time Span": _text_span(F.col("span_seconds")),
    }
    return _metric_rows(records, metrics, test is not None)


def timestamp_report(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    # Metric names of the report, in its order.
    metrics = {
        "First Timestamp": _text_time(F.col("first_ts")),
        "Last Timestamp": _text_time(F.col("last_ts")),
        "Time Span": _text_span(F.col("span_seconds")),
        "Number of Unique Timestamps": F.col("unique_timestamps").cast("string"),
    }
    return _metric_rows(profile.timestamp_analysis(train, test), metrics, test is not None)


def statistics_report(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    columns = [F.col("statistic").alias("Statistic"), F.col("training").alias("Training")]
    if test is not None:
        columns.append(F.col("testing").alias("Testing"))
    return profile.descriptive_statistics(train, test).select(*columns)


def kpi_report(train: DataFrame, test: DataFrame) -> DataFrame:
    # Column names of the report, in its order.
    return profile.kpi_distribution(train, test).select(
        F.col("kpi_id").alias("KPI ID"),
        F.col("train_records").alias("Train Records"),
        F.col("train_anomalies").alias("Train Anomalies"),
        F.format_string("%.2f", F.coalesce("train_anomaly_pct", F.lit(0.0))).alias(
            "Train Anomaly %"
        ),
        F.col("test_records").alias("Test Records"),
        _text_time(F.col("train_first")).alias("Train First Timestamp"),
        _text_time(F.col("train_last")).alias("Train Last Timestamp"),
        _text_time(F.col("test_first")).alias("Test First Timestamp"),
        _text_time(F.col("test_last")).alias("Test Last Timestamp"),
    )


def label_report(train: DataFrame) -> DataFrame:
    return profile.label_distribution(train).select(
        F.col("label").alias("Label"),
        F.col("count").alias("Count"),
        F.format_string("%.2f", "percentage").alias("Percentage"),
    )


def summary_statistics(df: DataFrame) -> dict:
    """The dataset summary as a dictionary."""
    return profile.summary_record(df).first().asDict()


def save_all_reports(
    train: DataFrame, test: DataFrame, directory: str, single_file: bool = False
) -> None:
    """Writes the five CSV reports and the JSON summary of the training table. ``single_file``
    makes the report with a row per KPI one file instead of part files."""
    write_report(summary_report(train, test), directory, "dataset_summary")
    write_report(statistics_report(train, test), directory, "descriptive_statistics")
    write_table(kpi_report(train, test), directory, "kpi_distribution", ["KPI ID"], single_file)
    if "label" in train.columns:
        write_report(label_report(train), directory, "anomaly_distribution")
    write_report(timestamp_report(train, test), directory, "timestamp_analysis")
    record = profile.summary_record(train)
    span = profile.span_seconds(train, "min_timestamp", "max_timestamp")
    texts = {
        "time_span": _text_span(span),
        "min_timestamp": _text_time(F.col("min_timestamp")),
        "max_timestamp": _text_time(F.col("max_timestamp")),
    }
    write_json_object(record.withColumns(texts), directory, "dataset_summary")


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table as Parquet and reads it back, so that later passes scan only the columns
    they need instead of parsing text again, and a lost executor costs a re-read."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def staging_folder(spark: SparkSession, report_dir: str) -> str:
    """The shared folder the cluster names for checkpoints, else one next to the reports."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/kpi_series" if shared else f"{report_dir.rstrip('/')}/_series"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system it is, if it exists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_analysis(
    spark: SparkSession, data_dir: str, report_dir: str, single_file: bool = False
) -> bool:
    """Runs the whole analysis. The validation report is written even when validation fails; the
    profile and chart tables only follow when both tables are valid. ``single_file``: reports with
    a row per KPI as one file each. The staged tables are removed at the end."""
    loaded = load_both(spark, data_dir, as_text=True)
    for error in loaded.errors:
        log.error("%s", error)
    if loaded.train_df is None or loaded.test_df is None:
        return False
    base = str(report_dir).rstrip("/")
    train_result = quality.validate(loaded.train_df, labelled=True)
    test_result = quality.validate(loaded.test_df, labelled=False)
    train, test = loaded.train_df, loaded.test_df
    complete = all(set(UNLABELLED_COLUMNS) <= set(df.columns) for df in (train, test))
    folder = f"{staging_folder(spark, base)}/{uuid.uuid4().hex}"
    try:
        if complete:
            train = stage(to_series(train), folder, "train")
            test = stage(to_series(test), folder, "test")
        ids = quality.compare_kpi_ids(train, test, "kpi_id" if complete else KPI_ID)
        for name in ("train", "test", "overlap", "new"):
            write_table(ids[f"{name}_df"], base, f"kpi_ids_{name}", ["kpi_id"], single_file)
        quality.write_validation_report(
            spark, train_result, test_result, ids, f"{base}/validation_report.txt"
        )
        for result in (train_result, test_result):
            log.info("%s", result.summary())
        if not (train_result.is_valid and test_result.is_valid):
            return False

        save_all_reports(train, test, base, single_file)
        for name, frame in distributions.all_distributions(train, test).items():
            if "kpi_id" in frame.columns:
                write_table(frame, f"{base}/plots", name, ["kpi_id"], single_file)
            else:
                write_report(frame, f"{base}/plots", name)
        return True
    finally:
        remove(spark, folder)
