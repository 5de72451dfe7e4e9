"""The four preprocessed log files: block labels, occurrence matrix, event traces, templates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File names of the public log dataset.
LABEL_FILE = "anomaly_label.csv"
OCCURRENCE_FILE = "Event_occurrence_matrix.csv"
TRACE_FILE = "Event_traces.csv"
TEMPLATE_FILE = "HDFS.log_templates.csv"


class LogTables(NamedTuple):
    labels: DataFrame
    occurrences: DataFrame
    traces: DataFrame
    templates: DataFrame


def _named(df: DataFrame, *names: str) -> DataFrame:
    """Leading columns renamed by position; the files do not agree on their spelling."""
    return df.withColumnsRenamed(dict(zip(df.columns, names, strict=False)))


def parse_trace(text):
    """``[E5,E22,E5]`` as an array of event ids."""
    inner = F.regexp_replace(text, r"[\[\]\s'\"]", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def load_logs(spark: SparkSession, directory: str) -> LogTables:
    base = str(directory).rstrip("/")

    def scan(name: str) -> DataFrame:
        return spark.read.option("header", True).csv(f"{base}/{name}")

    counts = _named(scan(OCCURRENCE_FILE), "block_id", "label")
    events = [c for c in counts.columns if c not in ("block_id", "label")]
    traces = scan(TRACE_FILE)
    trace_column = next(c for c in traces.columns if c.lower() in ("features", "trace", "events"))
    return LogTables(
        labels=_named(scan(LABEL_FILE), "block_id", "label"),
        occurrences=counts.select(
            "block_id", "label", *[F.col(f"`{c}`").try_cast("int").alias(c) for c in events]
        ),
        traces=_named(traces, "block_id").select(
            "block_id", parse_trace(F.col(f"`{trace_column}`")).alias("trace")
        ),
        templates=_named(scan(TEMPLATE_FILE), "event_id", "template"),
    )
