"""Models as files: settings and tables under one folder, written and read by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_model(spark: SparkSession, path: str, kind: str, settings: dict, tables: dict[str, DataFrame]) -> None:
    """``settings`` (anything JSON holds) as a one-row table, and each of ``tables`` as Parquet. A
    model that was there before is replaced; the settings go last, so a model with settings is whole."""
    base = path.rstrip("/")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{base}/{name}")
    row = [(kind, json.dumps(settings))]
    spark.createDataFrame(row, "kind string, settings string").coalesce(1).write.mode("overwrite").parquet(f"{base}/settings")


def read_settings(spark: SparkSession, path: str, kind: str) -> dict:
    row = spark.read.parquet(f"{path.rstrip('/')}/settings").first()
    if row["kind"] != kind:
        raise ValueError(f"{path} holds a {row['kind']}, not a {kind}")
    return json.loads(row["settings"])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")
