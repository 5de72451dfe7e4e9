"""KPI and log views over the star-schema test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_TIME = "2024-01-16 00:00:00"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def kpi(spark: SparkSession, directory: str) -> DataFrame:
    """Events as 26 labelled KPI series."""
    number = F.lpad((F.col("user_id") % 26).cast("string"), 2, "0")
    return table(spark, directory, "events").select(
        "event_id",
        F.col("ts").alias("event_time"),
        "value",
        (F.col("value") >= 190).cast("int").alias("label"),
        F.concat(F.lit("KPI-"), number).alias("kpi_id"),
        "event_type",
    )


def kpi_sets(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows before the split time, unlabelled rows after it."""
    rows = kpi(spark, directory).drop("event_type")
    split = F.to_timestamp_ntz(F.lit(SPLIT_TIME))
    return (
        rows.where(F.col("event_time") < split),
        rows.where(F.col("event_time") >= split).drop("label"),
    )


def kpi_train(spark: SparkSession, directory: str) -> DataFrame:
    return kpi_sets(spark, directory)[0]


def kpi_test(spark: SparkSession, directory: str) -> DataFrame:
    return kpi_sets(spark, directory)[1]


def scores(spark: SparkSession, directory: str) -> DataFrame:
    """Events with a KPI score, a log score and the true label."""
    return kpi(spark, directory).select(
        "event_id",
        "kpi_id",
        "event_time",
        "label",
        F.least(F.col("value") / 500, F.lit(1.0)).alias("kpi_score"),
        F.when(F.col("event_type") == "error", 0.9).otherwise(0.2).alias("log_score"),
    )


def lineitem_kpi(spark: SparkSession, directory: str) -> DataFrame:
    """Order lines as a larger labelled KPI table, one series per supplier."""
    return table(spark, directory, "lineitem").select(
        F.col("l_suppkey").alias("kpi_id"),
        F.col("l_shipdate").alias("event_time"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_quantity") >= 49).cast("int").alias("label"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
    )


LINEITEM_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "value", "l_quantity")


def logs(spark: SparkSession, directory: str) -> DataFrame:
    """Events as log lines; a block is one user in one ISO week."""
    ts = F.col("ts")
    week = F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.extract(F.lit("WEEK"), ts)
    return table(spark, directory, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string")).alias("block_id"),
        F.col("event_type").alias("event"),
        ts.alias("event_time"),
        "event_id",
        "value",
    )


LOG_ORDER = ("event_time", "event_id")

CUSTOMER_SPLIT = "1996-06-01 00:00:00"


def customer_series(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Orders as one series per customer, before and after a split; some customers are new."""
    rows = table(spark, directory, "orders").select(
        F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("kpi_id"),
        F.col("o_orderdate").alias("event_time"),
        F.col("o_totalprice").alias("value"),
    )
    split = F.to_timestamp_ntz(F.lit(CUSTOMER_SPLIT))
    return rows.where(F.col("event_time") < split), rows.where(F.col("event_time") >= split)


def kpi_lines(spark: SparkSession, directory: str) -> DataFrame:
    """The events as lines of a labelled CSV file with defects of every kind: a field too many or
    too few, numbers, labels and times that are none, missing fields, repeated lines."""
    n = F.col("event_id")
    at = F.when(n % 23 == 1, "yesterday").when(n % 31 == 2, "").otherwise(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))
    value = F.when(n % 13 == 1, "abc").when(n % 13 == 4, "NaN").otherwise(F.round("value").cast("int").cast("string"))
    label = F.when(n % 17 == 2, "7").when(n % 17 == 5, "maybe").when(n % 17 == 6, "").otherwise(F.col("label").cast("string"))
    key = F.when(n % 19 == 3, "N/A").otherwise(F.col("kpi_id"))
    line = F.when(n % 11 == 5, F.concat_ws(",", at, value)).when(
        n % 11 == 3, F.concat_ws(",", at, value, label, key, F.lit("more"))).otherwise(F.concat_ws(",", at, value, label, key))
    copies = F.explode(F.sequence(F.lit(0), F.when(n % 29 == 0, 2).otherwise(0)))
    return kpi(spark, directory).select(line.alias("value"), copies.alias("copy")).select("value")


def order_logs(spark: SparkSession, directory: str) -> DataFrame:
    """Orders as blocks of log lines with one template per part: thousands of event types."""
    return table(spark, directory, "lineitem").select(
        F.col("l_orderkey").alias("block_id"),
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("event"),
        (F.col("l_quantity") >= 45).cast("int").alias("heavy"),
    )


#: Two isolation trees on the value (feature 0) and the hour (1): tree, node, feature, cut, left, right, path.
GIVEN_NODES = (
    (0, 0, 0, 180.0, 1, 2, 0.0), (0, 1, 1, 11.0, 3, 4, 0.0), (0, 2, 0, 260.0, 5, 6, 0.0),
    (0, 3, -1, 0.0, 3, 3, 9.5), (0, 4, -1, 0.0, 4, 4, 8.25), (0, 5, -1, 0.0, 5, 5, 4.0), (0, 6, -1, 0.0, 6, 6, 2.0),
    (1, 0, 1, 5.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 6.75), (1, 2, 0, 20.0, 3, 4, 0.0),
    (1, 3, -1, 0.0, 3, 3, 3.5), (1, 4, 0, 120.0, 5, 6, 0.0), (1, 5, -1, 0.0, 5, 5, 10.0), (1, 6, -1, 0.0, 6, 6, 5.5),
)
GIVEN_SAMPLE = 256


def given_nodes() -> pd.DataFrame:
    return pd.DataFrame(GIVEN_NODES, columns=["tree", "node", "feature", "cut", "left", "right", "path"])
