"""The ten-row training and six-row test tables with hand-derived figures."""

import datetime
import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultloom.operators import distributions, profile
from faultloom.plans import analysis
from faultloom.sources import to_series

LABELS = (0, 1, 0, 1, 0, 0, 1, 0, 0, 0)


def days(first, n):
    return [first + datetime.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def train(spark):
    times = days(datetime.datetime(2021, 1, 1), 10)
    rows = [(times[i], 100.0 + 2.5 * i, LABELS[i], "KPI-1" if i < 5 else "KPI-2")
            for i in range(10)]
    return to_series(spark.createDataFrame(
        rows, "timestamp timestamp, value double, label int, `KPI ID` string"))


@pytest.fixture(scope="module")
def test(spark):
    times = days(datetime.datetime(2021, 2, 1), 6)
    rows = [(times[i], 110.0 + 3.0 * i, "KPI-1" if i < 3 else "KPI-2") for i in range(6)]
    return to_series(spark.createDataFrame(
        rows, "timestamp timestamp, value double, `KPI ID` string"))


def test_summary_record(train, test):
    record = analysis.summary_statistics(train)
    assert list(record) == [
        "total_records", "total_columns", "kpi_count", "anomaly_count", "normal_count",
        "anomaly_percentage", "class_imbalance", "min_timestamp", "max_timestamp", "time_span",
        "unique_timestamps",
    ]
    assert (record["total_records"], record["total_columns"], record["kpi_count"]) == (10, 4, 2)
    assert (record["anomaly_count"], record["normal_count"]) == (3, 7)
    assert record["anomaly_percentage"] == pytest.approx(30.0)
    assert record["class_imbalance"] == "Slightly Imbalanced"
    assert record["time_span"] == datetime.timedelta(days=9) and record["unique_timestamps"] == 10
    other = analysis.summary_statistics(test)
    assert (other["total_columns"], other["anomaly_count"], other["class_imbalance"]) == (
        3, None, None)


def test_reports_of_training_only(train):
    summary = analysis.summary_report(train).collect()
    assert len(summary) == 10 and summary[0].asDict() == {
        "Metric": "Number of Rows", "Training": "10"}
    assert analysis.statistics_report(train).columns == ["Statistic", "Training"]
    assert analysis.timestamp_report(train).columns == ["Metric", "Training"]


def test_descriptive_statistics(train, test):
    rows = {r["statistic"]: (r["training"], r["testing"])
            for r in profile.descriptive_statistics(train, test).collect()}
    want = {
        "25th Percentile": (105.625, 113.75), "75th Percentile": (116.875, 121.25),
        "Count": (10.0, 6.0), "IQR": (11.25, 7.5), "Max": (122.5, 125.0),
        "Mean": (111.25, 117.5), "Median": (111.25, 117.5), "Min": (100.0, 110.0),
        "Std Dev": (7.569126, 5.612486),
    }
    assert list(rows) == list(want)
    for name, pair in want.items():
        assert rows[name] == pytest.approx(pair, abs=1e-6)


def test_kpi_distribution_keeps_ids_of_one_side(train, test):
    only_test = test.where("kpi_id = 'KPI-2'").withColumn("kpi_id", F.lit("KPI-3"))
    rows = profile.kpi_distribution(train, test.unionByName(only_test)).collect()
    assert [(r["kpi_id"], r["train_records"], r["train_anomalies"], r["train_anomaly_pct"],
             r["test_records"]) for r in rows] == [
        ("KPI-1", 5, 2, 40.0, 3), ("KPI-2", 5, 1, 20.0, 3), ("KPI-3", 0, 0, None, 3)]


def test_label_tables(spark, train, test):
    assert [tuple(r) for r in profile.label_distribution(train).collect()] == [
        ("Normal", 7, 70.0), ("Anomaly", 3, 30.0)]
    odd = train.withColumn("label", F.when(F.col("value") > 120, 5).otherwise(F.col("label")))
    assert {tuple(r) for r in distributions.label_counts(odd).collect()} == {
        ("Normal", 6), ("Anomaly", 3), ("5", 1)}
    assert distributions.label_counts(test) is None


def test_nan_and_null_values_are_skipped(spark):
    raw = spark.createDataFrame(
        [("1", 1.0, "a"), ("2", math.nan, "a"), ("3", None, None)],
        "timestamp string, value double, `KPI ID` string")
    series = to_series(raw)
    rows = {r["statistic"]: r["training"] for r in
            profile.descriptive_statistics(series).collect()}
    assert (rows["Count"], rows["Max"], rows["Median"]) == (1.0, 1.0, 1.0)
    assert [tuple(r) for r in distributions.kpi_record_counts(series).collect()] == [("a", 2)]


@pytest.mark.parametrize("values", [[0.0, 1.0, 1.0, 10.0], [3.0, 3.0], [-1.0, 0.0, 2.5, 7.25]])
def test_histogram_totals_and_edges(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value double")
    rows = distributions.value_histogram(df).collect()
    assert len(rows) == 50 and sum(r["frequency"] for r in rows) == len(values)
    if min(values) == max(values):
        assert rows[0]["bin_lo"] == 2.5 and rows[-1]["bin_hi"] == 3.5
    else:
        assert rows[-1]["frequency"] >= 1 and rows[0]["bin_lo"] == min(values)


def test_box_without_spread(spark):
    df = spark.createDataFrame([("k", 5.0)] * 9 + [("k", 100.0)], "kpi_id string, value double")
    row = distributions.box_stats_by_kpi(df).first()
    assert tuple(row) == ("k", 5.0, 5.0, 5.0, 5.0, 5.0, 1)


def test_chart_tables(train, test):
    tables = distributions.all_distributions(train, test)
    assert set(tables) == {
        f"{t}_{d}" for d in ("training", "testing")
        for t in ("kpi_record_counts", "value_histogram", "box_stats", "box_stats_by_kpi")
    } | {"label_counts_training"}
    assert set(distributions.all_distributions(test)) == {
        f"{t}_training" for t in
        ("kpi_record_counts", "value_histogram", "box_stats", "box_stats_by_kpi")}


def test_whole_analysis(spark, train, test, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    for name, df in (("train", train), ("test", test)):
        pdf = df.toPandas()
        pdf = pdf.rename(columns={"event_time": "timestamp", "kpi_id": "KPI ID"})
        order = [c for c in ("timestamp", "value", "label", "KPI ID") if c in pdf]
        pdf[order].to_csv(data / f"{name}.csv", index=False)
    assert analysis.run_analysis(spark, str(data), str(out), single_file=True) is True

    summary = pd.read_csv(out / "dataset_summary.csv", dtype=str)
    assert list(summary.columns) == ["Metric", "Training", "Testing"]
    assert summary.set_index("Metric").loc["Anomaly Percentage (%)"].tolist() == [
        "30.00", "N/A (No labels)"]
    assert summary.set_index("Metric").loc["Time Span"].tolist() == [
        "9 days 00:00:00", "5 days 00:00:00"]
    stats = pd.read_csv(out / "descriptive_statistics.csv")
    assert stats.columns[0] == "Statistic" and len(stats) == 9
    kpis = pd.read_csv(out / "kpi_distribution.csv", dtype=str)
    assert kpis["KPI ID"].tolist() == ["KPI-1", "KPI-2"]
    assert kpis["Train Anomaly %"].tolist() == ["40.00", "20.00"]
    for side in ("Train", "Test"):
        assert {f"{side} First Timestamp", f"{side} Last Timestamp"} <= set(kpis.columns)
    labels = pd.read_csv(out / "anomaly_distribution.csv")
    assert labels.to_dict("records") == [
        {"Label": "Normal", "Count": 7, "Percentage": 70.0},
        {"Label": "Anomaly", "Count": 3, "Percentage": 30.0}]
    times = pd.read_csv(out / "timestamp_analysis.csv")
    assert times["Metric"].tolist() == [
        "First Timestamp", "Last Timestamp", "Time Span", "Number of Unique Timestamps"]
    record = json.loads((out / "dataset_summary.json").read_text())
    assert record["total_records"] == 10 and record["min_timestamp"] == "2021-01-01 00:00:00"
    assert "VALID" in (out / "validation_report.txt").read_text()
    assert (out / "plots" / "box_stats_by_kpi_testing.csv").exists()
