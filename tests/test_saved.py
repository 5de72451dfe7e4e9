"""Saved models score like the ones that were fitted."""

import datetime

import pytest
from pyspark.sql import functions as F

from faultloom.operators import features
from faultloom.operators.forest import IsolationForest, IsolationForestModel
from faultloom.operators.models import LogDetector, LogDetectorModel


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(300).select(
        "id", F.sin("id").alias("x"), (F.col("id") % 7).cast("double").alias("y"),
        (F.col("id") % 7 == 0).cast("int").alias("label"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_isolation_forest(spark, table, tmp_path):
    model = IsolationForest(("x", "y"), trees=7, sample=32, threshold=0.55).fit(table, ["id"])
    for _ in range(2):  # the second time over the first
        model.save(spark, str(tmp_path / "forest"))
    again = IsolationForestModel.load(spark, str(tmp_path / "forest"))
    assert (again.features, again.sample, again.threshold) == (("x", "y"), model.sample, 0.55)
    assert rows(again.transform(table)) == rows(model.transform(table))
    with pytest.raises(ValueError):
        features.FeatureScaler.load(spark, str(tmp_path / "forest"))


def test_random_forest(table, tmp_path):
    model = LogDetector(("x", "y"), trees=3).fit(table)
    for _ in range(2):
        model.save(str(tmp_path / "log"))
    assert rows(LogDetectorModel.load(str(tmp_path / "log")).transform(table)) == rows(model.transform(table))


def test_preprocessor(spark, tmp_path):
    start = datetime.datetime(2021, 3, 1)
    df = spark.createDataFrame(
        [("a", start + datetime.timedelta(minutes=i), float(i * i % 11)) for i in range(40)], "kpi_id string, event_time timestamp, value double")
    fresh = features.KpiPreprocessor()
    fresh.save(spark, str(tmp_path / "p"))
    assert features.KpiPreprocessor.load(spark, str(tmp_path / "p")) == fresh
    fresh.fit_transform(df)
    fresh.save(spark, str(tmp_path / "p"))
    again = features.KpiPreprocessor.load(spark, str(tmp_path / "p"))
    assert again == fresh and rows(again.transform(df)) == rows(fresh.transform(df))
