"""Features against pandas, cleaning, scaling, thresholds and runs on hand-made series."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultloom.operators import detect, features, rolling

START = datetime.datetime(2024, 1, 1, 22)


def series(spark, values, kpi="a"):
    rows = [(kpi, START + datetime.timedelta(minutes=i), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "kpi_id string, event_time timestamp, value double")


def test_features_match_pandas(spark):
    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.05 else float(v) for v in rng.normal(1e6, 3, 120)]
    got = features.kpi_features(series(spark, values), rows_per_slice=9).orderBy("event_time")
    got = got.toPandas()
    want = pd.Series(values, dtype="float64")
    for n in (1, 5, 10):
        np.testing.assert_allclose(got[f"lag_{n}"], want.shift(n))
    for n in (5, 10):
        np.testing.assert_allclose(got[f"rolling_mean_{n}"], want.rolling(n).mean(), rtol=1e-9)
        np.testing.assert_allclose(got[f"rolling_std_{n}"], want.rolling(n).std(), rtol=1e-5)
    times = pd.to_datetime(got["event_time"])
    assert got["hour_of_day"].tolist() == times.dt.hour.tolist()
    assert got["day_of_week"].tolist() == times.dt.dayofweek.tolist()


@pytest.mark.parametrize("unrolled", [0, 16])
def test_long_frames_match_short_ones(spark, monkeypatch, unrolled):
    monkeypatch.setattr(rolling, "LONGEST_UNROLLED", unrolled)
    values = [1.0, 2.5, None, 4.0, 8.0, 16.0, 3.0, 5.5, 7.0, 9.0]
    got = features.add_series_features(series(spark, values), lags=(), windows=(3,))
    got = got.orderBy("event_time").toPandas()
    want = pd.Series(values, dtype="float64").rolling(3)
    np.testing.assert_allclose(got["rolling_mean_3"], want.mean())
    np.testing.assert_allclose(got["rolling_std_3"], want.std())


def test_short_series_has_no_rolling_values(spark):
    row = features.kpi_features(series(spark, [1, 2, 3])).agg(
        F.count("rolling_mean_5").alias("n"), F.count("lag_1").alias("l")).first()
    assert (row["n"], row["l"]) == (0, 2)


def test_clean_policies(spark):
    rows = [("a", START, 3.0, 2), ("a", START, 9.0, 1), (None, START, 1.0, 3), ("a", None, 1.0, 4),
            ("b", START, None, 5)]
    df = spark.createDataFrame(rows, "kpi_id string, event_time timestamp, value double, row int")
    assert [tuple(r) for r in features.clean(df, ["row"]).collect()] == [("a", START, 9.0, 1)]
    kept = features.clean(df, ["row"], null_values="keep").orderBy("kpi_id").collect()
    assert [(r["kpi_id"], r["value"]) for r in kept] == [("a", 9.0), ("b", None)]
    filled = features.clean(df, ["row"], null_values="fill", fill=7).orderBy("kpi_id").collect()
    assert filled[1]["value"] == 7.0
    with pytest.raises(ValueError):
        features.clean(df, null_values="guess")


def test_scaler_is_learned_on_training_only(spark):
    prep = features.KpiPreprocessor(calendar=False)
    with pytest.raises(ValueError):
        prep.transform(series(spark, [1, 2]))
    train = prep.fit_transform(series(spark, range(30)))
    row = train.agg(F.avg("value"), F.stddev_samp("value")).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(1)
    test = prep.transform(series(spark, [14.5, 14.5])).collect()
    assert [r["value"] for r in test] == pytest.approx([0, 0])
    assert [r["rolling_mean_5"] for r in test] == [0.0, 0.0]


def test_feature_report(spark):
    df = features.add_series_features(series(spark, [1, 2, 3, 4, 5, 6]))
    rows = {r["feature"]: tuple(r)[1:] for r in
            features.feature_report(df, features.feature_columns(False)).collect()}
    assert rows["value"] == (0, 1.0, 6.0) and rows["lag_5"] == (5, 1.0, 1.0)
    assert rows["rolling_mean_5"] == (4, 3.0, 4.0) and rows["lag_10"] == (6, None, None)


def test_threshold_and_runs(spark):
    calm = [10, 11, 10, 11, 10]
    values = calm + [90] + calm + [-80, -500, -3000] + calm
    df = series(spark, values)
    rows = detect.adaptive_threshold(df, history=5, width=2.0).orderBy("event_time").collect()
    assert [i for i, r in enumerate(rows) if r["flagged"]] == [5, 11, 12, 13]
    assert all(r["lower"] is None for r in rows[:5])
    for rows_per_slice in (2, 10_000):
        runs = detect.anomaly_runs(df, history=5, width=2.0, rows_per_slice=rows_per_slice)
        found = [(r["kind"], r["run_length"]) for r in runs.orderBy("run_start").collect()]
        assert found == [("spike", 1), ("persistent_drop", 3)]
