"""The sliced plans against SQL and brute force: slices of a few rows, bursts, ties, NULLs."""

import datetime
import random

import oracle
import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultloom.operators import (
    detect,
    distributions,
    evaluate,
    features,
    logs,
    profile,
    slices,
)
from faultloom.operators.quantiles import exact_quantiles, value_counts
from faultloom.operators.slices import (
    SLICES,
    _positions,
    add_slices,
    lookback_series,
    running_totals,
)
from faultloom.plans import catalog, views
from faultloom.plans.oracles import ORACLES

TIES = ("event_id",)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sliced_features(spark, rows):
    return features.add_series_features(
        views.kpi(spark, SMALL), TIES, rows_per_slice=rows
    )


def lag_features(spark, rows):
    return sliced_features(spark, rows).select("event_id", "value", "lag_1", "lag_5", "lag_10")


def rolling_features(spark, rows):
    names = ["rolling_mean_5", "rolling_std_5", "rolling_mean_10", "rolling_std_10"]
    return rounded(sliced_features(spark, rows).select("event_id", *names), *names)


def adaptive_threshold(spark, rows):
    table = detect.adaptive_threshold(
        views.kpi(spark, SMALL).drop("event_type"), TIES, rows_per_slice=rows
    )
    return rounded(
        table.select("kpi_id", "event_id", "lower", "upper", "flagged"), "lower", "upper"
    )


def anomaly_runs(spark, rows):
    return detect.anomaly_runs(
        views.kpi(spark, SMALL).drop("event_type"), TIES, width=1.0, persistent=2,
        rows_per_slice=rows,
    )


def box_stats(spark, rows):
    return rounded(
        distributions.box_stats(views.kpi(spark, SMALL), rows_per_slice=rows), *catalog._BOX
    )


def box_stats_by_kpi(spark, rows):
    return rounded(
        distributions.box_stats_by_kpi(views.kpi(spark, SMALL), rows_per_slice=rows),
        *catalog._BOX,
    )


def descriptive_stats(spark, rows):
    train, test = views.kpi_train(spark, SMALL), views.kpi_test(spark, SMALL)
    table = profile.descriptive_statistics(train, test, rows_per_slice=rows)
    return rounded(table, "training", "testing")


def roc_auc(spark, rows):
    table = evaluate.roc_auc(catalog._predictions(spark, SMALL), rows_per_slice=rows)
    return rounded(table, "auc")


def roc_curve(spark, rows):
    table = evaluate.roc_curve(catalog._predictions(spark, SMALL), rows_per_slice=rows)
    return rounded(rounded(table, "fpr", "tpr"), "threshold", digits=9)


def log_positions(spark, rows):
    placed = logs.log_positions(views.logs(spark, SMALL), views.LOG_ORDER, rows_per_slice=rows)
    return placed.select("block_id", "event_id", "position", "event")


def log_windows(spark, rows):
    table = logs.log_windows(views.logs(spark, SMALL), views.LOG_ORDER, rows_per_slice=rows)
    return table.select(
        "block_id", "event_id", F.concat_ws(",", "history").alias("history"), "next_event"
    )


@pytest.mark.parametrize("rows", [3, 25])
@pytest.mark.parametrize(
    "build",
    [
        lag_features, rolling_features, adaptive_threshold, anomaly_runs, box_stats,
        box_stats_by_kpi, descriptive_stats, roc_auc, roc_curve, log_positions, log_windows,
    ],
)
def test_sliced_plan_matches_sql(spark, db, build, rows):
    equal, message = oracle.compare(build(spark, rows), db, ORACLES[build.__name__])
    assert equal, message


def test_first_cut_makes_few_parts_of_short_keys(spark):
    """Two slices' worth of rows become a few slices, not one for every row; bursts are cut on."""
    rows = [(f"k{k}", 1000 * i) for k in range(50) for i in range(64)] + [("burst", i % 50 + 10 ** 9 * (i == 0)) for i in range(64)]
    sliced = add_slices(spark.createDataFrame(rows, "kpi_id string, n bigint"), ["kpi_id"], _positions(
        spark.createDataFrame(rows, "kpi_id string, n bigint"), ["n"]), 30)
    found = sliced.groupBy("kpi_id", *SLICES).agg(F.count("*").alias("rows")).collect()
    assert max(r["rows"] for r in found) <= 30 and sum(r["rows"] for r in found) == len(rows)
    assert sum(r["kpi_id"] != "burst" for r in found) <= 50 * 6


def bursty_rows():
    """One key with a third of its rows in one minute, equal times and an outlier far away."""
    rng = random.Random(7)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        if i % 3 == 0:
            at = start + datetime.timedelta(milliseconds=rng.randrange(60_000))
        elif i % 3 == 1:
            at = start + datetime.timedelta(days=100)
        else:
            at = start + datetime.timedelta(minutes=rng.randrange(100_000))
        value = None if i % 17 == 0 else rng.random() * 10 ** rng.randrange(8)
        rows.append(("hot" if i % 8 else None, at, i, value))
    rows += [("cold", start, 1000 + i, float(i)) for i in range(3)]
    return rows


SCHEMA = "kpi_id string, event_time timestamp, event_id int, value double"


def test_slices_follow_the_order_and_split_bursts(spark):
    df = spark.createDataFrame(bursty_rows(), SCHEMA)
    sliced = add_slices(df, ["kpi_id"], _positions(df, ["event_time", "event_id"]), 20)
    by_time = Window.partitionBy("kpi_id").orderBy("event_time", "event_id")
    path = F.struct(*SLICES)
    backwards = sliced.withColumn("_before", F.lag(path).over(by_time)).where(
        F.col("_before") > path
    )
    assert backwards.count() == 0
    sizes = sliced.where("kpi_id = 'hot'").groupBy(*SLICES).count()
    biggest = sizes.agg(F.max("count")).first()[0]
    assert biggest <= 2 * 20
    assert sliced.where("kpi_id = 'cold'").select(*SLICES).distinct().count() == 1


@pytest.mark.parametrize("rows", [4, 30, 10_000])
def test_lookback_matches_one_window_per_key(spark, rows):
    df = spark.createDataFrame(bursty_rows(), SCHEMA)
    series = lookback_series(df, ["kpi_id"], ["event_time", "event_id"], 12, rows)
    frame = series.window.rowsBetween(-12, 0)
    got = series.finish(series.rows.withColumns({
        "lag": F.lag("event_id", 12).over(series.window),
        "sum": F.sum("event_id").over(frame),
        "n": F.count("value").over(frame),
    }))
    plain = Window.partitionBy("kpi_id").orderBy("event_time", "event_id")
    want = df.withColumns({
        "lag": F.lag("event_id", 12).over(plain),
        "sum": F.sum("event_id").over(plain.rowsBetween(-12, 0)),
        "n": F.count("value").over(plain.rowsBetween(-12, 0)),
    })
    assert sorted(got.collect(), key=repr) == sorted(want.select(got.columns).collect(), key=repr)


@pytest.mark.parametrize("keys", [["kpi_id"], []])
@pytest.mark.parametrize("rows", [5, 10_000])
def test_running_totals_match_one_window_per_key(spark, keys, rows):
    df = spark.createDataFrame(bursty_rows(), SCHEMA)
    got = running_totals(
        df, keys, ["event_time", "event_id"], {"n": F.lit(1).cast("bigint"),
                                               "id": F.col("event_id").cast("bigint")},
        rows_per_slice=rows,
    )
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = by.orderBy("event_time", "event_id")
    want = df.withColumns({
        "n_upto": F.count(F.lit(1)).over(upto), "n_total": F.count(F.lit(1)).over(by),
        "id_upto": F.sum("event_id").over(upto), "id_total": F.sum("event_id").over(by),
    })
    assert sorted(got.select(want.columns).collect(), key=repr) == sorted(
        want.collect(), key=repr
    )


@pytest.mark.parametrize("rows", [4, 10_000])
def test_quantiles_match_percentile(spark, rows):
    df = spark.createDataFrame(bursty_rows(), SCHEMA)
    fractions = {"low": 0.0, "q": 0.37, "mid": 0.5, "high": 1.0}
    got = exact_quantiles(value_counts(df, ["kpi_id"], "value"), ["kpi_id"], "value", fractions,
                          rows)
    want = df.groupBy("kpi_id").agg(
        *[F.percentile("value", f).alias(n) for n, f in fractions.items()]
    )
    a = {r["kpi_id"]: r for r in got.collect()}
    b = {r["kpi_id"]: r for r in want.collect()}
    assert a.keys() == b.keys()
    for k in b:
        for n in fractions:
            assert a[k][n] == pytest.approx(b[k][n], rel=1e-12)


def largest(spark, rows, schema, order, limit):
    """Rows of the largest slice; every slice must follow the sort order."""
    df = spark.createDataFrame(rows, schema)
    sliced = add_slices(df, [], _positions(df, order), limit)
    before = F.lag("_slice").over(Window.partitionBy(F.lit(0)).orderBy(*order))
    assert sliced.withColumn("_b", before).where(F.col("_b") > F.col("_slice")).count() == 0
    return sliced.groupBy("_slice").count().agg(F.max("count")).first()[0]


def test_two_adjacent_busy_seconds_are_cut(spark):
    start = datetime.datetime(2021, 1, 1)
    rows = [(start + datetime.timedelta(minutes=i), i) for i in range(5000)]
    rows += [(start + datetime.timedelta(minutes=777, seconds=i % 2), 10**6 + i) for i in range(2000)]
    assert largest(spark, rows, "at timestamp, id bigint", ["at", "id"], 100) <= 200


def test_text_ties_are_cut(spark):
    at = datetime.datetime(2021, 1, 1)
    rows = [(at, f"commonprefix-{i * 7919 % 3000:06d}") for i in range(3000)] + [(at, None), (at, "")]
    assert largest(spark, rows, "at timestamp, id string", ["at", "id"], 100) <= 200


def test_dense_values_and_infinities_are_cut(spark):
    rng = random.Random(3)
    rows = [(rng.random(),) for _ in range(2000)] + [(0.5 + i * 1e-12,) for i in range(2000)]
    rows += [(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (1.7e308,), (-1.7e308,)]
    assert largest(spark, rows, "v double", ["v"], 100) <= 200


def test_long_numbers_keep_their_order(spark):
    rows = [(2**62 + i, -i) for i in range(1500)] + [(-(2**63), 0), (2**63 - 1, 0)]
    assert largest(spark, rows, "a bigint, b bigint", ["a", "b"], 50) <= 100


def test_many_cuts_are_joined_with_a_salt(spark, monkeypatch):
    monkeypatch.setattr(slices, "BROADCAST_CUTS", 0)
    df = spark.createDataFrame(bursty_rows(), SCHEMA)
    sliced = add_slices(df, ["kpi_id"], _positions(df, ["event_time", "event_id"]), 20)
    assert sliced.count() == 403
    assert sliced.where("kpi_id = 'hot'").groupBy("_slice").count().agg(F.max("count")).first()[0] <= 40


def test_rows_of_one_time_without_ties_have_an_order(spark):
    at = datetime.datetime(2021, 1, 1)
    df = spark.createDataFrame([("k", at, float(i)) for i in range(500)], "kpi_id string, event_time timestamp, value double")
    one, two = (features.add_series_features(df, rows_per_slice=n) for n in (40, 10_000))
    assert sorted(one.collect(), key=repr) == sorted(two.collect(), key=repr)


def test_cuts_are_broadcast_only_for_long_keys(spark):
    df = spark.createDataFrame(bursty_rows(), SCHEMA)
    one_long = add_slices(df, ["kpi_id"], _positions(df, ["event_time", "event_id"]), 300)
    assert one_long.where(F.size("_slice") > 0).select("kpi_id").distinct().count() == 1
