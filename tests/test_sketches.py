"""Daily sketches: merging, refreshing days, and the bounds of their errors."""

import pytest
from pyspark.sql import functions as F

from faultloom.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    """Two series over ten days; one has nine tenths of the rows, and some values are missing."""
    n = F.col("id")
    return spark.range(0, 60_000, 1, 6).select(
        F.when(n % 10 == 0, "b").otherwise("a").alias("kpi_id"),
        F.timestamp_seconds(n * 14).alias("event_time"),
        (n * 7919 % 20_011).cast("string").alias("user"),
        F.when(n % 101 == 0, F.lit(float("nan"))).when(n % 103 == 0, None).otherwise((n * 31 % 50_021) / 7).alias("value"),
    ).persist()


def test_merged_estimates_are_within_their_bounds(rows):
    got = sketches.sketch_figures(sketches.merged_sketches(sketches.daily_sketches(rows, "user"))).collect()
    table = rows.toPandas()
    assert {r["kpi_id"] for r in got} == {"a", "b"}
    for r in got:
        mine = table[table["kpi_id"] == r["kpi_id"]]
        values = mine["value"].dropna()
        assert (r["days"], r["n"], r["missing"]) == (10, len(mine), len(mine) - len(values))
        assert (r["minimum"], r["maximum"]) == (values.min(), values.max())
        assert r["distinct_estimate"] == pytest.approx(mine["user"].nunique(), rel=0.04)
        for q in (25, 50, 75):
            assert (values <= r[f"q_{q}"]).mean() == pytest.approx(q / 100, abs=0.01)


def test_merges_of_merges_and_refreshed_days(rows):
    daily = sketches.daily_sketches(rows, "user").persist()
    by_key = sketches.merged_sketches(daily)
    whole = sketches.sketch_figures(sketches.merged_sketches(by_key, []), [0.5], []).first()
    assert whole["n"] == 60_000 and whole["distinct_estimate"] == pytest.approx(20_011, rel=0.04)
    late = rows.where("event_time >= '1970-01-09'")
    half = sketches.daily_sketches(late.where("kpi_id = 'a'"), "user")
    fresh = sketches.refresh_days(daily, half)
    assert fresh.where("day >= '1970-01-09' AND kpi_id = 'b'").count() == 0
    assert fresh.agg(F.sum("n")).first()[0] == 60_000 - late.where("kpi_id = 'b'").count()


def test_odd_rows(spark):
    odd = spark.createDataFrame(
        [("x", None, None, None), ("x", None, None, float("nan")), (None, None, "u", 1.0)],
        "kpi_id string, event_time timestamp, user string, value double")
    daily = sketches.daily_sketches(odd, "user")
    got = {r["kpi_id"]: r for r in sketches.sketch_figures(sketches.merged_sketches(daily), [0.5]).collect()}
    assert (got["x"]["n"], got["x"]["missing"], got["x"]["distinct_estimate"], got["x"]["q_50"]) == (2, 2, 0, None)
    assert (got[None]["n"], got[None]["distinct_estimate"], got[None]["q_50"]) == (1, 1, 1.0)
    assert sketches.daily_sketches(odd.limit(0), "user").count() == 0
