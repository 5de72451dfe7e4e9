"""Open vocabularies, sparse vectors, held-out forests and seasonal ranges."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultloom.operators import models, quality, shifts, vocabulary

SCHEMA = "block_id string, event string"


@pytest.fixture(scope="module")
def events(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", None), ("b", "rare"), ("c", None), (None, "x"), ("d", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("rows", [1, 1000])
def test_types_are_numbered_by_frequency_and_name(spark, events, rows):
    got = [tuple(r) for r in vocabulary.event_vocabulary(events, rows_per_slice=rows).orderBy("index").collect()]
    assert got == [("x", 0, 3), ("y", 1, 2), ("", 2, 1), ("rare", 3, 1)]
    assert vocabulary.event_vocabulary(events, least=2).count() == 2
    assert vocabulary.event_vocabulary(events.limit(0)).count() == 0


def test_blocks_as_sparse_counts(spark, events):
    known = vocabulary.event_vocabulary(events, least=2)
    got = {r["block_id"]: (r["indices"], r["counts"], r["unknown"]) for r in vocabulary.sparse_occurrences(events, known).collect()}
    assert got == {"a": ([0, 1], [2.0, 1.0], 0), "b": ([1], [1.0], 2), "c": ([], [], 1), None: ([0], [1.0], 0), "d": ([], [], 1)}


def test_fifty_thousand_templates(spark):
    """Counts without a wide column, vectors that hold them, and a forest that learns from one template."""
    size, blocks = 50_000, 300
    lines = spark.range(blocks * 200).select(
        F.concat(F.lit("b"), F.col("id") % blocks).alias("block_id"),
        F.concat(F.lit("t"), F.pmod(F.col("id") * 7919, F.lit(size))).alias("event"))
    lines = lines.union(spark.range(0, blocks, 3).select(F.concat(F.lit("b"), F.col("id")), F.lit("fault")))
    every = spark.range(size).select(F.lit("all").alias("block_id"), F.concat(F.lit("t"), F.col("id")).alias("event"))
    known = vocabulary.event_vocabulary(lines.union(every)).persist()
    assert known.count() == size + 1
    sparse = vocabulary.sparse_occurrences(lines, known)
    assert sparse.columns == ["block_id", "indices", "counts", "unknown"]
    vectors = vocabulary.with_vectors(sparse, size + 1)
    rows = {r["block_id"]: r["features"] for r in vectors.collect()}
    names = {r["index"]: r["event"] for r in known.collect()}
    want = {}
    for r in lines.collect():
        want.setdefault(r["block_id"], Counter())[r["event"]] += 1
    assert {b: {names[int(i)]: n for i, n in zip(v.indices, v.values)} for b, v in rows.items()} == want
    assert all(v.size == size + 1 for v in rows.values())

    labelled = vectors.withColumn("label", (F.substring("block_id", 2, 9).cast("int") % 3 == 0).cast("int"))
    # The forest sees the templates of the fault and of a few others, as vectors of the same form.
    few = vocabulary.event_vocabulary(lines.where("event = 'fault' or event in ('t1', 't2', 't3')"))
    small = vocabulary.with_vectors(vocabulary.sparse_occurrences(lines, few), 4).withColumn(
        "label", (F.substring("block_id", 2, 9).cast("int") % 3 == 0).cast("int"))
    kept = models.held_out("block_id")
    model = models.LogDetector(vector="features", trees=5).fit(small.where(~kept))
    scored = model.transform(small.where(kept)).select("label", "prediction").collect()
    assert len(scored) > 30 and all(r["label"] == r["prediction"] for r in scored)
    wide = models.LogDetector(vector="features", trees=2, depth=2).fit(labelled.where(~kept))
    assert wide.transform(labelled.where(kept)).where("score between 0 and 1").count() == len(scored)


def test_a_daily_wave_raises_no_flag(spark):
    start = datetime.datetime(2021, 3, 1)
    rows = []
    for hour in range(24 * 28):
        value = 100.0 * (hour % 24 in (8, 9, 10)) + (hour // 24) % 3
        rows.append(("a", start + datetime.timedelta(hours=hour), value + (50 if hour == 300 else 0)))
    rows += [(None, start, 1e9), ("a", None, 1e9), ("a", start, None), ("new", start, 5.0)]
    df = spark.createDataFrame(rows, "kpi_id string, event_time timestamp, value double")
    for season in ("day", "week"):
        got = shifts.seasonal_range(df, season=season, rows_per_slice=50)
        assert got.count() == len(rows)
        flagged = got.where("flagged = 1").collect()
        assert [r["event_time"] for r in flagged] == [start + datetime.timedelta(hours=300)]
    new = shifts.seasonal_range(df, history=df.limit(0))
    assert new.where("flagged = 1 or lower is not null").count() == 0
    with pytest.raises(ValueError):
        shifts.seasonal_range(df, season="year")


def test_ids_of_the_test_table_are_known(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "kpi_id string") for ks in (["x", None], ["x", "y", "y", None]))
    assert tuple(quality.kpi_id_consistency(a, b).first()) == ("kpi_ids_known", 1, False)
    assert tuple(quality.kpi_id_consistency(b, a).first()) == ("kpi_ids_known", 0, True)
