import pytest
from pyspark.sql import functions as F

from faultloom.operators import joins


def tables(spark):
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
        .alias("key"), "id")
    summary = rows.groupBy("key").agg(F.max("id").alias("top")).where("key <> 'k1'")
    return rows, summary


def joined(rows, summary, how, **options):
    table = joins.attach(rows, summary, ["key"], ["id"], how, **options)
    return table, {tuple(r) for r in table.select("key", "id", "top").collect()}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_all_ways_give_the_same_rows(spark, monkeypatch, how):
    rows, summary = tables(spark)
    want = {tuple(r) for r in rows.join(summary, "key", how).select("key", "id", "top").collect()}
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    counted, got = joined(rows, summary, how)
    assert got == want and "_salt" not in counted.columns
    _, got = joined(rows, summary, how, count_keys=False, salts=7)
    assert got == want


def test_key_count_decides(spark):
    rows, _ = tables(spark)
    distinct = rows.select("key").distinct().count()
    assert joins.few_keys(rows, ["key"], distinct)
    assert not joins.few_keys(rows, ["key"], distinct - 1)
