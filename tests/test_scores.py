"""Fusion, classification, evaluation and score alignment."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultloom.functions import band, class_imbalance, classify, fuse, is_fault
from faultloom.operators import evaluate
from faultloom.operators.align import align_scores


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_fusion_example(spark):
    score = fuse(F.lit(0.8), F.lit(0.6), 0.5, 0.5)
    assert one(spark, score) == pytest.approx(0.7)
    assert one(spark, classify(score)) == "Anomaly"
    assert one(spark, fuse(F.lit(1.0), F.lit(0.0), 3, 1)) == pytest.approx(0.75)


@pytest.mark.parametrize("weights", [(0, 0), (1, -1)])
def test_fusion_needs_a_weight(spark, weights):
    with pytest.raises(ValueError):
        fuse(F.lit(0.8), F.lit(0.6), *weights)


@pytest.mark.parametrize(
    "score, want", [(0.5, "Anomaly"), (0.49, "Normal"), (math.nan, "Normal"), (None, None)])
def test_two_classes(spark, score, want):
    assert one(spark, classify(F.lit(score).cast("double"))) == want


@pytest.mark.parametrize(
    "score, want",
    [(0.0, "Normal"), (0.3, "Warning"), (0.6, "Anomaly"), (0.8, "Potential Fault"),
     (1.0, "Potential Fault"), (math.nan, None), (None, None)])
def test_four_bands(spark, score, want):
    assert one(spark, band(F.lit(score).cast("double"))) == want


def test_imbalance_names(spark):
    for pct, want in ((0.5, "Highly Imbalanced"), (2.16, "Moderately Imbalanced"),
                      (97.84, "Moderately Imbalanced"), (30.0, "Slightly Imbalanced"),
                      (50.0, "Balanced"), (None, None)):
        assert one(spark, class_imbalance(F.lit(pct).cast("double"))) == want


def predictions(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_pred int, score double")


def test_report_and_undefined_figures(spark):
    df = predictions(spark, [(1, 1, 0.0), (1, 0, 0.0), (0, 1, 0.0), (0, 0, 0.0), (0, 0, 0.0)])
    row = evaluate.classification_report(df).first()
    assert row["accuracy"] == pytest.approx(0.6)
    assert (row["precision"], row["recall"], row["f1"]) == (0.5, 0.5, 0.5)
    assert row["false_alarm_rate"] == pytest.approx(1 / 3)
    row = evaluate.classification_report(predictions(spark, [(1, 0, 0.0), (0, 0, 0.0)])).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("bad", [(None, 1, 0.5), (1, None, 0.5), (2, 1, 0.5)])
def test_labels_must_be_binary(spark, bad):
    with pytest.raises(Exception, match="must be 0 or 1"):
        evaluate.classification_report(predictions(spark, [bad, (0, 0, 0.1)])).collect()


def test_auc_example_and_guards(spark):
    truth, score = (0, 0, 1, 1, 1), (0.1, 0.4, 0.35, 0.8, 0.4)
    df = predictions(spark, [(t, 0, s) for t, s in zip(truth, score, strict=True)])
    assert evaluate.roc_auc_score(df) == pytest.approx(0.75)
    with pytest.raises(ValueError):
        evaluate.roc_auc_score(predictions(spark, [(1, 1, 0.5), (1, 0, 0.7)]))
    with pytest.raises(Exception, match="NULL or NaN"):
        evaluate.roc_auc_score(predictions(spark, [(1, 1, math.nan), (0, 0, 0.7)]))


@pytest.mark.parametrize("rows_per_slice", [4, 1_000_000])
def test_auc_and_curve_match_brute_force(spark, rows_per_slice):
    rng = random.Random(3)
    rows = [(rng.randrange(2), 0, round(rng.gauss(0, 3), 1)) for _ in range(300)]
    df = predictions(spark, rows)
    pos = [s for t, _, s in rows if t]
    neg = [s for t, _, s in rows if not t]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    auc = evaluate.roc_auc(df, rows_per_slice=rows_per_slice).first()["auc"]
    assert auc == pytest.approx(wins / (len(pos) * len(neg)), rel=1e-12)
    for r in evaluate.roc_curve(df, rows_per_slice=rows_per_slice).collect():
        assert r["tpr"] == pytest.approx(sum(p >= r["threshold"] for p in pos) / len(pos))
        assert r["fpr"] == pytest.approx(sum(n >= r["threshold"] for n in neg) / len(neg))
    best = evaluate.best_threshold(df, rows_per_slice=rows_per_slice).first()

    def f1(t):
        tp = sum(p >= t for p in pos)
        return 2 * tp / (tp + sum(n >= t for n in neg) + len(pos))

    assert best["f1"] == pytest.approx(max(f1(s) for _, _, s in rows))
    assert f1(best["threshold"]) == pytest.approx(best["f1"])


def test_model_comparison(spark):
    rows = [("a", 1, 1, 0.9), ("a", 0, 0, 0.1), ("b", 1, 0, 0.2), ("b", 0, 1, 0.8), ("c", 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "model string, y_true int, y_pred int, score double")
    table = {r["model"]: r for r in evaluate.compare_models(df).collect()}
    assert (table["a"]["auc"], table["b"]["auc"], table["c"]["auc"]) == (1.0, 0.0, None)
    assert (table["a"]["f1"], table["b"]["f1"]) == (1.0, 0.0)


def test_alignment_is_one_row_per_bucket(spark):
    kpi = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:10:00', 0.2D), "
                    "('a', timestamp'2024-01-01 00:50:00', 0.9D), "
                    "('b', timestamp'2024-01-01 00:00:00', 0.5D) AS t(node, event_time, kpi_score)")
    log = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:59:00', 0.3D), "
                    "('a', timestamp'2024-01-01 00:01:00', 0.1D), "
                    "('b', timestamp'2024-01-01 01:00:00', 0.5D) AS t(node, event_time, log_score)")
    rows = align_scores(kpi, log, ["node"]).collect()
    assert [(r["node"], r["kpi_score"], r["log_score"]) for r in rows] == [("a", 0.9, 0.3)]


def test_scoring_works_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(0.8, 0.6), (0.1, 0.2)], "k double, l double").write.parquet(source)
    stream = spark.readStream.schema("k double, l double").parquet(source)
    score = fuse(F.col("k"), F.col("l"))
    scored = stream.select(classify(score).alias("class"), is_fault(classify(score)).alias("p"))
    query = (scored.writeStream.format("memory").queryName("scored")
             .option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("scored").collect()} == {("Anomaly", 1), ("Normal", 0)}
