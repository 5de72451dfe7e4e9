"""Evaluation of binary predictions and scores, overall or per group (for example per model)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from .slices import ROWS_PER_SLICE, running_totals


def _binary(column: str) -> Column:
    """The column as 0/1; anything else, NULL included, fails the job."""
    c = F.col(column)
    complaint = F.concat(F.lit(f"{column} must be 0 or 1, got "),
                         F.coalesce(c.cast("string"), F.lit("NULL")))
    return F.when(c.isin(0, 1), c.cast("int")).otherwise(F.raise_error(complaint).cast("int"))


def _finite(column: str) -> Column:
    c = F.col(column).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c), c).otherwise(
        F.raise_error(F.lit(f"{column} must not be NULL or NaN")).cast("double")
    )


def confusion(
    df: DataFrame, truth: str = "y_true", prediction: str = "y_pred", keys: Sequence[str] = ()
) -> DataFrame:
    return (
        df.select(*keys, _binary(truth).alias("y_true"), _binary(prediction).alias("y_pred"))
        .groupBy(*keys, "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def classification_report(
    df: DataFrame, truth: str = "y_true", prediction: str = "y_pred", keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall (= detection rate), F1 and false-alarm rate in one aggregate;
    undefined figures are 0."""
    t, p = F.col("_t"), F.col("_p")
    counted = (
        df.select(*keys, _binary(truth).alias("_t"), _binary(prediction).alias("_p"))
        .groupBy(*keys)
        .agg(
            F.count_if((t == 1) & (p == 1)).alias("tp"),
            F.count_if((t == 0) & (p == 1)).alias("fp"),
            F.count_if((t == 1) & (p == 0)).alias("fn"),
            F.count_if((t == 0) & (p == 0)).alias("tn"),
        )
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return counted.select(
        *keys,
        or_zero(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
        or_zero(ratio(tp, tp + fp)).alias("precision"),
        or_zero(ratio(tp, tp + fn)).alias("recall"),
        or_zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        or_zero(ratio(fp, fp + tn)).alias("false_alarm_rate"),
    )


def _ranked(
    df: DataFrame, truth: str, score: str, keys: Sequence[str], rows_per_slice: int
) -> DataFrame:
    """Positives and negatives per distinct score with their running totals. Rows are reduced to
    one per score before anything is ordered."""
    per_score = (
        df.select(*keys, _binary(truth).alias("_t"), _finite(score).alias("score"))
        .groupBy(*keys, "score")
        .agg(F.count_if(F.col("_t") == 1).alias("pos"), F.count_if(F.col("_t") == 0).alias("neg"))
    )
    return running_totals(
        per_score, keys, ["score"], {"pos": F.col("pos"), "neg": F.col("neg")}, rows_per_slice
    )


def roc_auc(
    df: DataFrame,
    truth: str = "y_true",
    score: str = "score",
    keys: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL for a group with one class only."""
    below = F.col("neg_upto") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return (
        _ranked(df, truth, score, keys, rows_per_slice)
        .groupBy(*keys)
        .agg(ratio(wins, pairs).alias("auc"))
    )


def roc_auc_score(df: DataFrame, truth: str = "y_true", score: str = "score") -> float:
    """The area as a number; a table with one class only is an error."""
    auc = roc_auc(df, truth, score).first()["auc"]
    if auc is None:
        raise ValueError("the ROC area needs rows of both classes")
    return auc


def roc_curve(
    df: DataFrame,
    truth: str = "y_true",
    score: str = "score",
    keys: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``threshold, fpr, tpr`` for every distinct score, predicting 1 at or above the threshold."""
    ranked = _ranked(df, truth, score, keys, rows_per_slice)
    pos = F.col("pos_total") - F.col("pos_upto") + F.col("pos")
    neg = F.col("neg_total") - F.col("neg_upto") + F.col("neg")
    return ranked.select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(neg, F.col("neg_total")).alias("fpr"),
        ratio(pos, F.col("pos_total")).alias("tpr"),
    )


def best_threshold(
    df: DataFrame,
    truth: str = "y_true",
    score: str = "score",
    keys: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The threshold with the highest F1 over all distinct scores (the lowest one on ties)."""
    ranked = _ranked(df, truth, score, keys, rows_per_slice)
    tp = F.col("pos_total") - F.col("pos_upto") + F.col("pos")
    fp = F.col("neg_total") - F.col("neg_upto") + F.col("neg")
    f1 = F.coalesce(ratio(2 * tp, tp + fp + F.col("pos_total")), F.lit(0.0))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("_minus"))).alias("_best")
    return ranked.groupBy(*keys).agg(best).select(
        *keys, (-F.col("_best._minus")).alias("threshold"), F.col("_best.f1").alias("f1")
    )


def compare_models(
    df: DataFrame,
    model: str = "model",
    truth: str = "y_true",
    prediction: str = "y_pred",
    score: str = "score",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row of metrics per model from a long table of predictions."""
    report = classification_report(df, truth, prediction, [model]).drop("false_alarm_rate")
    return report.join(roc_auc(df, truth, score, [model], rows_per_slice), model, "left")
