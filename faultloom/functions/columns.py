"""Column expressions shared by the operators. All of them stay inside whole-stage codegen and
work unchanged on batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMAL = "Normal"
ANOMALY = "Anomaly"

# Upper bounds and names of the four fault classes.
DEFAULT_BANDS: tuple[tuple[float, str], ...] = (
    (0.3, "Normal"),
    (0.6, "Warning"),
    (0.8, "Anomaly"),
    (1.0, "Potential Fault"),
)

# Upper bounds (percent of the rarer class) of the imbalance categories.
DEFAULT_IMBALANCE: tuple[tuple[float, str], ...] = (
    (1.0, "Highly Imbalanced"),
    (10.0, "Moderately Imbalanced"),
    (40.0, "Slightly Imbalanced"),
)


def epoch_micros(column: str, kind: T.DataType) -> Column:
    """Microseconds since the epoch of a timestamp column. A timestamp without time zone counts
    as it reads, whatever the session time zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(
            f"unix_date(CAST(`{column}` AS DATE)) * 86400000000L + hour(`{column}`) * 3600000000L"
            f" + minute(`{column}`) * 60000000L"
            f" + CAST(extract(SECOND FROM `{column}`) * 1000000 AS BIGINT)"
        )
    return F.unix_micros(column)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL, not an error, when the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0))


def percentage(part: Column, whole: Column) -> Column:
    return ratio(F.lit(100.0) * part, whole)


def label_name(label: Column) -> Column:
    return (
        F.when(label == 0, NORMAL)
        .when(label == 1, ANOMALY)
        .otherwise(label.cast("string"))
    )


def class_imbalance(
    anomaly_pct: Column, bounds: Sequence[tuple[float, str]] = DEFAULT_IMBALANCE
) -> Column:
    minority = F.least(anomaly_pct, F.lit(100.0) - anomaly_pct)
    chain = F.when(minority.isNull(), F.lit(None).cast("string"))
    for bound, name in bounds:
        chain = chain.when(minority < bound, name)
    return chain.otherwise("Balanced")


def signed_log(value: Column) -> Column:
    """Monotone rescaling that keeps heavy tails from squeezing all other values together."""
    return F.signum(value) * F.log1p(F.abs(value))


def fuse(
    kpi_score: Column, log_score: Column, kpi_weight: float = 0.5, log_weight: float = 0.5
) -> Column:
    """Mean of two scores weighted by ``kpi_weight`` and ``log_weight``."""
    weight_sum = kpi_weight + log_weight
    if weight_sum == 0:
        raise ValueError("fusion weights add up to zero")
    return (kpi_score * F.lit(kpi_weight) + log_score * F.lit(log_weight)) / F.lit(weight_sum)


def classify(score: Column, threshold: float = 0.5) -> Column:
    """Two classes, the threshold itself is an anomaly. A NaN score is normal (Spark would
    order NaN above every threshold), a NULL score has no class."""
    return (
        F.when(F.isnan(score), NORMAL)
        .when(score >= threshold, ANOMALY)
        .when(score.isNotNull(), NORMAL)
    )


def band(score: Column, bands: Sequence[tuple[float, str]] = DEFAULT_BANDS) -> Column:
    """Fault class by half-open score bands; the last band takes everything above."""
    chain = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("string"))
    for upper, name in bands[:-1]:
        chain = chain.when(score < upper, name)
    return chain.otherwise(bands[-1][1])


def is_fault(category: Column) -> Column:
    """Turns a class name into the 0/1 prediction the evaluation operators take."""
    return (category != NORMAL).cast("int")
