"""Exact quantiles by rank selection.

Spark's ``percentile`` keeps a value-to-count map per group in one task. Here equal values are
counted first (combined map-side, spread over ``(key, value)``), and the ranks are found from
running totals over slices of the distinct values, so a key of any length stays distributed.
Interpolation between the two neighbouring ranks is linear.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import ROWS_PER_SLICE, running_totals


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key and distinct non-NULL value, with its number of rows ``n``."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Quantiles per key from ``value_counts``; one column per entry of ``fractions``."""
    ranked = running_totals(counts, keys, [value], {"n": F.col("n")}, rows_per_slice)
    v, last = F.col(value), F.col("n_upto")
    first = last - F.col("n")
    picks = []
    for name, fraction in fractions.items():
        rank = (F.col("n_total") - 1) * F.lit(float(fraction))
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.max(F.when((first <= at) & (at < last), v)).alias(f"_{name}_{side}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_{name}_part"))
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")
            ).alias(n)
            for n in fractions
        ],
    )
