"""Mean and sample deviation of the last few rows of a series.

A sliding window frame aggregates every frame from scratch. For short frames it is cheaper to look
the rows up by offset, which is one pass over the sorted slice, and to add them up in generated
code. Long frames use the window aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

LONGEST_UNROLLED = 16


def add_rolling(
    rows: DataFrame,
    window: WindowSpec,
    value: str,
    frames: Mapping[str, tuple[int, int]],
) -> DataFrame:
    """For each entry ``name: (nearest, farthest)`` adds ``name_mean`` and ``name_std`` over the
    rows from ``farthest`` back to ``nearest`` back. Both are NULL unless all of them hold values.
    """
    short = {n: f for n, f in frames.items() if f[1] - f[0] < LONGEST_UNROLLED}
    back = sorted({i for first, last in short.values() for i in range(first, last + 1)})
    out = rows.withColumns(
        {f"_back_{i}": F.lag(value, i).over(window) if i else F.col(value) for i in back}
    )
    means, deviations = {}, {}
    for name, (first, last) in frames.items():
        n = last - first + 1
        if name in short:
            values = [F.col(f"_back_{i}") for i in range(first, last + 1)]
            means[f"{name}_mean"] = reduce(add, values) / F.lit(n)
            mean = F.col(f"{name}_mean")
            squares = reduce(add, [(v - mean) * (v - mean) for v in values])
            deviations[f"{name}_std"] = (
                F.sqrt(squares / F.lit(n - 1)) if n > 1 else F.lit(None).cast("double")
            )
        else:
            frame = window.rowsBetween(-last, -first)
            full = F.count(value).over(frame) == n
            means[f"{name}_mean"] = F.when(full, F.avg(value).over(frame))
            deviations[f"{name}_std"] = F.when(full, F.stddev_samp(value).over(frame))
    return out.withColumns(means).withColumns(deviations).drop(*[f"_back_{i}" for i in back])
