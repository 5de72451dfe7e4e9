"""Rolling figures over frames of time instead of a number of rows.

Evaluating each frame anew costs rows times rows of a frame. Here time is cut into blocks as long as
the span, so a frame covers the start of the block its last row is in and the end of the block
before. Both are running figures, one forwards and one backwards, which take each row once, however
many rows a frame holds. Figures of parts are merged and never subtracted, so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import ROWS_PER_SLICE, SLICES, _positions, add_slices, has_long_keys, order_position
from .staging import staged

SPANS = (300, 3600)
# The rows of the block of a frame's last row, and those of the block before: how they are walked.
_SIDES = {"own": F.asc, "old": F.desc}
_FIGURES = ("n", "mean", "m2")
_ADDED = ("_value", "_coarse", "_rest")


class _Part(NamedTuple):
    """Figures of some of the rows of a frame; all but ``n`` are NULL where there are none.
    ``m2`` is the sum of the squared distances from the mean. Equal values have themselves as the mean
    and 0 as ``m2``, without any rounding."""

    n: Column
    mean: Column
    m2: Column


def _part(name: str) -> _Part:
    return _Part(*[F.col(f"_{name}_{f}") for f in _FIGURES])


def _with_value(points: DataFrame, side: str) -> DataFrame:
    """The values of a side as ``_value``, and in two parts: the leading 24 binary digits, whose sums
    are exact as long as values are of like size, and the rest. So means are as exact as a number can
    be, in one pass and in any order. Numbers too large for the split, or endless, have no rest."""
    v, fits = F.col("_value"), F.abs("_value") < 1e290
    of_side = F.when(F.col("_own") == (side == "own"), F.col("value").cast("double"))
    high = v * float(2**29 + 1)
    return (
        points.withColumn("_value", of_side)
        .withColumn("_coarse", F.when(fits, high - (high - v)).otherwise(v))
        .withColumn("_rest", F.when(fits, v - F.col("_coarse")).otherwise(F.lit(0.0)))
    )


def _mean(n: Column, coarse: Column, rest: Column) -> Column:
    n = F.nullif(n, F.lit(0))
    return coarse / n + rest / n


def _merged(frame: DataFrame, parts: Sequence[_Part], least: int) -> DataFrame:
    """Adds ``_mean`` and ``_std`` of all parts, NULL below ``least`` values; both are exact where
    all values are equal."""
    zero = F.lit(0.0)
    n = sum((F.coalesce(p.n, F.lit(0)) for p in parts), F.lit(0))
    flat = F.greatest(*[p.m2 for p in parts]) == 0
    low, high = F.least(*[p.mean for p in parts]), F.greatest(*[p.mean for p in parts])
    counted = frame.withColumns({"_n": n, "_low": low, "_flat": flat & (high - low == 0)})
    n = F.nullif(F.col("_n"), F.lit(0))
    mean = sum((F.coalesce(p.mean * (p.n / n), zero) for p in parts), zero)
    centred = counted.withColumn("_all", F.when(F.col("_flat"), F.col("_low")).otherwise(mean))
    off = [p.mean - F.col("_all") for p in parts]
    m2 = sum((F.coalesce(p.m2 + p.n * d * d, zero) for p, d in zip(parts, off, strict=True)), zero)
    m2 = F.when(F.col("_flat"), 0.0).otherwise(m2)
    enough = (F.col("_n") > 0) & (F.col("_n") >= least) & F.col("_at").isNotNull()
    return centred.withColumns({
        "_mean": F.when(enough, F.col("_all")),
        "_std": F.when(enough & (F.col("_n") > 1), F.sqrt(m2 / F.nullif(F.col("_n") - 1, F.lit(0)))),
    })


def _block_rows(rows: DataFrame, span: int) -> DataFrame:
    """Every row in its block of time (``_own``) and once more in the next one, where frames reach
    back to it. ``_place`` is the time since the start of the row's own block: a frame that ends at
    a place holds the own rows up to it and the others from it on. Rows without time come once."""
    width = max(span * 1_000_000, 1)
    place = F.pmod(F.col("_at"), F.lit(width))
    own, both = F.array(F.lit(True)), F.array(F.lit(True), F.lit(False))
    return (
        rows.withColumn("_place", place)
        .withColumn("_own", F.explode(F.when(F.col("_at").isNotNull(), both).otherwise(own) if span else own))
        .withColumn("_block", F.col("_at") - F.col("_place") + F.when(F.col("_own"), 0).otherwise(width))
    )


def _carried(sliced: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row for each slice: the figures of the own rows of all earlier slices of its block, and
    of the other rows of all later ones. Rows are added up map-side; the slices of a block are walked
    by one task."""
    place = [*group, *SLICES]
    slices = sliced.where(F.size("_slice") > 0)
    sums = {}
    for side in _SIDES:
        slices = _with_value(slices, side).withColumnsRenamed({c: f"_{side}{c}" for c in _ADDED})
        v = F.col(f"_{side}_value")
        flat = F.max(v) - F.min(v) == 0
        sums |= {f"_{side}{c}": F.sum(f"_{side}{c}") for c in ("_coarse", "_rest")}
        sums |= {f"_{side}_n": F.count(v), f"_{side}_m2": F.when(flat, 0.0).otherwise(F.var_pop(v) * F.count(v))}
    slices = slices.groupBy(*place).agg(*[c.alias(name) for name, c in sums.items()])
    for side, order in _SIDES.items():
        before = Window.partitionBy(*group).orderBy(order(*SLICES)).rowsBetween(Window.unboundedPreceding, -1)
        added = [f"_{side}{c}" for c in ("_n", "_coarse", "_rest")]
        slices = slices.withColumns({f"_past{c}": F.sum(c).over(before) for c in added})
        n, past = F.col(f"_{side}_n"), F.coalesce(F.col(f"_past_{side}_n"), F.lit(0))
        mean = _mean(past, *[F.col(f"_past{c}") for c in added[1:]])
        # What each slice adds to the sum of squares of the slices before it.
        off = _mean(*[F.col(c) for c in added]) - mean
        adds = F.col(f"_{side}_m2") + F.coalesce(off * off * (past * (n / F.nullif(past + n, F.lit(0)))), F.lit(0.0))
        slices = slices.withColumns({f"_carried_{side}_n": past, f"_carried_{side}_mean": mean, "_adds": adds})
        slices = slices.withColumn(f"_carried_{side}_m2", F.sum("_adds").over(before))
    names = [f"_carried_{side}_{f}" for side in _SIDES for f in _FIGURES]
    return slices.select(*place, *names)


def _add_span(rows: DataFrame, keys: Sequence[str], span: int, least: int, rows_per_slice: int, cut: bool) -> DataFrame:
    """Adds ``_mean`` and ``_std`` over the frames that reach back by ``span`` seconds along ``_at``.

    A block of one key with more than ``rows_per_slice`` rows is cut into slices along ``_place``
    (``cut``); the figures of other slices of the block then enter a slice as one row. Rows that
    agree in place share a slice, since running figures take them all at once."""
    group, points = [*keys, "_block"], _block_rows(rows, span)
    place, parts = group, [_part(side) for side in _SIDES]
    if cut:
        place, parts = [*group, *SLICES], parts + [_part(f"carried_{side}") for side in _SIDES]
        points = add_slices(points, group, _positions(points, ["_place"]), rows_per_slice, known_long=True)
    whole, found = Window.partitionBy(*place), points
    if cut:
        found = points.unionByName(_carried(points, group), allowMissingColumns=True)
    for side, order in _SIDES.items():
        # One order for each side: a slice is sorted and walked twice in all.
        along = whole.orderBy(order("_place"))
        upto = along.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        names = [f"_carried_{side}_{f}" for f in _FIGURES] if cut else []
        found = _with_value(found, side).withColumns({c: F.max(c).over(every) for c in names} | {
            f"_{side}_n": F.count("_value").over(upto), "_coarse": F.sum("_coarse").over(upto),
            "_rest": F.sum("_rest").over(upto), "_var": F.var_pop("_value").over(upto),
        })
        n = F.col(f"_{side}_n")
        found = found.withColumns({f"_{side}_mean": _mean(n, F.col("_coarse"), F.col("_rest")), f"_{side}_m2": F.col("_var") * n})
    found = _merged(found.where("_own"), parts, least)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], "_mean", "_std")


def add_time_rolling(
    df: DataFrame,
    spans: Sequence[int] = SPANS,
    least: int = 1,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``rolling_mean_<n>s`` and ``rolling_std_<n>s`` over all rows of a KPI of the last ``n``
    seconds, both ends included, rows of the same time too. NULL values do not count; a figure is
    NULL below ``least`` values, the sample deviation also below two. Rows without time have none.

    Every span is one shuffle of two rows for each row. A span whose blocks are cut reads the table
    several times, so what earlier spans added is staged before it.
    """
    keys = ["kpi_id"]
    rows = df.withColumn("_at", order_position(df, "event_time"))
    kind = rows.select(F.avg("value").alias("mean")).schema["mean"].dataType
    out = rows
    for i, n in enumerate(spans):
        cut = has_long_keys(_block_rows(rows, n), [*keys, "_block"], rows_per_slice)
        found = _add_span(staged(out) if cut and i else out, keys, n, least, rows_per_slice, cut)
        out = found.withColumns({
            f"rolling_mean_{n}s": F.col("_mean").cast(kind), f"rolling_std_{n}s": F.col("_std"),
        }).drop("_mean", "_std")
    return out.drop("_at")
