"""Lasting level shifts of KPI series, by cumulative sums against a robust baseline, and ranges that
know the season.

A range over the last few rows follows a shift and stops seeing it. Here each value is compared
with the median of its KPI, in robust deviations; what exceeds an allowance is summed up, never
below zero. The sum at a row is the prefix sum less its running minimum, and both are carried from
slice to slice as one number each, so no task walks a whole KPI.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import attach
from .quantiles import exact_quantiles, value_counts
from .slices import ROWS_PER_SLICE, SLICES, _positions, add_slices, has_long_keys
from .staging import staged

ALLOWANCE = 2.0
CLIP = 6.0
THRESHOLD = 12.0
LEAST_ROWS = 5
# A deviation of the normal distribution is this many median absolute deviations.
MAD_TO_DEVIATION = 1.4826


def robust_baseline(
    df: DataFrame, keys: Sequence[str] = ("kpi_id",), rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """The keys, ``centre``, ``spread`` and ``values`` of each key: exact median, median absolute
    deviation as a deviation, and the number of values. Rows with a NULL key belong to none."""
    keys = list(keys)
    counts = staged(value_counts(df, keys, "value"))
    centres = staged(exact_quantiles(counts, keys, "value", {"centre": 0.5}, rows_per_slice))
    away = F.abs(F.col("value") - F.col("centre"))
    apart = attach(counts, centres, keys, ["value"]).groupBy(*keys, away.alias("away"))
    apart = staged(apart.agg(F.sum("n").alias("n")))
    spreads = exact_quantiles(apart, keys, "away", {"mad": 0.5}, rows_per_slice)
    sizes = apart.groupBy(*keys).agg(F.sum("n").alias("values"))
    return centres.join(spreads, keys).join(sizes, keys).select(
        *keys, "centre", (F.col("mad") * MAD_TO_DEVIATION).alias("spread"), "values"
    )


def level_shifts(
    df: DataFrame,
    ties: Sequence[str] = (),
    allowance: float = ALLOWANCE,
    threshold: float = THRESHOLD,
    clip: float = CLIP,
    least_rows: int = LEAST_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``kpi_id, direction, run_start, run_end, run_length, strength``, one row per lasting shift.

    A value counts with its distance from the median in robust deviations, at most ``clip``; in a
    KPI whose middle half is constant every other value counts with ``clip``. For ``rise`` (and,
    mirrored, ``fall``) the sum goes up by that less ``allowance`` and not below zero. Rows with a
    positive sum in a row are one episode; its shift ends where the sum is highest first, and is
    reported from a ``strength`` of ``threshold`` and ``least_rows`` rows on. Distances are whole
    thousandths of a deviation, so that sums are exact wherever slices are cut.

    Rows without KPI ID, time or value are left out. Rows that agree in time and ``ties`` follow
    by a hash of their other columns.
    """
    known = df.where(F.col("kpi_id").isNotNull() & F.col("event_time").isNotNull() & F.col("value").isNotNull())
    base = staged(robust_baseline(known, rows_per_slice=rows_per_slice).drop("values"))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("kpi_id", "event_time", *ties)]
    tied = known.select("kpi_id", "event_time", *ties, "value", F.xxhash64(*rest).alias("_tie"))
    offset = F.col("value") - F.col("centre")
    far = F.when(F.col("spread") > 0, offset / F.col("spread")).otherwise(F.signum(offset) * clip)
    milli = F.round(F.greatest(F.least(far, F.lit(float(clip))), F.lit(-float(clip))) * 1000).cast("bigint")
    scored = attach(tied, base, ["kpi_id"], ["event_time", "_tie"]).withColumn("_far", milli)
    order = ["event_time", *ties, "_tie"]
    keys = ["kpi_id", "direction"]
    slack = F.lit(round(allowance * 1000)).cast("bigint")
    sides = scored.select("kpi_id", *order, F.inline(F.array(
        F.struct(F.lit("rise").alias("direction"), (F.col("_far") - slack).alias("_step")),
        F.struct(F.lit("fall").alias("direction"), (-F.col("_far") - slack).alias("_step")),
    )))
    if has_long_keys(sides, keys, rows_per_slice):
        rows = add_slices(sides, keys, _positions(sides, order), rows_per_slice, known_long=True)
    else:
        rows = sides.withColumn("_slice", F.array().cast("array<bigint>"))

    place = [*keys, *SLICES]
    ordered = Window.partitionBy(*place).orderBy(*[F.col(c).asc() for c in order])
    walk = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Read for the numbers of the slices and for the rows; the sort runs once.
    rows = staged(
        rows.withColumn("_sum", F.sum("_step").over(walk))
        .withColumn("_low", F.min("_sum").over(walk))
        .withColumn("_row", F.row_number().over(ordered))
        .select(*place, "event_time", "_row", "_step", "_sum", "_low")
    )
    along = Window.partitionBy(*keys).orderBy(*SLICES).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    carried = (
        rows.groupBy(*place).agg(F.sum("_step").alias("_total"), F.min("_low").alias("_least"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(along), zero))
        .withColumn("_floor", F.least(
            zero, F.coalesce(F.min(F.col("_before") + F.col("_least")).over(along), zero)))
        .select(*place, "_before", "_floor")
    )
    # One row per slice, joined on what the rows are dealt by.
    height = F.col("_before") + F.col("_sum") - F.least("_floor", F.col("_before") + F.col("_low"))
    walked = rows.join(carried, place).select(*place, "event_time", "_row", height.alias("_height"))
    by_row = Window.partitionBy(*place).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    numbered = walked.withColumn("_zeros", F.sum((F.col("_height") == 0).cast("bigint")).over(by_row))
    # A part of an episode per slice, with the place of its highest sum counted within the part.
    parts = staged(
        numbered.groupBy(*place, "_zeros").agg(
            F.min(F.when(F.col("_height") > 0, F.col("_row"))).alias("_first"),
            F.min(F.when(F.col("_height") > 0, F.col("event_time"))).alias("run_start"),
            F.count_if(F.col("_height") > 0).alias("_rows"),
            F.max(F.struct("_height", (-F.col("_row")).alias("_at"), "event_time")).alias("_top"),
        )
    )
    zeros = parts.groupBy(*place).agg(F.max("_zeros").alias("_zeros_here")).select(
        *place, F.coalesce(F.sum("_zeros_here").over(along), zero).alias("_zeros_before")
    )
    episodes = parts.where(F.col("_rows") > 0).join(zeros, place).withColumn(
        "_episode", F.col("_zeros") + F.col("_zeros_before"))
    earlier = Window.partitionBy(*keys, "_episode").orderBy(*SLICES).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("_rows").over(earlier), zero) - F.col("_top._at") - F.col("_first") + 1
    top = F.struct(F.col("_top._height"), (-upto).alias("_at"), F.col("_top.event_time"))
    return (
        episodes.withColumn("_best", top)
        .groupBy(*keys, "_episode")
        .agg(F.min("run_start").alias("run_start"), F.max("_best").alias("_best"))
        .select(
            *keys, "run_start", F.col("_best.event_time").alias("run_end"),
            (-F.col("_best._at")).alias("run_length"),
            (F.col("_best._height") / 1000).alias("strength"),
        )
        .where((F.col("strength") >= threshold) & (F.col("run_length") >= least_rows))
    )


def season_slot(time: str = "event_time", season: str = "week") -> Column:
    """Hour of the week (Monday 0:00 is 0) or of the day."""
    if season not in ("week", "day"):
        raise ValueError(f"season must be week or day, not {season!r}")
    hour = F.hour(time)
    return (F.weekday(time) * 24 + hour if season == "week" else hour).cast("int")


def seasonal_range(
    df: DataFrame,
    history: DataFrame | None = None,
    width: float = 3.0,
    least: int = 3,
    season: str = "week",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Adds ``slot, lower, upper, flagged``: a value is flagged outside median ± ``width`` robust
    deviations of the values its KPI had in ``history`` (by default the table itself) in the same
    hour of the ``week`` or ``day``. So a wave that repeats raises no flag, and neither does its
    steep side, which a range over the last rows would flag.

    Slots of fewer than ``least`` values, and rows without KPI ID or time, have no range; neither
    they nor rows without value are flagged. Values are counted by slot first (map-side), quantiles
    are cut into slices, and the profile (one row per KPI and slot) is attached by its size.
    """
    past = (df if history is None else history).withColumn("slot", season_slot(season=season))
    past = past.where(F.col("kpi_id").isNotNull() & F.col("slot").isNotNull())
    profile = staged(
        robust_baseline(past, ("kpi_id", "slot"), rows_per_slice).where(F.col("values") >= least)
    )
    reach = F.lit(float(width)) * F.col("spread")
    bounds = profile.select(
        "kpi_id", "slot", (F.col("centre") - reach).alias("lower"), (F.col("centre") + reach).alias("upper"))
    rows = df.withColumn("slot", season_slot(season=season))
    ranged = attach(rows, bounds, ["kpi_id", "slot"], df.columns, how="left")
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return ranged.select(
        *df.columns, "slot", "lower", "upper", F.coalesce(outside, F.lit(False)).cast("int").alias("flagged"))
