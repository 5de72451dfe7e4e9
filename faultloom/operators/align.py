"""Pairing KPI scores with log scores before fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import ROWS_PER_SLICE, SLICES, _positions, add_slices, has_long_keys, order_position

DIRECTIONS = ("backward", "forward", "nearest")


def align_scores(
    kpi: DataFrame,
    log: DataFrame,
    entity: Sequence[str],
    time: str = "event_time",
    bucket: str = "1 hour",
) -> DataFrame:
    """Highest ``kpi_score`` and ``log_score`` per entity and time bucket, where both exist.

    Each side is reduced to one row per pair before the join, so the join is one to one however
    many rows share a bucket.
    """

    def peaks(df: DataFrame, score: str) -> DataFrame:
        start = F.window(time, bucket)["start"].alias("bucket")
        return df.groupBy(*entity, start).agg(F.max(score).alias(score))

    return peaks(kpi, "kpi_score").join(peaks(log, "log_score"), [*entity, "bucket"])


def _last_seen(
    rows: DataFrame, keys: Sequence[str], sign: int, name: str, rows_per_slice: int
) -> DataFrame:
    """``rows`` (keys, ``_at``, ``_left``, ``_right``) and, as ``name``, the last ``_right`` of the
    key up to each row along ``sign * _at``; at the same time a right row comes before left ones.

    Every slice of a long key starts with the last right row of the slices before it, as one row.
    """
    rows = rows.withColumns({
        "_along": F.col("_at") * sign,
        "_side": F.col("_right").isNull().cast("int"),
        "_tie": F.xxhash64("_left"),
    })
    order = ["_along", "_side", "_tie"]
    rows = rows.withColumn("_leading", F.lit(False))
    if has_long_keys(rows, keys, rows_per_slice):
        sliced = add_slices(rows, keys, _positions(rows, order), rows_per_slice, known_long=True)
        earlier = (
            Window.partitionBy(*keys).orderBy(*SLICES).rowsBetween(Window.unboundedPreceding, -1)
        )
        # max_by ignores rows without an order, which left rows are here.
        latest = F.max_by("_right", F.when(F.col("_side") == 0, F.col("_along")))
        leading = (
            sliced.groupBy(*keys, *SLICES).agg(latest.alias("_last"))
            .select(*keys, *SLICES, F.last("_last", ignorenulls=True).over(earlier).alias("_right"))
            .where(F.col("_right").isNotNull())
            .withColumn("_leading", F.lit(True))
        )
        rows = sliced.unionByName(leading, allowMissingColumns=True)
    else:
        rows = rows.withColumn("_slice", F.array().cast("array<bigint>"))
    walk = (
        Window.partitionBy(*keys, *SLICES)
        .orderBy(F.col("_leading").desc(), *[F.col(c).asc() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = rows.withColumn(name, F.last("_right", ignorenulls=True).over(walk))
    return seen.where(~F.col("_leading")).drop("_leading", "_slice", *order)


def pair_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    take: Mapping[str, str],
    tolerance: float | None = None,
    direction: str = "backward",
    time: str = "event_time",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Every row of ``left`` with the row of ``right`` of the same keys that is nearest in time.

    ``backward`` looks at right rows up to the time of the left row, ``forward`` from it on,
    ``nearest`` at both and prefers the earlier one if they are equally near. ``take`` maps columns
    of ``right`` to names in the result; ``gap_seconds`` is the time of the right row less that of
    the left one. Farther than ``tolerance`` seconds, or without a right row, these are NULL.
    Rows of ``left`` without a key or time are paired with nothing; of right rows of the same key
    and time the one with the largest taken columns counts.

    Both tables are merged into one order and the last right row is carried along it, from slice to
    slice as one row; nothing is joined, and no task sees a whole key.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}, not {direction!r}")
    names = left.columns
    own = F.struct(*[F.col(f"`{c}`") for c in names])
    other = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in take.items()])
    place = [F.col(f"`{k}`") for k in keys]
    a = left.select(*place, order_position(left, time).alias("_at"), own.alias("_left"))
    b = right.select(*place, order_position(right, time).alias("_at"), other.alias("_other"))
    whole = F.col("_at").isNotNull()
    for k in place:
        whole = whole & k.isNotNull()
    b = b.where(whole).groupBy(*place, "_at").agg(F.max("_other").alias("_other"))
    b = b.select(*place, "_at", F.struct("_at", "_other").alias("_right"))
    rows = a.where(whole).unionByName(b, allowMissingColumns=True)
    sides = {"_back": 1, "_ahead": -1}
    if direction != "nearest":
        sides = {k: s for k, s in sides.items() if (s > 0) == (direction == "backward")}
    for name, sign in sides.items():
        rows = _last_seen(rows, keys, sign, name, rows_per_slice)
    found = F.col(next(iter(sides)))
    if direction == "nearest":
        behind, ahead = F.col("_at") - F.col("_back._at"), F.col("_ahead._at") - F.col("_at")
        found = F.when(F.coalesce(ahead < behind, F.col("_back").isNull()), F.col("_ahead")).otherwise(F.col("_back"))
    rows = rows.where(F.col("_left").isNotNull()).select("_at", "_left", found.alias("_found"))
    apart = F.col("_found._at") - F.col("_at")
    if tolerance is not None:
        rows = rows.withColumn(
            "_found", F.when(F.abs(apart) <= F.lit(round(tolerance * 1_000_000)), F.col("_found")))
    rows = rows.select("_left", (apart / 1_000_000).alias("gap_seconds"), F.col("_found._other").alias("_other"))
    alone = a.where(~whole | whole.isNull()).select("_left")
    rows = rows.unionByName(alone, allowMissingColumns=True)
    return rows.select(
        *[F.col("_left").getField(c).alias(c) for c in names],
        *[F.col("_other").getField(n).alias(n) for n in take.values()],
        "gap_seconds",
    )
