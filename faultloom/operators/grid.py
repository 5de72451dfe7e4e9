"""Regular grids: missing ticks of a KPI series, filled from its neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import clean
from .slices import ROWS_PER_SLICE, lookback_series, order_position

# Ticks that one row is expanded to at a time; a longer gap is first cut into parts of this many.
TICKS = 10_000


def regular_grid(
    df: DataFrame,
    step: int,
    method: str = "forward",
    longest_gap: int | None = None,
    ties: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``kpi_id, event_time, value, filled``: the values of each KPI at every multiple of ``step``
    seconds since the epoch from its first known value to its last.

    A tick between two known values takes the earlier one (``forward``) or lies on the line between
    them (``linear``); ``filled`` is 0 where the tick itself has a known value. Gaps of more than
    ``longest_gap`` seconds stay empty. Rows without KPI ID, time or value are not known; of rows of
    the same KPI and time one counts, as in ``clean``.

    Every known row makes the ticks up to the next one, which it finds one row back in descending
    order; slices carry that row, so no task holds a KPI, and a gap of any length is expanded in
    parts.
    """
    if method not in ("forward", "linear"):
        raise ValueError(f"method must be forward or linear, not {method!r}")
    known = clean(df, ties).select("kpi_id", "event_time", "value")
    known = known.withColumn("_at", order_position(known, "event_time")).withColumn("_back", -F.col("_at"))
    series = lookback_series(known, ["kpi_id"], ["_back"], 1, rows_per_slice)
    following = F.lag(F.struct("_at", "value")).over(series.window)
    rows = series.finish(series.rows.withColumn("_next", following))
    size = F.lit(step * 1_000_000).cast("bigint")
    gap = F.col("_next._at") - F.col("_at")
    end = F.col("_next._at") - 1
    if longest_gap is not None:
        end = F.when(gap <= longest_gap * 1_000_000, end)
    down = F.col("_at") - F.pmod(F.col("_at"), size)
    first = F.when(down == F.col("_at"), down).otherwise(down + size)
    last = F.coalesce(end, F.col("_at"))
    ticks = F.floor((last - first).cast("decimal(20,0)") / size).cast("bigint") + 1
    parts = (
        rows.withColumns({"_first": first, "_ticks": ticks}).where(F.col("_ticks") > 0)
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_ticks - 1) div {TICKS}"))))
    )
    inside = F.least(F.col("_ticks") - F.col("_part") * TICKS, F.lit(TICKS).cast("bigint")) - 1
    ticked = parts.withColumn("_n", F.explode(F.sequence(F.lit(0).cast("bigint"), inside))).withColumn(
        "_tick", F.col("_first") + (F.col("_part") * TICKS + F.col("_n")) * size)
    after = F.col("_tick") - F.col("_at")
    value = F.col("value")
    if method == "linear":
        line = value + (F.col("_next.value") - value) * (after / gap)
        value = F.when(after == 0, value).otherwise(line)
    seconds = (after.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    moved = F.col("event_time") + F.make_dt_interval(secs=seconds)
    return ticked.select(
        "kpi_id", moved.alias("event_time"), value.alias("value"), (after > 0).cast("int").alias("filled"))
