"""Order-preserving slices: how one long series is spread over many tasks.

A window partitioned by ``kpi_id`` alone runs a KPI that holds a third of all rows in a single
task. The helpers here cut such a key into slices along its sort order, compute inside each slice,
and carry over the little state a slice needs from its predecessors as extra *rows* of that slice:
the last few rows (``lookback_series``) or the sums so far (``running_totals``). Carrying rows
instead of joining keeps every operator at one shuffle of the data on ``(key, slice)``.

Results do not depend on where the cuts fall: slices are a monotone function of the sort order.
Cuts come from exact minima, maxima and counts. They are found in rounds, each of which reads the
slices that are still too long; so preparing a series runs jobs (one plain count per key if nothing
has to be cut, and then the plan has no more than the window itself).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import epoch_micros
from .staging import staged

ROWS_PER_SLICE = 2_000_000
# The place of a slice in its key: the parts it lies in, from the first cut to the last.
SLICES = ["_slice"]
# Bytes of a text that are compared at a time.
_TEXT_STEP = 6
# Least parts of a cut: a round finds six bits of a position. Empty parts cost nothing; the first cut
# of a key makes fewer where parts would hold only a few rows, since each part with rows costs some.
_LEAST_PARTS = 64
_PART_ROWS = 16
# Cuts of one round that are broadcast; more of them are joined by key and slice.
BROADCAST_CUTS = 200_000
_SALTS = 32



class _Position(NamedTuple):
    """A number with the order of (part of) a sort column, and how its differences are taken."""

    value: Column
    exact: bool


def order_position(df: DataFrame, column: str) -> Column:
    """``column`` as a number with the same order, independent of the session time zone."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(column, kind)
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    return F.col(column)


def _positions(df: DataFrame, order: Sequence[str]) -> Iterator[_Position]:
    """Positions of the sort columns in turn, each made when it is needed. A text has one for every
    few of its bytes, up to the longest text, and one for its length; a column of another kind ends
    the list."""
    for c in order:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            longest = df.agg(F.max(F.octet_length(c))).first()[0] or 0
            code = F.encode(F.col(c), "utf-8")
            for at in range(0, longest, _TEXT_STEP):
                part = F.rpad(F.hex(F.substring(code, at + 1, _TEXT_STEP)), 2 * _TEXT_STEP, "0")
                yield _Position(F.conv(part, 16, 10).cast("bigint"), True)
            yield _Position(F.octet_length(c).cast("bigint"), True)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            yield _Position(F.col(c).cast("double"), False)
        elif isinstance(kind, T.BooleanType):
            yield _Position(F.col(c).cast("bigint"), True)
        elif isinstance(kind, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            yield _Position(order_position(df, c).cast("bigint"), True)
        else:
            return


def _part(position: _Position, lo: Column, width: Column, parts: Column) -> Column:
    """Part of a cut a position falls into: equal widths between the finite extremes; NULL, minus
    infinity, infinity and NaN each apart, in their sort order."""
    p = position.value
    if position.exact:
        # 64-bit differences can overflow and lose digits as doubles; decimals do neither.
        offset = (p.cast("decimal(20,0)") - lo).cast("double")
        inner = F.least(F.floor(offset / width * parts), parts - 1)
        return F.when(p.isNull(), -2).when(width.isNull(), 0).otherwise(inner).cast("bigint")
    endless = F.lit(float("inf"))
    inner = F.least(F.floor((p / 2 - lo) / width * parts), parts - 1)
    return (
        F.when(p.isNull(), -2)
        .when(F.isnan(p), parts + 1)
        .when(p == endless, parts)
        .when(p == -endless, -1)
        .when(width.isNull(), 0)
        .otherwise(inner)
        .cast("bigint")
    )


def _cut(df: DataFrame, cuts: DataFrame, path: Sequence[str], position: _Position, few: bool) -> DataFrame:
    """Appends the part to ``_slice`` of the rows whose slice is in ``cuts``."""
    match = F.lit(True)
    for i, k in enumerate(path):
        match = match & F.col(k).eqNullSafe(F.col(f"_at_{i}"))
    if few:
        joined = df.join(F.broadcast(cuts), match, "left")
    else:
        copies = cuts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = df.withColumn(
            "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_SALTS)).cast("int")
        )
        joined = salted.join(copies, match & (F.col("_salt") == F.col("_copy")), "left")
    part = _part(position, F.col("_lo"), F.col("_width"), F.col("_parts"))
    longer = F.concat(F.col("_slice"), F.array(part))
    return joined.withColumn(
        "_slice", F.when(F.col("_parts").isNotNull(), longer).otherwise(F.col("_slice"))
    ).select(*df.columns)


def has_long_keys(df: DataFrame, keys: Sequence[str], rows_per_slice: int) -> bool:
    """Whether a key has more rows than a slice may hold: one count per key, combined map-side."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return not counted.where(F.col("_rows") > rows_per_slice).isEmpty()


def add_slices(
    df: DataFrame,
    keys: Sequence[str],
    positions: Iterable[_Position],
    rows_per_slice: int = ROWS_PER_SLICE,
    known_long: bool = False,
) -> DataFrame:
    """Adds ``_slice`` (empty for keys of up to ``rows_per_slice`` rows).

    A longer key is cut into equal widths of the first position; slices that are still too long
    are cut again as long as they hold several values of it, then along the next position. What
    is left too long agrees in all positions. Every round counts the rows of each slice (map-side)
    and stages its cuts, one row per slice that it cuts. At most ``BROADCAST_CUTS`` of them are
    broadcast, more are joined on key and slice with the rows of a slice spread by a salt. Without
    long keys nothing is staged and no position is made; ``known_long`` skips that first count.
    """
    out = df.withColumn("_slice", F.array().cast("array<bigint>"))
    if not known_long and not has_long_keys(df, keys, rows_per_slice):
        return out
    path = [*keys, "_slice"]
    for position in positions:
        out = out.withColumn("_position", position.value)
        p, exact = F.col("_position"), position.exact
        if exact:
            finite, low = p, F.min(p).cast("decimal(20,0)")
            width = (F.max(p).cast("decimal(20,0)") - low).cast("double")
        else:  # halves keep the width of doubles finite
            finite = F.when(~F.isnan(p) & (F.abs(p) != float("inf")), p)
            low = F.min(finite) / 2
            width = F.max(finite) / 2 - low
        rows = F.count(F.lit(1))
        several = (F.min(p) < F.max(p)) | ((F.count(p) > 0) & (F.count(p) < rows))
        few_rows = F.when(F.size("_slice") == 0, F.ceil(F.col("_rows") / _PART_ROWS))
        least = F.least(few_rows, F.lit(_LEAST_PARTS))
        parts = F.greatest(F.ceil(F.col("_rows") / rows_per_slice) * 2, least)
        while True:
            found = out.groupBy(*path).agg(
                low.alias("_lo"), F.nullif(width, F.lit(0.0)).alias("_width"),
                rows.alias("_rows"), F.coalesce(several, F.lit(False)).alias("_several"),
            ).where(F.col("_rows") > rows_per_slice)
            found = staged(found.select(
                *[F.col(k).alias(f"_at_{i}") for i, k in enumerate(path)],
                "_lo", "_width", parts.alias("_parts"), "_several",
            ))
            size = found.agg(
                F.count(F.lit(1)).alias("long"), F.count_if("_several").alias("several")
            ).first()
            if not size["several"]:
                break
            cuts = found.where("_several").drop("_several")
            few = size["several"] <= BROADCAST_CUTS
            out = _cut(out, cuts, path, _Position(p, exact), few)
        out = out.drop("_position")
        if not size["long"]:
            break
    return out


class Series(NamedTuple):
    """``rows`` with carried-over predecessors, and the window that walks each slice."""

    rows: DataFrame
    window: WindowSpec

    def finish(self, df: DataFrame) -> DataFrame:
        """Drops the carried-over rows and the helper columns, once windows are computed."""
        return df.where(~F.col("_carried")).drop("_carried", "_tie", *SLICES)


def lookback_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    depth: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> Series:
    """Prepares windows that look at most ``depth`` rows back along ``order`` (a time column and
    its tie-breaks) within ``keys``. Rows that agree in all of ``order`` follow in the order of a
    hash of their other columns.

    Only the last ``depth`` rows of each slice of a cut key are ranked and copied. One task walks
    these rows of a key: ``depth`` rows for every slice, a small fraction of the key.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (*keys, *order)]
    tied = df.withColumn("_tie", F.xxhash64(*rest) if rest else F.lit(0).cast("bigint"))
    order = [*order, "_tie"]
    ascending = [F.col(c).asc() for c in order]
    window = Window.partitionBy(*keys, *SLICES).orderBy(*ascending)
    long = has_long_keys(tied, keys, rows_per_slice)
    if not long:
        return Series(tied.withColumns({"_slice": F.array().cast("array<bigint>"), "_carried": F.lit(False)}), window)
    sliced = add_slices(tied, keys, _positions(tied, order), rows_per_slice, known_long=True)
    rows = sliced.withColumn("_carried", F.lit(False))
    if not depth:
        return Series(rows, window)
    cut = sliced.where(F.size("_slice") > 0)

    from_end = Window.partitionBy(*keys, *SLICES).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        cut.withColumn("_from_end", F.row_number().over(from_end))
        .where(F.col("_from_end") <= depth)
        .drop("_from_end")
    )
    along_key = Window.partitionBy(*keys).orderBy(*ascending)
    payload = F.struct(*[F.col(f"`{c}`") for c in tied.columns])
    carried = (
        tails.withColumn("_previous", F.lag("_slice").over(along_key))
        .withColumn("_before", F.collect_list(payload).over(along_key.rowsBetween(-depth, -1)))
        .where(F.col("_previous").isNotNull() & (F.col("_previous") != F.col("_slice")))
        .select("_slice", F.explode("_before").alias("_row"))
        .select("_row.*", "_slice", F.lit(True).alias("_carried"))
    )
    return Series(rows.unionByName(carried), window)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, Column],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Adds, for each measure ``m``, its sum up to and including the row (``m_upto``) and over
    the whole key (``m_total``). ``order`` must be unique within the key.

    Slice sums are combined map-side; the sums of all earlier slices then enter each slice as one
    leading row, so no ordered window ever spans a whole key.
    """
    along_key = Window.partitionBy(*(keys or [F.lit(0)]))
    measured = df.withColumns({f"_m_{m}": c for m, c in measures.items()})
    if not has_long_keys(df, keys, rows_per_slice):
        upto = along_key.orderBy(*[F.col(c).asc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        added = {f"{m}_upto": F.sum(f"_m_{m}").over(upto) for m in measures}
        added |= {f"{m}_total": F.sum(f"_m_{m}").over(along_key) for m in measures}
        return measured.withColumns(added).select(
            *df.columns, *[f"{m}_{part}" for m in measures for part in ("upto", "total")])
    sliced = add_slices(measured, keys, _positions(df, order), rows_per_slice, known_long=True)
    place = [*keys, *SLICES]
    earlier = along_key.orderBy(*SLICES).rowsBetween(Window.unboundedPreceding, -1)
    leading = (
        sliced.groupBy(*place)
        .agg(*[F.sum(f"_m_{m}").alias(f"_s_{m}") for m in measures])
        .select(
            *place,
            *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0)).alias(f"_m_{m}")
              for m in measures],
            *[F.sum(f"_s_{m}").over(along_key).alias(f"_t_{m}") for m in measures],
            F.lit(True).alias("_leading"),
        )
    )
    rows = sliced.withColumn("_leading", F.lit(False)).unionByName(
        leading, allowMissingColumns=True
    )
    walk = (
        Window.partitionBy(*place)
        .orderBy(F.col("_leading").desc(), *[F.col(c).asc() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added = {}
    for m in measures:
        added[f"{m}_upto"] = F.sum(f"_m_{m}").over(walk)
        added[f"{m}_total"] = F.first(f"_t_{m}", ignorenulls=True).over(walk)
    return rows.withColumns(added).where(~F.col("_leading")).select(*df.columns, *added)
