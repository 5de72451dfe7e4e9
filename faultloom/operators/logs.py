"""Event-log operators: sequences, occurrence matrix, frequencies, windows, next-event misses.

A log table is in long form ``block_id, event, <order columns>``. A block may be any length, so
sequences stay rows with a position, or arrays of a fixed segment length; no operator collects a
whole block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import attach
from .quantiles import exact_quantiles, value_counts
from .slices import ROWS_PER_SLICE, lookback_series, running_totals

BLOCK = "block_id"
SEGMENT = 1000
HISTORY = 3
TOP = 2


def explode_traces(traces: DataFrame) -> DataFrame:
    """Rows ``block_id, position, event`` of a table of event arrays (positions from 1)."""
    return traces.select(BLOCK, F.posexplode("trace").alias("_at", "event")).select(
        BLOCK, (F.col("_at") + 1).cast("bigint").alias("position"), "event"
    )


def log_positions(
    events: DataFrame, order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Adds (or renumbers) ``position``, the place of each event in its block, counted from 1."""
    one = {"_n": F.lit(1).cast("bigint")}
    placed = running_totals(events, [BLOCK], order, one, rows_per_slice=rows_per_slice)
    return placed.withColumn("position", F.col("_n_upto")).drop("_n_upto", "_n_total")


def log_sequences(
    events: DataFrame,
    order: Sequence[str],
    segment: int = SEGMENT,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``block_id, segment, events``: the sequence of each block as arrays of ``segment`` events,
    the last one shorter. Every event is in exactly one segment."""
    placed = log_positions(events, order, rows_per_slice)
    in_order = F.array_sort(F.collect_list(F.struct("position", "event")))
    return (
        placed.withColumn("segment", F.floor((F.col("position") - 1) / segment))
        .groupBy(BLOCK, "segment")
        .agg(F.transform(in_order, lambda e: e["event"]).alias("events"))
    )


def occurrence_matrix(
    events: DataFrame, vocabulary: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per block, one count column per event of ``vocabulary``, and the named aggregates
    ``extra``. The conditional counts combine map-side; the vocabulary is given, so no extra pass
    looks for it."""
    return events.groupBy(BLOCK).agg(
        *[F.count_if(F.col("event") == e).alias(e) for e in vocabulary], *extra
    )


def event_frequencies(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("records"))


def trace_lengths(events: DataFrame) -> DataFrame:
    return events.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("trace_length"))


def trace_length_statistics(
    events: DataFrame, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Number of blocks, extremes, mean and quartiles of the trace lengths, as one row."""
    lengths = trace_lengths(events)
    spread = lengths.agg(
        F.struct(
            F.count(F.lit(1)).alias("blocks"),
            F.min("trace_length").alias("shortest"),
            F.max("trace_length").alias("longest"),
            F.avg("trace_length").alias("mean"),
        )
    ).scalar()
    quartiles = exact_quantiles(
        value_counts(lengths, [], "trace_length"), [], "trace_length",
        {"q1": 0.25, "median": 0.5, "q3": 0.75}, rows_per_slice,
    )
    return quartiles.withColumn("_s", spread).select("_s.*", "q1", "median", "q3")


def log_quality_checks(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Schema checks of the log tables: ``check, violations, passed``."""
    label_checks = (
        labels.groupBy(BLOCK)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("label").isNull()).alias("no_label"),
            F.count_if(
                F.col("label").isNotNull() & ~F.col("label").isin("Normal", "Anomaly")
            ).alias("odd_label"),
        )
        .agg(
            F.coalesce(F.sum(F.when(F.col(BLOCK).isNull(), F.col("n"))), F.lit(0)).alias(
                "label_block_present"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("label_block_unique"),
            F.coalesce(F.sum("no_label"), F.lit(0)).alias("label_present"),
            F.coalesce(F.sum("odd_label"), F.lit(0)).alias("label_values"),
        )
    )
    event_checks = events.agg(
        F.count_if(F.col(BLOCK).isNull()).alias("event_block_present"),
        F.count_if(F.col("event").isNull()).alias("event_present"),
    )
    unlabelled = (
        events.select(BLOCK).where(F.col(BLOCK).isNotNull()).distinct()
        .join(labels.select(BLOCK).distinct(), BLOCK, "left_anti")
        .agg(F.count(F.lit(1)).alias("event_block_labelled"))
    )
    rows = None
    for wide in (label_checks, event_checks, unlabelled):
        long = wide.unpivot([], wide.columns, "check", "violations")
        rows = long if rows is None else rows.unionByName(long)
    return rows.withColumn("passed", F.col("violations") == 0)


def log_windows(
    events: DataFrame,
    order: Sequence[str],
    history: int = HISTORY,
    rows_per_slice: int = ROWS_PER_SLICE,
    full: bool = True,
) -> DataFrame:
    """Training windows: each event with the ``history`` events before it in its block. Events
    with fewer predecessors have no window, or a shorter one without ``full``; NULL events take
    part like any other."""
    series = lookback_series(
        events.select(BLOCK, "event", *order), [BLOCK], order, history, rows_per_slice
    )
    # A list of bare events would leave NULL out.
    before = F.collect_list(F.struct("event")).over(series.window.rowsBetween(-history, -1))
    events_before = F.transform(before, lambda e: e["event"])
    windows = series.finish(series.rows.withColumn("history", events_before))
    if full:
        windows = windows.where(F.size("history") == history)
    return windows.select(
        BLOCK, *order, "history", F.col("event").alias("next_event")
    )


def likely_next(windows: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` most frequent next events per history: ``history, next_event``. Transitions
    are counted before they are ranked, so a history has at most one row per event type."""
    counted = windows.groupBy("history", "next_event").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("history").orderBy(F.col("n").desc(), "next_event")
    return (
        counted.withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= top)
        .select("history", "next_event")
    )


def next_event_misses(
    windows: DataFrame, expected: DataFrame, tolerated: int = 0
) -> DataFrame:
    """Per block the number of events that are not among the expected ones for their history;
    ``flagged`` when there are more than ``tolerated``."""
    per_block = windows.groupBy(BLOCK, "history", "next_event").agg(
        F.count(F.lit(1)).alias("n")
    )
    # A NULL event may be an expected one, and a join on columns would never match it; as parts
    # of one text, NULL and empty events differ and match themselves.
    step = F.to_json(F.struct("history", "next_event"), {"ignoreNullFields": "false"})
    known = expected.select(step.alias("_step"), F.lit(True).alias("_known"))
    checked = attach(
        per_block.withColumn("_step", step), known, ["_step"], [BLOCK], how="left", count_keys=False
    )
    missed = F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0))
    return checked.groupBy(BLOCK).agg(missed.alias("misses")).withColumn(
        "flagged", (F.col("misses") > tolerated).cast("int")
    )


def _text(*columns: Column | str) -> Column:
    """Columns as one text in which NULL and empty events differ and match themselves."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _suffixes(history: str) -> Column:
    """The last 0, 1, ... events of a history as ``length, context``."""
    size = F.size(history)
    return F.transform(
        F.sequence(F.lit(0), size),
        lambda k: F.struct(k.alias("length"), _text(F.slice(history, size - k + 1, k).alias("events")).alias("context")),
    )


def context_table(windows: DataFrame, top: int = TOP, seen: int = 1) -> DataFrame:
    """Contexts of every length up to that of the histories: ``context, length, likely``, the
    ``top`` most frequent next events, by rank, of each context that came before at least ``seen`` events.

    Histories are counted before they are cut into suffixes, and suffixes of all lengths are
    counted in one aggregation, so even the empty context has at most one row per event type.
    """
    counted = windows.groupBy("history", "next_event").agg(F.count(F.lit(1)).alias("n"))
    counted = (
        counted.select(F.explode(_suffixes("history")).alias("_suffix"), "next_event", "n")
        .groupBy("_suffix.length", "_suffix.context", "next_event")
        .agg(F.sum("n").alias("n"))
    )
    one = Window.partitionBy("length", "context")
    rank = F.row_number().over(one.orderBy(F.col("n").desc(), "next_event"))
    return (
        counted.withColumns({"_rank": rank, "_total": F.sum("n").over(one)})
        .where((F.col("_rank") <= top) & (F.col("_total") >= seen))
        .groupBy("length", "context")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", _text("next_event").alias("text")))).alias("_ranked"))
        .select("length", "context", F.transform("_ranked", lambda r: r["text"]).alias("likely"))
    )


def backed_off_misses(windows: DataFrame, contexts: DataFrame, tolerated: int = 0) -> DataFrame:
    """Per block the events that are not among the likely ones after the longest known end of their
    history (``misses``) and those whose whole history is unknown (``backed_off``); ``flagged`` as
    in ``next_event_misses``. A history without any known end, not even the empty one, is a miss.

    Ends are looked up once for each distinct history, not for each event.
    """
    whole = _text("history")
    counted = windows.groupBy(BLOCK, "history", "next_event").agg(F.count(F.lit(1)).alias("n"))
    ends = windows.select("history").distinct().select(
        whole.alias("_history"), F.explode(_suffixes("history")).alias("_suffix")
    ).select("_history", "_suffix.context")
    known = attach(ends, contexts, ["context"], ["_history"], count_keys=False)
    best = known.groupBy("_history").agg(
        F.max("length").alias("_length"), F.max_by("likely", "length").alias("_likely"))
    checked = attach(
        counted.withColumn("_history", whole), best, ["_history"], [BLOCK], how="left", count_keys=False
    )
    expected = F.coalesce(F.array_contains("_likely", _text("next_event")), F.lit(False))
    shorter = F.coalesce(F.col("_length"), F.lit(-1)) < F.size("history")
    return checked.groupBy(BLOCK).agg(
        F.sum(F.when(~expected, F.col("n")).otherwise(0)).alias("misses"),
        F.sum(F.when(shorter, F.col("n")).otherwise(0)).alias("backed_off"),
    ).withColumn("flagged", (F.col("misses") > tolerated).cast("int"))
