"""Named queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import band, classify, fuse, is_fault
from ..operators import (
    align,
    detect,
    distributions,
    evaluate,
    features,
    forest,
    grid,
    logs,
    models,
    profile,
    quality,
    shifts,
    sketches,
    timeframes,
    vocabulary,
)
from ..operators.slices import ROWS_PER_SLICE
from ..sources import LABELLED_COLUMNS, UNLABELLED_COLUMNS, parse_lines
from . import views

Query = Callable[[SparkSession, str], DataFrame]
TIES = ("event_id",)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


_both = views.kpi_sets


def _file_form(df: DataFrame) -> DataFrame:
    """The columns of the CSV files, for the quality checks."""
    names = {"event_time": "timestamp", "kpi_id": "KPI ID"}
    kept = [c for c in ("event_time", "value", "label", "kpi_id") if c in df.columns]
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in kept])


# profile

def kpi_distribution(spark, d):
    return profile.kpi_distribution(*_both(spark, d))


def lineitem_kpi_records(spark, d):
    return profile.kpi_records(views.lineitem_kpi(spark, d))


def dataset_summary(spark, d):
    return _rounded(profile.dataset_summary(*_both(spark, d)), "training", "testing")


def summary_record(spark, d):
    record = profile.summary_record(views.kpi(spark, d)).drop("time_span")
    return _rounded(record, "anomaly_percentage")


def descriptive_stats(spark, d, rows=ROWS_PER_SLICE):
    return _rounded(profile.descriptive_statistics(*_both(spark, d), rows_per_slice=rows), "training", "testing")


def label_distribution(spark, d):
    return profile.label_distribution(views.kpi_train(spark, d))


def timestamp_analysis(spark, d):
    return _rounded(profile.timestamp_analysis(*_both(spark, d)), "span_seconds")


# quality

def quality_checks_train(spark, d):
    return quality.quality_checks(_file_form(views.kpi_train(spark, d)), labelled=True)


def quality_checks_test(spark, d):
    return quality.quality_checks(_file_form(views.kpi_test(spark, d)), labelled=False)


def quality_checks_lineitem(spark, d):
    """Keyed by the line number, which repeats: the duplicate check has something to find."""
    lines = views.lineitem_kpi(spark, d).withColumn("value", F.col("l_quantity"))
    return quality.quality_checks(_file_form(lines), labelled=True)


def quality_checks_dirty(spark, d):
    """Checks of lines with defects: as a labelled table, and as one whose header lacks the value."""
    lines = views.kpi_lines(spark, d)
    labelled = quality.quality_checks(parse_lines(lines, LABELLED_COLUMNS), labelled=True)
    header = [c for c in LABELLED_COLUMNS if c != "value"]
    headless = quality.quality_checks(parse_lines(lines, header), labelled=False)
    return labelled.withColumn("dataset", F.lit("labelled")).unionByName(headless.withColumn("dataset", F.lit("no value")))


def kpi_id_counts(spark, d):
    return quality.kpi_id_counts(*views.customer_series(spark, d))


def kpi_id_consistency(spark, d):
    return quality.kpi_id_consistency(*views.customer_series(spark, d))


def kpi_id_overlap(spark, d):
    return quality.kpi_id_overlap(*views.customer_series(spark, d))


def kpi_id_new(spark, d):
    return quality.kpi_id_new(*views.customer_series(spark, d))


# distributions

def kpi_record_counts(spark, d):
    return distributions.kpi_record_counts(views.kpi(spark, d))


def label_counts_desc(spark, d):
    return distributions.label_counts(views.kpi_train(spark, d))


def value_histogram(spark, d):
    table = distributions.value_histogram(views.kpi(spark, d))
    return _rounded(table, "bin_lo", "bin_hi")


_BOX = ("q1", "median", "q3", "whisker_lo", "whisker_hi")


def box_stats(spark, d, rows=ROWS_PER_SLICE):
    return _rounded(distributions.box_stats(views.kpi(spark, d), rows_per_slice=rows), *_BOX)


def box_stats_by_kpi(spark, d, rows=ROWS_PER_SLICE):
    return _rounded(distributions.box_stats_by_kpi(views.kpi(spark, d), rows_per_slice=rows), *_BOX)


def lineitem_box_stats_by_kpi(spark, d):
    return _rounded(distributions.box_stats_by_kpi(views.lineitem_kpi(spark, d)), *_BOX)


def kpi_outliers(spark, d):
    return distributions.kpi_outliers(views.kpi(spark, d), ["event_id"])


def series_overlay(spark, d):
    return _rounded(distributions.series_overlay(views.kpi(spark, d)), "avg")


# fusion and evaluation

def fused_scores(spark, d):
    s = views.scores(spark, d)
    fused = s.withColumn("fused", fuse(F.col("kpi_score"), F.col("log_score")))
    return _rounded(
        fused.select("event_id", "kpi_score", "log_score", "fused"),
        "kpi_score", "log_score", "fused", digits=9,
    )


def aligned_scores(spark, d):
    s = views.scores(spark, d)
    pairs = align.align_scores(
        s.select("kpi_id", "event_time", "kpi_score"),
        s.select("kpi_id", "event_time", "log_score"),
        ["kpi_id"],
    )
    fused = pairs.withColumn("fused", fuse(F.col("kpi_score"), F.col("log_score"), 0.7, 0.3))
    return _rounded(fused, "kpi_score", "log_score", "fused", digits=9)


def nearest_errors(spark, d, rows=ROWS_PER_SLICE, direction="backward"):
    """Events other than errors, each with the nearest error of its KPI within three days."""
    s = views.kpi(spark, d)
    error = F.col("event_type") == "error"
    return align.pair_nearest(
        s.where(~error).select("kpi_id", "event_time", "event_id"), s.where(error), ["kpi_id"],
        {"value": "error_value", "event_time": "error_time"}, 3 * 86400, direction, rows_per_slice=rows,
    )


def nearest_errors_both_sides(spark, d, rows=ROWS_PER_SLICE):
    return nearest_errors(spark, d, rows, "nearest")


def _fused(spark, d) -> DataFrame:
    s = views.scores(spark, d)
    return s.withColumn("score", fuse(F.col("kpi_score"), F.col("log_score")))


def fused_classes(spark, d):
    return (
        _fused(spark, d).groupBy(classify(F.col("score")).alias("class"))
        .agg(F.count(F.lit(1)).alias("records"))
    )


def fused_bands(spark, d):
    return (
        _fused(spark, d).groupBy(band(F.col("score")).alias("band"))
        .agg(F.count(F.lit(1)).alias("records"))
    )


def _predictions(spark, d) -> DataFrame:
    return _fused(spark, d).select(
        F.col("label").alias("y_true"),
        is_fault(classify(F.col("score"))).alias("y_pred"),
        "score",
    )


def confusion(spark, d):
    return evaluate.confusion(_predictions(spark, d))


def classification_report(spark, d):
    report = evaluate.classification_report(_predictions(spark, d))
    return _rounded(report, *report.columns)


def roc_auc(spark, d, rows=ROWS_PER_SLICE):
    return _rounded(evaluate.roc_auc(_predictions(spark, d), rows_per_slice=rows), "auc")


def roc_curve(spark, d, rows=ROWS_PER_SLICE):
    points = evaluate.roc_curve(_predictions(spark, d), rows_per_slice=rows)
    return _rounded(_rounded(points, "fpr", "tpr"), "threshold", digits=9)


def best_threshold(spark, d):
    return _rounded(evaluate.best_threshold(_predictions(spark, d)), "threshold", "f1")


def model_comparison(spark, d):
    models_ = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(score).alias("score"))
            for name, score in (("fused", "score"), ("kpi", "kpi_score"), ("log", "log_score"))
        ]
    )
    long = _fused(spark, d).select(F.col("label").alias("y_true"), F.inline(models_))
    table = evaluate.compare_models(
        long.withColumn("y_pred", is_fault(classify(F.col("score"))))
    )
    return _rounded(table, *[c for c in table.columns if c != "model"])


# features

def clean_series(spark, d):
    lines = views.lineitem_kpi(spark, d).select("kpi_id", "event_time", "value", "label")
    return features.clean(lines)


def lag_features(spark, d, rows=ROWS_PER_SLICE):
    table = features.add_series_features(views.kpi(spark, d), TIES, windows=(), rows_per_slice=rows)
    return table.select("event_id", "value", "lag_1", "lag_5", "lag_10")


def rolling_features(spark, d, rows=ROWS_PER_SLICE):
    table = features.add_series_features(views.kpi(spark, d), TIES, lags=(), rows_per_slice=rows)
    names = [f"rolling_{f}_{n}" for n in features.WINDOWS for f in ("mean", "std")]
    return _rounded(table.select("event_id", *names), *names)


def time_rolling_features(spark, d, rows=ROWS_PER_SLICE):
    table = timeframes.add_time_rolling(views.kpi(spark, d), (3600, 5 * 86400), least=2, rows_per_slice=rows)
    names = [f"rolling_{f}_{n}s" for n in (3600, 5 * 86400) for f in ("mean", "std")]
    return _rounded(table.select("event_id", *names), *names, digits=9)


def lineitem_time_rolling_features(spark, d):
    """Days with several rows and gaps of weeks: all rows of the last 30 days."""
    lines = views.lineitem_kpi(spark, d)
    table = timeframes.add_time_rolling(lines, (30 * 86400,))
    names = ["rolling_mean_2592000s", "rolling_std_2592000s"]
    keys = ("kpi_id", "event_time", "l_orderkey", "l_linenumber", "l_partkey", "value")
    return _rounded(table.select(*keys, *names), *names)


def _hourly(spark, d, method, longest_gap, rows):
    table = grid.regular_grid(views.kpi(spark, d).drop("event_type", "label"), 3600, method, longest_gap, TIES, rows)
    return _rounded(table, "value")


def hourly_forward(spark, d, rows=ROWS_PER_SLICE):
    return _hourly(spark, d, "forward", None, rows)


def hourly_linear(spark, d, rows=ROWS_PER_SLICE):
    return _hourly(spark, d, "linear", 2 * 86400, rows)


def lineitem_rolling_features(spark, d):
    table = features.add_series_features(
        views.lineitem_kpi(spark, d), views.LINEITEM_TIES, lags=(1,), windows=(10,)
    )
    keys = ("kpi_id", "event_time", "l_orderkey", "l_linenumber", "l_partkey", "value")
    return _rounded(
        table.select(*keys, "lag_1", "rolling_mean_10", "rolling_std_10"),
        "rolling_mean_10", "rolling_std_10", digits=4,
    )


def calendar_features(spark, d):
    return features.add_calendar(views.kpi(spark, d)).select(
        "event_id", "hour_of_day", "day_of_week"
    )


def feature_report(spark, d):
    table = features.kpi_features(views.kpi(spark, d), TIES)
    report = features.feature_report(table, features.feature_columns())
    return _rounded(report, "min", "max")


def scaled_features(spark, d):
    train, test = _both(spark, d)
    scaler = features.FeatureScaler.fit(train, ["value"])
    return _rounded(scaler.transform(test).select("event_id", "value"), "value")


# detection

def adaptive_threshold(spark, d, rows=ROWS_PER_SLICE):
    table = detect.adaptive_threshold(views.kpi(spark, d).drop("event_type"), TIES, rows_per_slice=rows)
    return _rounded(
        table.select("kpi_id", "event_id", "lower", "upper", "flagged"), "lower", "upper"
    )


def anomaly_runs(spark, d, rows=ROWS_PER_SLICE):
    return detect.anomaly_runs(
        views.kpi(spark, d).drop("event_type"), TIES, width=1.0, persistent=2, rows_per_slice=rows
    )


def level_shifts(spark, d, rows=ROWS_PER_SLICE):
    return _rounded(shifts.level_shifts(
        views.kpi(spark, d), TIES, allowance=0.25, threshold=2.0, clip=4.0, least_rows=2, rows_per_slice=rows,
    ), "strength", digits=3)


def seasonal_flags(spark, d):
    table = shifts.seasonal_range(views.kpi(spark, d).drop("event_type", "label"), width=2.0, season="day")
    return _rounded(table.select("event_id", "slot", "lower", "upper", "flagged"), "lower", "upper", digits=5)


_FOREST_FEATURES = ("value", "lag_1", "rolling_mean_5", "rolling_std_5")


def isolation_forest_scores(spark, d):
    train, test = _both(spark, d)
    detector = models.KpiDetector(_FOREST_FEATURES, ("event_id",), trees=50)
    model = detector.fit(features.add_series_features(train, TIES))
    scored = model.transform(features.add_series_features(test, TIES))
    return scored.select("event_id", "score", "prediction")


def given_forest_scores(spark, d):
    """The detector's scores from the given node table: path lengths that SQL can follow."""
    model = forest.IsolationForestModel(("value", "hour"), views.given_nodes(), views.GIVEN_SAMPLE, 0.6)
    rows = views.kpi(spark, d).withColumn("hour", F.hour("event_time"))
    return _rounded(model.transform(rows).select("event_id", "score", "prediction"), "score", digits=9)


def isolation_forest_tuning(spark, d):
    """Exact ROC area of every forest size on the labelled rows, all grown and scored together."""
    train = features.add_series_features(views.kpi_train(spark, d), TIES)
    grown = forest.IsolationForest(_FOREST_FEATURES)
    return grown.tune(train, ["event_id"], "label", [(25, 64), (25, 256), (100, 256)])[1]


def sketch_accuracy(spark, d):
    """Figures merged from daily sketches, held against the rows: exact ones as they are, estimates by
    whether they are within 4 % of the distinct events and 1 % of the rank."""
    rows = views.kpi(spark, d)
    merged = sketches.merged_sketches(sketches.daily_sketches(rows, "event_id"))
    figures = sketches.sketch_figures(merged, [0.5, 0.9])
    value = F.col("value")
    exact = rows.join(F.broadcast(figures.select("kpi_id", "q_50", "q_90")), "kpi_id").groupBy("kpi_id").agg(
        F.count_distinct("event_id").alias("_distinct"), F.count("value").alias("_n"),
        *[c.alias(f"_{q}_{side}") for q in (50, 90) for side, c in
          (("below", F.count_if(value < F.col(f"q_{q}"))), ("upto", F.count_if(value <= F.col(f"q_{q}"))))])

    def near(q):
        n = F.col("_n")
        return (F.col(f"_{q}_below") <= n * (q / 100 + 0.01)) & (F.col(f"_{q}_upto") >= n * (q / 100 - 0.01))

    return figures.join(exact, "kpi_id").select(
        "kpi_id", "days", "n", "missing", "minimum", "maximum",
        (F.abs(F.col("distinct_estimate") - F.col("_distinct")) <= F.col("_distinct") * 0.04).alias("distinct_near"),
        near(50).alias("median_near"), near(90).alias("q90_near"))


# logs

def event_frequencies(spark, d):
    return logs.event_frequencies(views.logs(spark, d))


def occurrence_matrix(spark, d):
    return logs.occurrence_matrix(views.logs(spark, d), views.EVENT_TYPES)


def trace_lengths(spark, d):
    return logs.trace_lengths(views.logs(spark, d))


def trace_length_stats(spark, d):
    stats = logs.trace_length_statistics(views.logs(spark, d))
    return _rounded(stats, "mean", "q1", "median", "q3")


def log_positions(spark, d, rows=ROWS_PER_SLICE):
    placed = logs.log_positions(views.logs(spark, d), views.LOG_ORDER, rows)
    return placed.select("block_id", "event_id", "position", "event")


def log_sequences(spark, d):
    table = logs.log_sequences(views.logs(spark, d), views.LOG_ORDER, segment=20)
    return table.select("block_id", "segment", F.concat_ws(",", "events").alias("events"))


def log_windows(spark, d, rows=ROWS_PER_SLICE):
    table = logs.log_windows(views.logs(spark, d), views.LOG_ORDER, rows_per_slice=rows)
    return table.select(
        "block_id", "event_id", F.concat_ws(",", "history").alias("history"), "next_event"
    )


def next_event_misses(spark, d):
    windows = logs.log_windows(views.logs(spark, d), views.LOG_ORDER)
    return logs.next_event_misses(windows, logs.likely_next(windows))


def _null_event_windows(spark, d) -> DataFrame:
    """Every 17th event is NULL; in the history it shows as a question mark."""
    known = F.when(F.col("event_id") % 17 != 0, F.col("event"))
    events = views.logs(spark, d).withColumn("event", known)
    return logs.log_windows(events, views.LOG_ORDER)


def log_windows_null_events(spark, d):
    table = _null_event_windows(spark, d)
    history = F.array_join("history", ",", "?").alias("history")
    return table.select("block_id", "event_id", history, "next_event")


def next_event_misses_null_events(spark, d):
    windows = _null_event_windows(spark, d)
    return logs.next_event_misses(windows, logs.likely_next(windows))


def _open_windows(spark, d) -> DataFrame:
    """Windows of up to six events before, those at the start of a block too; every 17th event is NULL."""
    event = F.when(F.col("event_id") % 17 != 0, F.col("event"))
    return logs.log_windows(views.logs(spark, d).withColumn("event", event), views.LOG_ORDER, history=6, full=False)


def _contexts(spark, d) -> DataFrame:
    """Learnt from the blocks of even weeks."""
    learnt = _open_windows(spark, d).where(F.substring("block_id", -1, 1).cast("int") % 2 == 0)
    return logs.context_table(learnt, seen=3)


def event_contexts(spark, d):
    return _contexts(spark, d).select("length", "context", F.array_join("likely", ",").alias("likely"))


def backed_off_misses(spark, d):
    """All blocks, with contexts of those of even weeks: histories that were never seen fall back."""
    return logs.backed_off_misses(_open_windows(spark, d), _contexts(spark, d))


def _labelled_matrix(spark, d) -> DataFrame:
    label = F.max((F.col("value") >= 190).cast("int")).alias("label")
    return logs.occurrence_matrix(views.logs(spark, d), views.EVENT_TYPES, [label])


def log_label_distribution(spark, d):
    return profile.label_distribution(_labelled_matrix(spark, d))


def log_quality_checks(spark, d):
    lines = views.logs(spark, d)
    labels = _labelled_matrix(spark, d).select(
        "block_id", F.when(F.col("label") == 1, "Anomaly").otherwise("Normal").alias("label")
    )
    return logs.log_quality_checks(labels, lines)


def random_forest_predictions(spark, d):
    """All blocks, scored by a forest that has not seen those held out."""
    matrix = _labelled_matrix(spark, d)
    kept = models.held_out("block_id")
    model = models.LogDetector(views.EVENT_TYPES, trees=10).fit(matrix.where(~kept))
    scored = model.transform(matrix.withColumn("held_out", kept.cast("int")))
    return scored.select("block_id", "held_out", "score", "prediction")


def lineitem_vocabulary(spark, d, rows=ROWS_PER_SLICE):
    return vocabulary.event_vocabulary(views.order_logs(spark, d), least=2, rows_per_slice=rows)


def lineitem_sparse_occurrences(spark, d):
    """The sparse vector of every order as text, ``index:count`` by rising index."""
    lines = views.order_logs(spark, d)
    sparse = vocabulary.sparse_occurrences(lines, vocabulary.event_vocabulary(lines, least=20))
    pairs = F.zip_with("indices", "counts", lambda i, n: F.concat_ws(":", i.cast("string"), n.cast("int").cast("string")))
    return sparse.select("block_id", F.array_join(pairs, " ").alias("pairs"), "unknown")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        kpi_distribution, lineitem_kpi_records, dataset_summary, summary_record,
        descriptive_stats, label_distribution, timestamp_analysis,
        quality_checks_train, quality_checks_test, quality_checks_lineitem,
        quality_checks_dirty, nearest_errors, nearest_errors_both_sides, level_shifts,
        time_rolling_features, lineitem_time_rolling_features, hourly_forward, hourly_linear,
        seasonal_flags, lineitem_vocabulary, lineitem_sparse_occurrences, kpi_id_consistency,
        kpi_id_counts, kpi_id_overlap, kpi_id_new,
        kpi_record_counts, label_counts_desc, value_histogram, box_stats, box_stats_by_kpi,
        lineitem_box_stats_by_kpi, kpi_outliers, series_overlay,
        fused_scores, aligned_scores, fused_classes, fused_bands, confusion,
        classification_report, roc_auc, roc_curve, best_threshold, model_comparison,
        clean_series, lag_features, rolling_features, lineitem_rolling_features,
        calendar_features, feature_report, scaled_features,
        adaptive_threshold, anomaly_runs, isolation_forest_scores, given_forest_scores,
        isolation_forest_tuning, sketch_accuracy, event_contexts, backed_off_misses,
        event_frequencies, occurrence_matrix, trace_lengths, trace_length_stats, log_positions,
        log_sequences, log_windows, log_windows_null_events, next_event_misses,
        next_event_misses_null_events, log_label_distribution,
        log_quality_checks, random_forest_predictions,
    )
}

# With this many rows a slice, every key of the test tables is cut.
CUT_ROWS = 30
QUERIES |= {
    f"{f.__name__}_cut": partial(f, rows=CUT_ROWS)
    for f in (
        lag_features, rolling_features, adaptive_threshold, anomaly_runs, box_stats,
        box_stats_by_kpi, descriptive_stats, roc_auc, roc_curve, log_positions, log_windows,
        nearest_errors, nearest_errors_both_sides, level_shifts, time_rolling_features,
        hourly_forward, hourly_linear, lineitem_vocabulary,
    )
}
