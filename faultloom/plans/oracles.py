"""SQL statements that compute the catalog queries independently, for a plain SQL database."""

from __future__ import annotations

from .views import GIVEN_NODES, GIVEN_SAMPLE

_KPI = """
kpi AS (
  SELECT event_id, ts AS event_time, value, CAST(value >= 190 AS INT) AS label,
         concat('KPI-', lpad(CAST(user_id % 26 AS VARCHAR(2)), 2, '0')) AS kpi_id, event_type
  FROM events),
kpi_train AS (SELECT event_id, kpi_id, event_time, value, label FROM kpi
              WHERE event_time < TIMESTAMP '2024-01-16 00:00:00'),
kpi_test AS (SELECT event_id, kpi_id, event_time, value FROM kpi
             WHERE event_time >= TIMESTAMP '2024-01-16 00:00:00')"""

_SCORES = _KPI + """,
scores AS (
  SELECT event_id, kpi_id, event_time, label, least(value / 500, 1.0) AS kpi_score,
         CASE WHEN event_type = 'error' THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END AS log_score
  FROM kpi),
fused AS (SELECT *, (kpi_score * 0.5 + log_score * 0.5) / 1.0::DOUBLE AS score FROM scores),
predictions AS (SELECT label AS y_true, CAST(score >= 0.5 AS INT) AS y_pred, score FROM fused)"""

_LINES = """
lines AS (
  SELECT l_suppkey AS kpi_id, l_shipdate AS event_time, l_extendedprice AS value,
         CAST(l_quantity >= 49 AS INT) AS label, l_orderkey, l_linenumber, l_partkey, l_quantity
  FROM lineitem)"""

_LOGS = """
logs AS (
  SELECT concat(CAST(user_id AS VARCHAR), '-',
                CAST(isoyear(ts) * 100 + weekofyear(ts) AS VARCHAR)) AS block_id,
         event_type AS event, ts AS event_time, event_id, value
  FROM events)"""

_CUSTOMERS = """
series AS (SELECT concat('C-', CAST(o_custkey AS VARCHAR)) AS kpi_id, o_orderdate AS t FROM orders),
a AS (SELECT DISTINCT kpi_id FROM series WHERE t < TIMESTAMP '1996-06-01 00:00:00'),
b AS (SELECT DISTINCT kpi_id FROM series WHERE t >= TIMESTAMP '1996-06-01 00:00:00')"""

_METRICS = """
  SELECT CAST(count(*) AS DOUBLE) AS "rows", CAST({columns} AS DOUBLE) AS columns,
         CAST(count(DISTINCT kpi_id) AS DOUBLE) AS kpi_ids,
         {anomalies} AS anomalies, {normals} AS normal_records, {pct} AS anomaly_percentage,
         epoch_us(min(event_time)) / 1e6 AS min_timestamp,
         epoch_us(max(event_time)) / 1e6 AS max_timestamp,
         (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1e6 AS span_seconds,
         CAST(count(DISTINCT event_time) AS DOUBLE) AS unique_timestamps
  FROM {table}"""

_TRAIN_METRICS = _METRICS.format(
    columns="(SELECT count(*) FROM (DESCRIBE SELECT * FROM kpi_train))", anomalies="CAST(sum(label) AS DOUBLE)", normals="CAST(sum(1 - label) AS DOUBLE)",
    pct="100.0::DOUBLE * sum(label) / count(*)", table="kpi_train",
)
_TEST_METRICS = _METRICS.format(
    columns="(SELECT count(*) FROM (DESCRIBE SELECT * FROM kpi_test))", anomalies="CAST(NULL AS DOUBLE)", normals="CAST(NULL AS DOUBLE)",
    pct="CAST(NULL AS DOUBLE)", table="kpi_test",
)

_STATISTICS = """
  SELECT CAST(count(value) AS DOUBLE) AS "Count", min(value) AS "Min", max(value) AS "Max",
         avg(value) AS "Mean", quantile_cont(value, 0.5) AS "Median",
         stddev_samp(value) AS "Std Dev", quantile_cont(value, 0.25) AS "25th Percentile",
         quantile_cont(value, 0.75) AS "75th Percentile",
         quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS "IQR"
  FROM {table}"""


def _box(source: str, by_kpi: bool) -> str:
    key, group = ("kpi_id,", "GROUP BY kpi_id") if by_kpi else ("", "")
    match = "s.kpi_id = q.kpi_id" if by_kpi else "true"
    pick = "q.kpi_id," if by_kpi else ""
    return f"""
q AS (SELECT {key} quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM {source} {group}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM q)
SELECT {pick} round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(least(min(value) FILTER (value BETWEEN fence_lo AND fence_hi), q1), 6) AS whisker_lo,
       round(greatest(max(value) FILTER (value BETWEEN fence_lo AND fence_hi), q3), 6)
         AS whisker_hi,
       count(*) FILTER (value < fence_lo OR value > fence_hi) AS outliers
FROM {source} s JOIN f q ON {match} GROUP BY {pick} q1, median, q3"""


def _checks(source: str, labelled: bool) -> str:
    required = ["event_time", "value", "kpi_id", *(["label"] if labelled else [])]
    kinds = {
        "required_columns": f"(SELECT count(*) FROM unnest({required}) AS r(name)"
        " WHERE NOT list_contains((SELECT json_keys(to_json(t)) FROM t LIMIT 1), name))",
        "data_types": "(SELECT count(*) FILTER (value IS NOT NULL AND TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) IS NULL)"
        " + count(*) FILTER (event_time IS NOT NULL AND TRY_CAST(CAST(event_time AS VARCHAR) AS TIMESTAMP) IS NULL)"
        + (" + count(*) FILTER (label IS NOT NULL AND TRY_CAST(CAST(label AS VARCHAR) AS INTEGER) IS NULL)" if labelled else "")
        + " FROM t)",
        "missing_values": "(SELECT count(*) FILTER (event_time IS NULL)"
        " + count(*) FILTER (value IS NULL OR isnan(value)) + count(*) FILTER (kpi_id IS NULL)"
        + (" + count(*) FILTER (label IS NULL)" if labelled else "")
        + " FROM t)",
        "duplicate_rows": "(SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))",
        "label_values": "(SELECT count(*) FILTER (label NOT IN (0, 1)) FROM t)",
        "kpi_id_present": "(SELECT count(*) FILTER (kpi_id IS NULL) FROM t)",
        "timestamp_valid": "(SELECT count(*) FILTER (event_time IS NULL) FROM t)",
    }
    if not labelled:
        del kinds["label_values"]
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS \"check\", CAST({v} AS BIGINT) AS violations" for k, v in kinds.items()
    )
    return f"t AS ({source}), c AS ({rows}) SELECT *, violations = 0 AS passed FROM c"


def _line_checks(header: str, required: str, labelled: bool) -> str:
    """Checks of CSV lines: fields by name, typed by TRY_CAST."""
    names = header.split(",")

    def field(name: str) -> str:
        if name not in names:
            return "NULL"
        at = names.index(name) + 1
        return f"CASE WHEN f[{at}] NOT IN ('', 'N/A', 'NaN') THEN f[{at}] END"

    there = [c for c in required.split(",") if c in names]
    columns = {"timestamp": "ts", "value": "v", "label": "l", "KPI ID": "k"}
    kinds = {
        "required_columns": f"max((SELECT count(*) FROM unnest(string_split('{required}', ',')) AS r(name)"
        f" WHERE name NOT IN (SELECT unnest(string_split('{header}', ',')))))",
        "data_types": "count(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL)"
        " + count(*) FILTER (ts IS NOT NULL AND TRY_CAST(ts AS TIMESTAMP) IS NULL)"
        + (" + count(*) FILTER (l IS NOT NULL AND TRY_CAST(l AS INTEGER) IS NULL)" if labelled else ""),
        "missing_values": " + ".join(f"count(*) FILTER ({columns[c]} IS NULL)" for c in there),
        "duplicate_rows": "count(*) - count(DISTINCT (ts, v, l, k, bad))",
        "label_values": "count(*) FILTER (l IS NOT NULL AND coalesce(TRY_CAST(l AS INTEGER) NOT IN (0, 1), true))",
        "kpi_id_present": "count(*) FILTER (k IS NULL)",
        "timestamp_valid": "count(*) FILTER (TRY_CAST(ts AS TIMESTAMP) IS NULL)",
        "row_shape": "count(*) FILTER (bad IS NOT NULL)",
    }
    if not labelled:
        del kinds["label_values"]
    parsed = (
        f"SELECT {field('timestamp')} AS ts, {field('value')} AS v, {field('label')} AS l, {field('KPI ID')} AS k,"
        f" CASE WHEN len(f) <> {len(names)} THEN line END AS bad FROM fields"
    )
    return " UNION ALL ".join(
        f"SELECT '{k}' AS \"check\", CAST({c} AS BIGINT) AS violations FROM ({parsed})" for k, c in kinds.items()
    )


_DIRTY = """
marked AS (
  SELECT event_id AS n, label, kpi_id,
         CASE WHEN event_id % 23 = 1 THEN 'yesterday' WHEN event_id % 31 = 2 THEN '' ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S') END AS ts,
         CASE WHEN event_id % 13 = 1 THEN 'abc' WHEN event_id % 13 = 4 THEN 'NaN' ELSE CAST(CAST(round(value) AS INTEGER) AS VARCHAR) END AS v
  FROM kpi),
texts AS (
  SELECT n, concat_ws(',', ts, v) AS short,
         concat_ws(',', ts, v, CASE n % 17 WHEN 2 THEN '7' WHEN 5 THEN 'maybe' WHEN 6 THEN '' ELSE CAST(label AS VARCHAR) END,
                   CASE WHEN n % 19 = 3 THEN 'N/A' ELSE kpi_id END) AS whole
  FROM marked),
lines AS (
  SELECT CASE WHEN n % 11 = 5 THEN short WHEN n % 11 = 3 THEN concat(whole, ',more') ELSE whole END AS line,
         unnest(range(CASE WHEN n % 29 = 0 THEN 3 ELSE 1 END)) AS copy
  FROM texts),
fields AS (SELECT line, string_split(line, ',') AS f FROM lines)"""

_GRID = """
points AS (SELECT kpi_id, epoch_us(event_time) AS t, arg_min(value, event_id) AS v FROM kpi WHERE value IS NOT NULL GROUP BY ALL),
following AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM points WINDOW w AS (PARTITION BY kpi_id ORDER BY t)),
ticks AS (
  SELECT *, unnest(range((t + 3599999999) // 3600000000 * 3600000000,
                         CASE WHEN t2 IS NULL OR t2 - t > {longest} THEN t + 1 ELSE t2 END, 3600000000)) AS tick FROM following)
SELECT kpi_id, make_timestamp(tick) AS event_time, round({value}, 6) AS value, CAST(tick > t AS INTEGER) AS filled FROM ticks"""

_NEAREST = """
l AS (SELECT kpi_id, event_time, event_id FROM kpi WHERE event_type <> 'error'),
r AS (SELECT kpi_id, event_time, max(value) AS value FROM kpi WHERE event_type = 'error' GROUP BY ALL),
b AS (SELECT l.*, r.value AS bv, r.event_time AS bt FROM l ASOF LEFT JOIN r ON l.kpi_id = r.kpi_id AND l.event_time >= r.event_time),
f AS (SELECT b.*, r.value AS fv, r.event_time AS ft FROM b ASOF LEFT JOIN r ON b.kpi_id = r.kpi_id AND b.event_time <= r.event_time),
picked AS (
  SELECT kpi_id, event_time, event_id, CASE WHEN {ahead} THEN fv ELSE bv END AS v, CASE WHEN {ahead} THEN ft ELSE bt END AS t FROM f),
near AS (SELECT *, epoch_us(t) - epoch_us(event_time) AS gap FROM picked)
SELECT kpi_id, event_time, event_id,
       CASE WHEN abs(gap) <= 259200000000 THEN v END AS error_value, CASE WHEN abs(gap) <= 259200000000 THEN t END AS error_time,
       CASE WHEN abs(gap) <= 259200000000 THEN gap / 1000000 END AS gap_seconds FROM near"""

_AUC = """
per_score AS (SELECT {key} score, CAST(sum(y_true) AS DOUBLE) AS pos,
                     CAST(sum(1 - y_true) AS DOUBLE) AS neg
              FROM {source} GROUP BY {key} score),
cumulated AS (SELECT *, sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_upto,
                     sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_upto,
                     sum(neg) OVER ({part}) AS neg_total, sum(pos) OVER ({part}) AS pos_total
              FROM per_score WINDOW w AS ({part} ORDER BY score))"""
_ROC = _SCORES + "," + _AUC.format(key="", part="", source="predictions")

_RANGE = """
recent AS (
  SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s
  FROM kpi WINDOW w AS (PARTITION BY kpi_id ORDER BY event_time, event_id
                        ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
ranged AS (SELECT *, CASE WHEN n = 10 THEN m - {k} * s END AS lower,
                  CASE WHEN n = 10 THEN m + {k} * s END AS upper FROM recent),
tagged AS (SELECT *, CASE WHEN value > upper THEN 'spike' WHEN value < lower THEN 'drop' END AS kind
           FROM ranged)"""

_SERIES = "(PARTITION BY kpi_id ORDER BY event_time, event_id)"


def _rolling(n: int) -> str:
    frame = (
        "(PARTITION BY kpi_id ORDER BY event_time, event_id"
        f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )
    full = f"count(value) OVER {frame} = {n}"
    return (
        f"CASE WHEN {full} THEN avg(value) OVER {frame} END AS rolling_mean_{n},"
        f" CASE WHEN {full} THEN stddev_samp(value) OVER {frame} END AS rolling_std_{n}"
    )


_FEATURES = f"""
featured AS (
  SELECT event_id, value, lag(value, 1) OVER {_SERIES} AS lag_1,
         lag(value, 5) OVER {_SERIES} AS lag_5, lag(value, 10) OVER {_SERIES} AS lag_10,
         {_rolling(5)}, {_rolling(10)},
         hour(event_time) AS hour_of_day, isodow(event_time) - 1 AS day_of_week
  FROM kpi)"""
_FEATURE_NAMES = (
    "value", "lag_1", "lag_5", "lag_10", "rolling_mean_5", "rolling_std_5", "rolling_mean_10",
    "rolling_std_10", "hour_of_day", "day_of_week",
)

_WINDOWS = _LOGS + """,
placed AS (SELECT *, row_number() OVER w AS position,
                  list(event) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS h
           FROM logs WINDOW w AS (PARTITION BY block_id ORDER BY event_time, event_id)),
windows AS (SELECT block_id, event_id, array_to_string(h, ',') AS history, event AS next_event
            FROM placed WHERE position > 3)"""

_NULL_EVENTS = _LOGS + """,
gaps AS (SELECT * REPLACE (CASE WHEN event_id % 17 <> 0 THEN event END AS event) FROM logs),
placed AS (SELECT *, row_number() OVER w AS position,
                  list(coalesce(event, '?')) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS h
           FROM gaps WINDOW w AS (PARTITION BY block_id ORDER BY event_time, event_id)),
windows AS (SELECT block_id, event_id, array_to_string(h, ',') AS history, event AS next_event
            FROM placed WHERE position > 3)"""

_CONTEXTS = _LOGS + """,
gaps AS (SELECT * REPLACE (CASE WHEN event_id % 17 <> 0 THEN event END AS event) FROM logs),
quoted AS (SELECT block_id, event_id, event_time, coalesce('"' || event || '"', 'null') AS e FROM gaps),
placed AS (SELECT block_id, event_id, e,
                  coalesce(list(e) OVER (PARTITION BY block_id ORDER BY event_time, event_id
                                         ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS h FROM quoted),
ends AS (SELECT block_id, event_id, e, len(h) AS whole, k AS length,
                concat('{"events":[', array_to_string(h[len(h) - k + 1 : len(h)], ','), ']}') AS context
         FROM placed, (SELECT unnest(range(0, 7)) AS k) WHERE k <= len(h)),
counted AS (SELECT length, context, e, count(*) AS n FROM ends
            WHERE CAST(right(block_id, 1) AS INT) % 2 = 0 GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY length, context) AS total,
                  row_number() OVER (PARTITION BY length, context ORDER BY n DESC, nullif(e, 'null') NULLS FIRST) AS r
           FROM counted),
likely AS (SELECT length, context, list('{"next_event":' || e || '}' ORDER BY r) AS likely FROM ranked
           WHERE r <= 2 AND total >= 3 GROUP BY ALL)"""

_MATRIX_LABEL = _LOGS + """,
labelled AS (SELECT block_id, max(CAST(value >= 190 AS INT)) AS label FROM logs GROUP BY block_id)"""

ORACLES: dict[str, str] = {
    "kpi_distribution": f"""WITH {_KPI},
a AS (SELECT kpi_id, count(*) AS n, sum(label) AS x, min(event_time) AS f, max(event_time) AS l
      FROM kpi_train GROUP BY kpi_id),
b AS (SELECT kpi_id, count(*) AS n, min(event_time) AS f, max(event_time) AS l
      FROM kpi_test GROUP BY kpi_id)
SELECT coalesce(a.kpi_id, b.kpi_id) AS kpi_id, coalesce(a.n, 0) AS train_records,
       CAST(coalesce(a.x, 0) AS BIGINT) AS train_anomalies,
       round(100.0::DOUBLE * a.x / a.n, 2) AS train_anomaly_pct,
       coalesce(b.n, 0) AS test_records, a.f AS train_first, a.l AS train_last,
       b.f AS test_first, b.l AS test_last
FROM a FULL OUTER JOIN b ON a.kpi_id = b.kpi_id""",
    "lineitem_kpi_records": f"""WITH {_LINES}
SELECT kpi_id, count(*) AS records, count(*) FILTER (label = 1) AS anomalies,
       count(*) FILTER (label = 0) AS normals, min(event_time) AS first_time,
       max(event_time) AS last_time FROM lines GROUP BY kpi_id""",
    "dataset_summary": f"""WITH {_KPI},
a AS (UNPIVOT ({_TRAIN_METRICS}) ON COLUMNS(*) INTO NAME metric VALUE training),
b AS (UNPIVOT ({_TEST_METRICS}) ON COLUMNS(*) INTO NAME metric VALUE testing)
SELECT a.metric, round(training, 6) AS training, round(testing, 6) AS testing
FROM a LEFT JOIN b ON a.metric = b.metric""",
    "summary_record": f"""WITH {_KPI}
SELECT count(*) AS total_records, CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM kpi)) AS INT) AS total_columns, count(DISTINCT kpi_id) AS kpi_count,
       CAST(sum(label) AS BIGINT) AS anomaly_count, CAST(sum(1 - label) AS BIGINT) AS normal_count,
       round(100.0::DOUBLE * sum(label) / count(*), 6) AS anomaly_percentage,
       CASE WHEN least(avg(label), 1 - avg(label)) < 0.01 THEN 'Highly Imbalanced'
            WHEN least(avg(label), 1 - avg(label)) < 0.1 THEN 'Moderately Imbalanced'
            WHEN least(avg(label), 1 - avg(label)) < 0.4 THEN 'Slightly Imbalanced'
            ELSE 'Balanced' END AS class_imbalance,
       min(event_time) AS min_timestamp, max(event_time) AS max_timestamp,
       count(DISTINCT event_time) AS unique_timestamps FROM kpi""",
    "descriptive_stats": f"""WITH {_KPI},
a AS (UNPIVOT ({_STATISTICS.format(table="kpi_train")}) ON COLUMNS(*)
      INTO NAME statistic VALUE training),
b AS (UNPIVOT ({_STATISTICS.format(table="kpi_test")}) ON COLUMNS(*)
      INTO NAME statistic VALUE testing)
SELECT a.statistic, round(training, 6) AS training, round(testing, 6) AS testing
FROM a JOIN b ON a.statistic = b.statistic""",
    "label_distribution": f"""WITH {_KPI}
SELECT CASE label WHEN 0 THEN 'Normal' WHEN 1 THEN 'Anomaly' END AS label, count(*) AS count,
       round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percentage
FROM kpi_train GROUP BY kpi_train.label""",
    "timestamp_analysis": f"""WITH {_KPI}, both_sets AS (
  SELECT 'Training' AS dataset, event_time FROM kpi_train
  UNION ALL SELECT 'Testing', event_time FROM kpi_test)
SELECT dataset, min(event_time) AS first_ts, max(event_time) AS last_ts,
       round((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1e6, 6) AS span_seconds,
       count(DISTINCT event_time) AS unique_timestamps FROM both_sets GROUP BY dataset""",
    "quality_checks_train": f"WITH {_KPI}, " + _checks(
        "SELECT event_time, value, label, kpi_id FROM kpi_train", True),
    "quality_checks_test": f"WITH {_KPI}, " + _checks(
        "SELECT event_time, value, kpi_id FROM kpi_test", False),
    "quality_checks_lineitem": f"WITH {_LINES}, " + _checks(
        "SELECT event_time, l_quantity AS value, label, kpi_id FROM lines", True),
    "kpi_id_counts": f"""WITH {_CUSTOMERS}
SELECT 'Training' AS dataset, count(*) AS kpi_count FROM a
UNION ALL SELECT 'Test', count(*) FROM b""",
    "kpi_id_overlap": f"WITH {_CUSTOMERS} SELECT kpi_id FROM a INTERSECT SELECT kpi_id FROM b",
    "kpi_id_new": f"WITH {_CUSTOMERS} SELECT kpi_id FROM b EXCEPT SELECT kpi_id FROM a",
    "kpi_id_consistency": f"WITH {_CUSTOMERS}, n AS (SELECT kpi_id FROM b EXCEPT SELECT kpi_id FROM a)"
    " SELECT 'kpi_ids_known' AS \"check\", count(*) AS violations, count(*) = 0 AS passed FROM n",
    "kpi_record_counts": f"WITH {_KPI} SELECT kpi_id, count(*) AS records FROM kpi GROUP BY kpi_id",
    "label_counts_desc": f"""WITH {_KPI}
SELECT CASE label WHEN 0 THEN 'Normal' WHEN 1 THEN 'Anomaly' END AS category, count(*) AS records
FROM kpi_train GROUP BY label""",
    "value_histogram": f"""WITH {_KPI},
lim AS (SELECT min(value) AS lo, max(value) AS hi FROM kpi),
placed AS (SELECT least(CAST(floor((value - lo) * 50 / (hi - lo)) AS INT) + 1, 50) AS bin
           FROM kpi, lim),
counted AS (SELECT bin, count(*) AS n FROM placed GROUP BY bin)
SELECT CAST(g.i AS INT) AS bin, round(lo + (g.i - 1) * ((hi - lo) / 50), 6) AS bin_lo,
       round(lo + g.i * ((hi - lo) / 50), 6) AS bin_hi, coalesce(n, 0) AS frequency
FROM lim, (SELECT unnest(generate_series(1, 50)) AS i) g LEFT JOIN counted ON counted.bin = g.i""",
    "box_stats": f"WITH {_KPI}, {_box('kpi', False)}",
    "box_stats_by_kpi": f"WITH {_KPI}, {_box('kpi', True)}",
    "lineitem_box_stats_by_kpi": f"WITH {_LINES}, {_box('lines', True)}",
    "kpi_outliers": f"""WITH {_KPI},
q AS (SELECT kpi_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM kpi GROUP BY kpi_id)
SELECT t.kpi_id, event_id, value FROM kpi t JOIN q ON t.kpi_id = q.kpi_id
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "series_overlay": f"""WITH {_KPI}
SELECT kpi_id, CAST(date_trunc('day', event_time) AS TIMESTAMP) AS bucket, min(value) AS min,
       max(value) AS max, round(avg(value), 6) AS avg, max(label) AS flagged
FROM kpi GROUP BY 1, 2""",
    "fused_scores": f"""WITH {_SCORES}
SELECT event_id, round(kpi_score, 9) AS kpi_score, round(log_score, 9) AS log_score,
       round(score, 9) AS fused FROM fused""",
    "aligned_scores": f"""WITH {_SCORES},
a AS (SELECT kpi_id, CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS bucket,
             max(kpi_score) AS kpi_score FROM scores GROUP BY 1, 2),
b AS (SELECT kpi_id, CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS bucket,
             max(log_score) AS log_score FROM scores GROUP BY 1, 2)
SELECT kpi_id, bucket, round(kpi_score, 9) AS kpi_score, round(log_score, 9) AS log_score,
       round(kpi_score * 0.7 + log_score * 0.3, 9) AS fused FROM a JOIN b USING (kpi_id, bucket)""",
    "fused_classes": f"""WITH {_SCORES}
SELECT CASE WHEN score >= 0.5 THEN 'Anomaly' ELSE 'Normal' END AS class, count(*) AS records
FROM fused GROUP BY 1""",
    "fused_bands": f"""WITH {_SCORES}
SELECT CASE WHEN score < 0.3 THEN 'Normal' WHEN score < 0.6 THEN 'Warning'
            WHEN score < 0.8 THEN 'Anomaly' ELSE 'Potential Fault' END AS band,
       count(*) AS records FROM fused GROUP BY 1""",
    "confusion": f"""WITH {_SCORES}
SELECT y_true, y_pred, count(*) AS records FROM predictions GROUP BY 1, 2""",
    "classification_report": f"""WITH {_SCORES}, c AS (
  SELECT CAST(count(*) FILTER (y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (y_true = 0 AND y_pred = 0) AS DOUBLE) AS tn FROM predictions)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_alarm_rate FROM c""",
    "roc_auc": f"""WITH {_ROC}
SELECT round(sum(pos * (neg_upto - neg + neg / 2)) / (max(pos_total) * max(neg_total)), 6) AS auc
FROM cumulated""",
    "roc_curve": f"""WITH {_ROC}
SELECT round(score, 9) AS threshold, round((neg_total - neg_upto + neg) / neg_total, 6) AS fpr,
       round((pos_total - pos_upto + pos) / pos_total, 6) AS tpr FROM cumulated""",
    "best_threshold": f"""WITH {_ROC}, f AS (
  SELECT score, 2 * (pos_total - pos_upto + pos)
         / (pos_total - pos_upto + pos + neg_total - neg_upto + neg + pos_total) AS f1
  FROM cumulated)
SELECT round(score, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score LIMIT 1""",
    "model_comparison": f"""WITH {_SCORES},
long AS (SELECT 'fused' AS model, label AS y_true, score FROM fused
         UNION ALL SELECT 'kpi', label, kpi_score FROM fused
         UNION ALL SELECT 'log', label, log_score FROM fused),
{_AUC.format(key="model,", part="PARTITION BY model", source="long")},
auc AS (SELECT model, sum(pos * (neg_upto - neg + neg / 2)) / (max(pos_total) * max(neg_total))
               AS auc FROM cumulated GROUP BY model),
c AS (SELECT model, CAST(count(*) FILTER (y_true = 1 AND score >= 0.5) AS DOUBLE) AS tp,
             CAST(count(*) FILTER (y_true = 0 AND score >= 0.5) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (y_true = 1 AND score < 0.5) AS DOUBLE) AS fn,
             CAST(count(*) FILTER (y_true = 0 AND score < 0.5) AS DOUBLE) AS tn
      FROM long GROUP BY model)
SELECT model, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(auc, 6) AS auc
FROM c JOIN auc USING (model)""",
    "clean_series": f"""WITH {_LINES}
SELECT kpi_id, event_time, value, label FROM (
  SELECT *, row_number() OVER (PARTITION BY kpi_id, event_time ORDER BY value, label) AS r
  FROM lines) WHERE r = 1""",
    "lag_features": f"WITH {_KPI}, {_FEATURES} SELECT event_id, value, lag_1, lag_5, lag_10 FROM featured",
    "rolling_features": f"""WITH {_KPI}, {_FEATURES}
SELECT event_id, round(rolling_mean_5, 6) AS rolling_mean_5, round(rolling_std_5, 6) AS rolling_std_5,
       round(rolling_mean_10, 6) AS rolling_mean_10, round(rolling_std_10, 6) AS rolling_std_10
FROM featured""",
    "lineitem_rolling_features": f"""WITH {_LINES}, f AS (
  SELECT kpi_id, event_time, l_orderkey, l_linenumber, l_partkey, value,
         lag(value, 1) OVER w AS lag_1,
         count(value) OVER r AS n, avg(value) OVER r AS m, stddev_samp(value) OVER r AS s
  FROM lines
  WINDOW w AS (PARTITION BY kpi_id ORDER BY event_time, l_orderkey, l_linenumber, l_partkey,
               value, l_quantity),
         r AS (PARTITION BY kpi_id ORDER BY event_time, l_orderkey, l_linenumber, l_partkey,
               value, l_quantity ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT kpi_id, event_time, l_orderkey, l_linenumber, l_partkey, value, lag_1,
       CASE WHEN n = 10 THEN round(m, 4) END AS rolling_mean_10,
       CASE WHEN n = 10 THEN round(s, 4) END AS rolling_std_10 FROM f""",
    "calendar_features": f"""WITH {_KPI}
SELECT event_id, CAST(hour(event_time) AS INT) AS hour_of_day,
       CAST(isodow(event_time) - 1 AS INT) AS day_of_week FROM kpi""",
    "feature_report": f"WITH {_KPI}, {_FEATURES} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) - count({f}) AS nulls,"
        f" round(CAST(min({f}) AS DOUBLE), 6) AS min, round(CAST(max({f}) AS DOUBLE), 6) AS max"
        " FROM featured"
        for f in _FEATURE_NAMES),
    "scaled_features": f"""WITH {_KPI},
s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM kpi_train)
SELECT event_id, round((value - m) / d, 6) AS value FROM kpi_test, s""",
    "adaptive_threshold": f"""WITH {_KPI}, {_RANGE.format(k="3.0::DOUBLE")}
SELECT kpi_id, event_id, round(lower, 6) AS lower, round(upper, 6) AS upper,
       CAST(kind IS NOT NULL AS INT) AS flagged FROM tagged""",
    "level_shifts": f"""WITH RECURSIVE {_KPI},
c AS (SELECT kpi_id, quantile_cont(value, 0.5) AS centre FROM kpi GROUP BY kpi_id),
m AS (SELECT kpi_id, any_value(centre) AS centre, quantile_cont(abs(value - centre), 0.5) * 1.4826 AS spread
      FROM kpi JOIN c USING (kpi_id) GROUP BY kpi_id),
o AS (SELECT kpi_id, event_time, row_number() OVER (PARTITION BY kpi_id ORDER BY event_time, event_id) AS n,
             CASE WHEN spread > 0 THEN (value - centre) / spread ELSE sign(value - centre) * 4.0 END AS far
      FROM kpi JOIN m USING (kpi_id)),
milli AS (SELECT *, CAST(round(greatest(least(far, 4.0), -4.0) * 1000) AS BIGINT) AS far_milli FROM o),
steps AS (SELECT kpi_id, 'rise' AS direction, n, event_time, far_milli - 250 AS step FROM milli
          UNION ALL SELECT kpi_id, 'fall', n, event_time, -far_milli - 250 FROM milli),
walk AS (
  SELECT kpi_id, direction, n, event_time, greatest(0, step) AS h, CAST(step <= 0 AS BIGINT) AS zeros FROM steps WHERE n = 1
  UNION ALL
  SELECT s.kpi_id, s.direction, s.n, s.event_time, greatest(0, w.h + s.step), w.zeros + CAST(w.h + s.step <= 0 AS BIGINT)
  FROM walk w JOIN steps s ON s.kpi_id = w.kpi_id AND s.direction = w.direction AND s.n = w.n + 1),
tops AS (SELECT *, max(h) OVER e AS top, min(n) OVER e AS first, min(event_time) OVER e AS run_start FROM walk WHERE h > 0
         WINDOW e AS (PARTITION BY kpi_id, direction, zeros)),
ends AS (SELECT kpi_id, direction, run_start, min(event_time) AS run_end, min(n) - first + 1 AS run_length, top FROM tops
         WHERE h = top GROUP BY kpi_id, direction, zeros, run_start, first, top)
SELECT kpi_id, direction, run_start, run_end, run_length, round(top / 1000, 3) AS strength FROM ends
WHERE top >= 2000 AND run_length >= 2""",
    "seasonal_flags": f"""WITH {_KPI},
slots AS (SELECT *, CAST(hour(event_time) AS INTEGER) AS slot FROM kpi),
c AS (SELECT kpi_id, slot, quantile_cont(value, 0.5) AS centre, count(*) AS n FROM slots GROUP BY ALL),
m AS (SELECT kpi_id, slot, any_value(centre) AS centre, quantile_cont(abs(value - centre), 0.5) * 1.4826 AS spread
      FROM slots JOIN c USING (kpi_id, slot) WHERE n >= 3 GROUP BY ALL)
SELECT event_id, slot, round(centre - 2.0::DOUBLE * spread, 5) AS lower, round(centre + 2.0::DOUBLE * spread, 5) AS upper,
       CAST(coalesce(value < centre - 2.0::DOUBLE * spread OR value > centre + 2.0::DOUBLE * spread, false) AS INTEGER) AS flagged
FROM slots LEFT JOIN m USING (kpi_id, slot)""",
    "lineitem_vocabulary": """WITH e AS (SELECT concat('T', l_partkey) AS event, count(*) AS records FROM lineitem GROUP BY ALL HAVING count(*) >= 2)
SELECT event, CAST(row_number() OVER (ORDER BY records DESC, event) - 1 AS INTEGER) AS index, records FROM e""",
    "lineitem_sparse_occurrences": """WITH e AS (SELECT l_orderkey AS block_id, concat('T', l_partkey) AS event, count(*) AS n FROM lineitem GROUP BY ALL),
v AS (SELECT event, row_number() OVER (ORDER BY sum(n) DESC, event) - 1 AS index FROM e GROUP BY event HAVING sum(n) >= 20)
SELECT block_id, coalesce(string_agg(concat(index, ':', n), ' ' ORDER BY index) FILTER (index IS NOT NULL), '') AS pairs,
       CAST(coalesce(sum(n) FILTER (index IS NULL), 0) AS BIGINT) AS unknown
FROM e LEFT JOIN v USING (event) GROUP BY block_id""",
    "time_rolling_features": f"""WITH {_KPI}
SELECT event_id,
       round(CASE WHEN count(value) OVER a >= 2 THEN avg(value) OVER a END, 9) AS rolling_mean_3600s,
       round(CASE WHEN count(value) OVER a >= 2 THEN stddev_samp(value) OVER a END, 9) AS rolling_std_3600s,
       round(CASE WHEN count(value) OVER b >= 2 THEN avg(value) OVER b END, 9) AS rolling_mean_432000s,
       round(CASE WHEN count(value) OVER b >= 2 THEN stddev_samp(value) OVER b END, 9) AS rolling_std_432000s
FROM kpi WINDOW a AS (PARTITION BY kpi_id ORDER BY event_time RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW),
                b AS (PARTITION BY kpi_id ORDER BY event_time RANGE BETWEEN INTERVAL 432000 SECOND PRECEDING AND CURRENT ROW)""",
    "lineitem_time_rolling_features": f"""WITH {_LINES}
SELECT kpi_id, event_time, l_orderkey, l_linenumber, l_partkey, value,
       round(avg(value) OVER a, 6) AS rolling_mean_2592000s, round(stddev_samp(value) OVER a, 6) AS rolling_std_2592000s
FROM lines WINDOW a AS (PARTITION BY kpi_id ORDER BY event_time RANGE BETWEEN INTERVAL 2592000 SECOND PRECEDING AND CURRENT ROW)""",
    "hourly_forward": f"WITH {_KPI}," + _GRID.format(longest="9223372036854775807", value="v"),
    "hourly_linear": f"WITH {_KPI}," + _GRID.format(
        longest="172800000000", value="CASE WHEN tick = t THEN v ELSE v + (v2 - v) * ((tick - t) / (t2 - t)) END"),
    "nearest_errors": f"WITH {_KPI}," + _NEAREST.format(ahead="false"),
    "nearest_errors_both_sides": f"WITH {_KPI}," + _NEAREST.format(
        ahead="coalesce(epoch_us(ft) - epoch_us(event_time) < epoch_us(event_time) - epoch_us(bt), bt IS NULL)"),
    "quality_checks_dirty": f"WITH {_KPI},{_DIRTY}, c AS (SELECT 'labelled' AS dataset, * FROM ("
    + _line_checks("timestamp,value,label,KPI ID", "timestamp,value,label,KPI ID", True)
    + ") UNION ALL SELECT 'no value', * FROM ("
    + _line_checks("timestamp,label,KPI ID", "timestamp,value,KPI ID", False)
    + ")) SELECT *, violations = 0 AS passed FROM c",
    "anomaly_runs": f"""WITH {_KPI}, {_RANGE.format(k="1.0::DOUBLE")},
numbered AS (SELECT *, row_number() OVER (PARTITION BY kpi_id ORDER BY event_time, event_id)
                  - row_number() OVER (PARTITION BY kpi_id, kind ORDER BY event_time, event_id) AS g
             FROM tagged),
runs AS (SELECT kpi_id, kind, g, min(event_time) AS run_start, max(event_time) AS run_end,
                count(*) AS run_length FROM numbered WHERE kind IS NOT NULL
         GROUP BY kpi_id, kind, g)
SELECT kpi_id, run_start, run_end, run_length,
       CASE WHEN run_length >= 2 THEN concat('persistent_', kind) ELSE kind END AS kind FROM runs""",
    "event_frequencies": f"WITH {_LOGS} SELECT event, count(*) AS records FROM logs GROUP BY event",
    "occurrence_matrix": f"WITH {_LOGS} SELECT block_id, " + ", ".join(
        f"count(*) FILTER (event = '{e}') AS {e}"
        for e in ("click", "error", "purchase", "signup", "view")
    ) + " FROM logs GROUP BY block_id",
    "trace_lengths": f"WITH {_LOGS} SELECT block_id, count(*) AS trace_length FROM logs GROUP BY block_id",
    "trace_length_stats": f"""WITH {_LOGS},
t AS (SELECT block_id, count(*) AS n FROM logs GROUP BY block_id)
SELECT count(*) AS blocks, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean,
       round(quantile_cont(CAST(n AS DOUBLE), 0.25), 6) AS q1,
       round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS median,
       round(quantile_cont(CAST(n AS DOUBLE), 0.75), 6) AS q3 FROM t""",
    "log_positions": f"WITH {_WINDOWS} SELECT block_id, event_id, position, event FROM placed",
    "log_sequences": f"""WITH {_WINDOWS}
SELECT block_id, (position - 1) // 20 AS segment,
       string_agg(event, ',' ORDER BY position) AS events FROM placed GROUP BY 1, 2""",
    "log_windows": f"WITH {_WINDOWS} SELECT * FROM windows",
    "next_event_misses": f"""WITH {_WINDOWS},
counted AS (SELECT history, next_event, count(*) AS n FROM windows GROUP BY 1, 2),
likely AS (SELECT history, next_event FROM (
  SELECT *, row_number() OVER (PARTITION BY history ORDER BY n DESC, next_event) AS r FROM counted)
  WHERE r <= 2),
m AS (SELECT block_id, count(*) FILTER (l.history IS NULL) AS misses
      FROM windows w LEFT JOIN likely l ON w.history = l.history AND w.next_event = l.next_event
      GROUP BY block_id)
SELECT block_id, misses, CAST(misses > 0 AS INT) AS flagged FROM m""",
    "log_windows_null_events": f"WITH {_NULL_EVENTS} SELECT * FROM windows",
    "next_event_misses_null_events": f"""WITH {_NULL_EVENTS},
counted AS (SELECT history, next_event, count(*) AS n FROM windows GROUP BY 1, 2),
likely AS (SELECT history, next_event FROM (
  SELECT *, row_number() OVER (PARTITION BY history ORDER BY n DESC, next_event NULLS FIRST) AS r FROM counted)
  WHERE r <= 2),
m AS (SELECT block_id, count(*) FILTER (l.history IS NULL) AS misses
      FROM windows w LEFT JOIN likely l ON w.history = l.history AND w.next_event IS NOT DISTINCT FROM l.next_event
      GROUP BY block_id)
SELECT block_id, misses, CAST(misses > 0 AS INT) AS flagged FROM m""",
    "event_contexts": f"""WITH {_CONTEXTS}
SELECT CAST(length AS INT) AS length, context, array_to_string(likely, ',') AS likely FROM likely""",
    "backed_off_misses": f"""WITH {_CONTEXTS},
best AS (SELECT block_id, event_id, e, whole, length, likely, row_number() OVER
           (PARTITION BY block_id, event_id ORDER BY CASE WHEN likely IS NULL THEN -1 ELSE length END DESC) AS r
         FROM ends LEFT JOIN likely USING (length, context)),
m AS (SELECT block_id,
             count(*) FILTER (likely IS NULL OR NOT list_contains(likely, '{{"next_event":' || e || '}}')) AS misses,
             count(*) FILTER (likely IS NULL OR length < whole) AS backed_off
      FROM best WHERE r = 1 GROUP BY block_id)
SELECT block_id, misses, backed_off, CAST(misses > 0 AS INT) AS flagged FROM m""",
    "given_forest_scores": f"""WITH RECURSIVE {_KPI},
nodes(tree, node, feature, cut, l, r, path) AS (VALUES {", ".join(map(str, GIVEN_NODES))}),
points AS (SELECT event_id, CAST(value AS DOUBLE) AS value, hour(event_time) AS hour FROM kpi),
walk AS (
  SELECT event_id, value, hour, tree, node FROM points, (SELECT DISTINCT tree, 0 AS node FROM nodes)
  UNION ALL
  SELECT event_id, value, hour, w.tree,
         CASE WHEN (CASE feature WHEN 0 THEN coalesce(value, 0) ELSE hour END) <= cut THEN l ELSE r END
  FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node AND feature >= 0),
depth AS (SELECT event_id, avg(CAST(path AS DOUBLE)) AS depth
          FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node AND feature < 0 GROUP BY event_id),
scored AS (SELECT event_id, pow(2.0, -depth / (2 * (ln({GIVEN_SAMPLE} - 1) + 0.5772156649015329)
                                               - 2.0 * {GIVEN_SAMPLE - 1} / {GIVEN_SAMPLE})) AS score FROM depth)
SELECT event_id, round(score, 9) AS score, CAST(score >= 0.6 AS INT) AS prediction FROM scored""",
    "sketch_accuracy": f"""WITH {_KPI}
SELECT kpi_id, count(DISTINCT CAST(event_time AS DATE)) AS days, CAST(count(*) AS BIGINT) AS n,
       count(*) FILTER (value IS NULL) AS missing, min(value) AS minimum, max(value) AS maximum,
       true AS distinct_near, true AS median_near, true AS q90_near
FROM kpi GROUP BY kpi_id""",
    "log_label_distribution": f"""WITH {_MATRIX_LABEL}
SELECT CASE label WHEN 0 THEN 'Normal' WHEN 1 THEN 'Anomaly' END AS label, count(*) AS count,
       round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percentage
FROM labelled GROUP BY labelled.label""",
    "log_quality_checks": f"""WITH {_MATRIX_LABEL},
c AS (
  SELECT 'label_block_present' AS "check", count(*) FILTER (block_id IS NULL) AS violations
    FROM labelled
  UNION ALL SELECT 'label_block_unique', count(*) - count(DISTINCT block_id) FROM labelled
  UNION ALL SELECT 'label_present', count(*) FILTER (label IS NULL) FROM labelled
  UNION ALL SELECT 'label_values', count(*) FILTER (label NOT IN (0, 1)) FROM labelled
  UNION ALL SELECT 'event_block_present', count(*) FILTER (block_id IS NULL) FROM logs
  UNION ALL SELECT 'event_present', count(*) FILTER (event IS NULL) FROM logs
  UNION ALL SELECT 'event_block_labelled', count(DISTINCT block_id) FROM logs
            WHERE block_id NOT IN (SELECT block_id FROM labelled))
SELECT *, violations = 0 AS passed FROM c""",
}

# The same tables from plans that cut every key into short slices.
CUT = (
    "lag_features", "rolling_features", "adaptive_threshold", "anomaly_runs", "box_stats",
    "box_stats_by_kpi", "descriptive_stats", "roc_auc", "roc_curve", "log_positions", "log_windows",
    "nearest_errors", "nearest_errors_both_sides", "level_shifts", "time_rolling_features",
    "hourly_forward", "hourly_linear", "lineitem_vocabulary",
)
ORACLES |= {f"{name}_cut": ORACLES[name] for name in CUT}
