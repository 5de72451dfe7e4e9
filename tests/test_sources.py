"""Loading: CSV scans, typing, missing files, staging-independent errors, log files."""

import datetime

import pytest

from pyspark.sql import functions as F

from faultloom.operators import quality
from faultloom.sources import (
    LABELLED_COLUMNS,
    MALFORMED,
    load_both,
    load_logs,
    load_test,
    load_train,
    parse_lines,
    paths_exist,
    to_series,
    write_report,
    write_table,
)

TRAIN = """timestamp,value,label,KPI ID
2019-07-04 06:30:00,-3.25,0,disk
2019-07-04 06:35:00,41.0,1,disk
"""
TEST = """timestamp,value,KPI ID
2019-09-09 23:55:00,0.5,disk
2019-09-10 00:00:00,7.75,fan
"""


@pytest.fixture
def data(tmp_path):
    (tmp_path / "train.csv").write_text(TRAIN)
    (tmp_path / "test.csv").write_text(TEST)
    return str(tmp_path)


def test_train_keeps_columns_and_types(spark, data):
    df = load_train(spark, data)
    assert df.columns == ["timestamp", "value", "label", "KPI ID"]
    assert dict(df.dtypes) == {
        "timestamp": "string", "value": "double", "label": "int", "KPI ID": "string"
    }
    assert [tuple(r) for r in df.collect()] == [
        ("2019-07-04 06:30:00", -3.25, 0, "disk"), ("2019-07-04 06:35:00", 41.0, 1, "disk")
    ]


def test_test_table_has_no_label(spark, data):
    df = load_test(spark, data)
    assert df.columns == ["timestamp", "value", "KPI ID"] and df.count() == 2


def test_both_without_errors(spark, data):
    result = load_both(spark, data)
    assert result.errors == []
    assert result.train_df.count() == 2 and result.test_df.count() == 2


@pytest.mark.parametrize("lines_only", [False, True])
def test_rows_with_too_many_or_too_few_fields(spark, tmp_path, lines_only):
    lines = ["2021-01-01 01:00:00,2,5,1,b", "2021-01-01 02:00:00,3", "", "2021-01-01 03:00:00,4,1,k", "2021-01-01 03:00:00,4,1,k,",
             '2021-01-01 04:00:00,"5,0",0,k']
    (tmp_path / "train.csv").write_text("\n".join(["timestamp,value,label,KPI ID", *lines]) + "\n")
    if lines_only:
        text = parse_lines(spark.createDataFrame([(x,) for x in lines if x], "value string"), LABELLED_COLUMNS)
    else:
        text = load_train(spark, str(tmp_path), as_text=True)
    bad = [lines[0], lines[1], lines[4]]
    assert text.columns == [*LABELLED_COLUMNS, MALFORMED]
    assert sorted(r[0] for r in text.where(F.col(MALFORMED).isNotNull()).select(MALFORMED).collect()) == sorted(bad)
    assert text.where(F.col(MALFORMED).isNotNull()).count() == 3  # also where no field is asked for
    assert [r["value"] for r in text.where(F.col(MALFORMED).isNull()).select("value").collect()] == ["4", "5,0"]
    checks = {r["check"]: r["violations"] for r in quality.quality_checks(text, labelled=True).collect()}
    assert checks == {"required_columns": 0, "data_types": 1, "missing_values": 2, "duplicate_rows": 0,
                      "label_values": 1, "kpi_id_present": 1, "timestamp_valid": 0, "row_shape": 3}
    if not lines_only:
        assert load_train(spark, str(tmp_path)).count() == 5
        assert load_train(spark, str(tmp_path), malformed="drop").count() == 2
        assert load_train(spark, str(tmp_path), malformed="drop").columns == list(LABELLED_COLUMNS)
        with pytest.raises(ValueError):
            load_train(spark, str(tmp_path), malformed="mend")


def test_missing_files(spark, tmp_path):
    for load in (load_train, load_test):
        with pytest.raises(FileNotFoundError):
            load(spark, "/nonexistent/path")
    assert not paths_exist(spark, "/nonexistent/path")
    (tmp_path / "train.csv").write_text(TRAIN)
    (tmp_path / "test.csv").write_text("timestamp,value,KPI ID\n")
    assert paths_exist(spark, str(tmp_path))
    result = load_both(spark, str(tmp_path))
    assert result.train_df is not None and result.test_df is None
    assert len(result.errors) == 1 and "no rows" in result.errors[0]


def test_epochs_isos_and_bad_fields(spark, tmp_path):
    (tmp_path / "train.csv").write_text(
        "timestamp,value,label,KPI ID\n"
        "1467302400,1.5,1,02e99bd4f6cfb33f\n"
        "2016-06-30T16:00:00,NaN,0.0,046\n"
        "yesterday,abc,2.5,N/A\n"
    )
    rows = to_series(load_train(spark, str(tmp_path))).collect()
    at = datetime.datetime(2016, 6, 30, 16)
    assert [tuple(r) for r in rows] == [
        ("02e99bd4f6cfb33f", at, 1.5, 1), ("046", at, None, 0), (None, None, None, None)
    ]


@pytest.mark.parametrize("rows", [3, 10])
def test_the_form_of_a_report_does_not_depend_on_its_size(spark, tmp_path, rows):
    table = spark.range(rows).repartition(3)
    write_table(table, str(tmp_path), "parts", ["id"])
    write_table(table, str(tmp_path), "one", ["id"], single_file=True)
    write_report(table.orderBy("id"), str(tmp_path), "few")
    assert (tmp_path / "parts.csv").is_dir()
    assert spark.read.option("header", True).csv(str(tmp_path / "parts.csv")).count() == rows
    for name in ("one", "few"):
        assert (tmp_path / f"{name}.csv").read_text().split() == ["id", *map(str, range(rows))]


def test_numbers_and_dates_as_times(spark):
    from faultloom.sources.kpi import instant

    rows = [("20210102",), ("1609545600",), ("1609545600000",), ("2021-01-02",), ("00000001",), ("x",)]
    df = spark.createDataFrame(rows, "timestamp string")
    got = [r[0] for r in df.select(instant(df, "timestamp")).collect()]
    day = datetime.datetime(2021, 1, 2)
    assert got == [day, day, day, day, datetime.datetime(1970, 1, 1, 0, 0, 1), None]


def test_log_files(spark, tmp_path):
    (tmp_path / "anomaly_label.csv").write_text("BlockId,Label\nb1,Normal\nb2,Anomaly\n")
    (tmp_path / "Event_occurrence_matrix.csv").write_text(
        "BlockId,Label,E1,E2\nb1,Success,2,0\nb2,Fail,1,x\n")
    (tmp_path / "Event_traces.csv").write_text(
        'BlockId,Label,Features\nb1,Success,"[E1,E1]"\nb2,Fail,"[E1]"\nb3,Fail,[]\n')
    (tmp_path / "HDFS.log_templates.csv").write_text("EventId,EventTemplate\nE1,opened <*>\n")
    tables = load_logs(spark, str(tmp_path))
    assert [tuple(r) for r in tables.labels.collect()] == [("b1", "Normal"), ("b2", "Anomaly")]
    assert [tuple(r) for r in tables.occurrences.collect()] == [
        ("b1", "Success", 2, 0), ("b2", "Fail", 1, None)]
    assert [tuple(r) for r in tables.traces.collect()] == [
        ("b1", ["E1", "E1"]), ("b2", ["E1"]), ("b3", [])]
    assert tables.templates.columns == ["event_id", "template"]
