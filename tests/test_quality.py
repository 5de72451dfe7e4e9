import pytest

from faultloom.operators import quality
from faultloom.plans.analysis import run_analysis

SCHEMA = "timestamp string, value double, label int, `KPI ID` string"
TRAIN = [("2021-01-01 00:00:00", 100.5, 0, "KPI-1"), ("2021-01-01 01:00:00", 102.3, 1, "KPI-1")]
TEST = [("2021-02-01 00:00:00", 105.0, "KPI-1"), ("2021-02-01 01:00:00", 103.2, "KPI-2")]


@pytest.fixture
def train(spark):
    return spark.createDataFrame(TRAIN, SCHEMA)


@pytest.fixture
def test(spark):
    return spark.createDataFrame(TEST, SCHEMA.replace("label int, ", ""))


def test_valid_tables(train, test):
    a, b = quality.validate(train, True), quality.validate(test, False)
    assert (a.dataset_type, a.is_valid, a.passed_checks, a.total_checks) == ("Training", True, 7, 7)
    assert (b.dataset_type, b.is_valid, b.passed_checks, b.total_checks) == ("Test", True, 6, 6)
    assert "Validation" in a.summary() and "checks passed" in a.summary()


def test_missing_column(train):
    result = quality.validate(train.drop("label"), True)
    assert not result.is_valid and "label" in result.errors[0]
    result = quality.validate(train.drop("KPI ID"), True)
    assert not result.is_valid


def test_every_violation_is_counted(spark):
    rows = [
        ("1", "1.0", "0", "a"), ("1", "1.0", "0", "a"), ("1", "1.0", "0", "a"),
        ("soon", "x", "7", None), (None, None, "y", "b"), ("2", "NaN", "1", "b"),
    ]
    df = spark.createDataFrame(
        rows, "timestamp string, value string, label string, `KPI ID` string")
    found = {r["check"]: r["violations"] for r in quality.quality_checks(df, True).collect()}
    assert found == {
        "required_columns": 0,
        "data_types": 3,
        "missing_values": 3,
        "duplicate_rows": 2,
        "label_values": 2,
        "kpi_id_present": 1,
        "timestamp_valid": 2,
    }
    lenient = quality.validate(df, True, warnings_only=tuple(found))
    assert lenient.is_valid and len(lenient.warnings) == 6


def test_empty_table_has_no_violations(spark, train):
    assert quality.validate(train.limit(0), True).is_valid


def test_kpi_id_comparison(spark, train, test):
    ids = quality.compare_kpi_ids(train, test, lists=True)
    assert ids["train_kpi_ids"] == ["KPI-1"] and ids["train_kpi_count"] == 1
    assert ids["test_kpi_ids"] == ["KPI-1", "KPI-2"] and ids["test_kpi_count"] == 2
    assert ids["overlap_kpi_ids"] == ["KPI-1"] and ids["new_kpi_ids"] == ["KPI-2"]
    plain = quality.compare_kpi_ids(train, test)
    assert "test_kpi_ids" not in plain and plain["test_kpi_count"] == 2
    assert [r[0] for r in plain["test_df"].collect()] == ["KPI-1", "KPI-2"]


def test_report_text(spark, train, test, tmp_path):
    path = tmp_path / "validation_report.txt"
    quality.write_validation_report(
        spark, quality.validate(train, True), quality.validate(test, False),
        quality.compare_kpi_ids(train, test), str(path),
    )
    text = path.read_text()
    for part in ("VALIDATION REPORT", "TRAINING", "TEST", "Checks Passed: 7/7", "table kpi_ids_new"):
        assert part in text
    assert "1 test KPI IDs are not in the training set" in text


def test_invalid_data_still_gets_a_validation_report(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    (data / "train.csv").write_text("timestamp,value,label\n2021-01-01,1,0\n")
    (data / "test.csv").write_text("timestamp,value,KPI ID\n2021-01-01,1,a\n")
    assert run_analysis(spark, str(data), str(out)) is False
    assert "INVALID" in (out / "validation_report.txt").read_text()
    assert not (out / "dataset_summary.csv").exists()
