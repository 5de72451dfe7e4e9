"""Data-quality checks and KPI-ID comparison.

All row-level checks of a table run in one job: the rows are first counted by content, which finds
the duplicates, and every other violation is then summed over the distinct rows with their counts.
Copies collapse map-side, so a row repeated in a third of the table is no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.kpi import (
    KPI_ID,
    LABELLED_COLUMNS,
    MALFORMED,
    UNLABELLED_COLUMNS,
    instant,
    number,
    whole_number,
)

TRAINING = "Training"
TEST = "Test"
# Checks that only warn, by default none.
WARNINGS_ONLY: tuple[str, ...] = ()


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("_copies"))), F.lit(0)).cast("bigint")


def _wrong_type(df: DataFrame, column: str, labelled: bool) -> Column:
    """True where a present field does not have the type its column stands for."""
    present = F.col(f"`{column}`").isNotNull()
    if column == "value":
        return present & number(df, column).isNull() & (
            F.lower(F.trim(F.col(f"`{column}`").cast("string"))) != "nan"
        )
    if column == "label" and labelled:
        return present & whole_number(df, column).isNull()
    if column == "timestamp":
        return present & instant(df, column).isNull()
    return F.lit(False)


def _missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def quality_checks(df: DataFrame, labelled: bool) -> DataFrame:
    """One row per check: ``check, violations, passed``. A table read from text (with the column
    ``MALFORMED``) has one check more: rows with too many or too few fields."""
    required = LABELLED_COLUMNS if labelled else UNLABELLED_COLUMNS
    absent = [c for c in required if c not in df.columns]
    there = [c for c in required if c in df.columns]
    distinct_rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(
        F.count(F.lit(1)).alias("_copies")
    )

    nothing = F.lit(0).cast("bigint")
    checks: dict[str, Column] = {"required_columns": F.lit(len(absent)).cast("bigint")}
    checks["data_types"] = sum((_count(_wrong_type(df, c, labelled)) for c in there), nothing)
    checks["missing_values"] = sum((_count(_missing(df, c)) for c in there), nothing)
    checks["duplicate_rows"] = F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint")
    if labelled:
        checks["label_values"] = (
            _count(F.col("label").isNotNull() & ~F.coalesce(
                whole_number(df, "label").isin(0, 1), F.lit(False)))
            if "label" in df.columns else nothing
        )
    checks["kpi_id_present"] = (
        _count(F.col(f"`{KPI_ID}`").isNull()) if KPI_ID in df.columns else nothing
    )
    checks["timestamp_valid"] = (
        _count(instant(df, "timestamp").isNull()) if "timestamp" in df.columns else nothing
    )
    if MALFORMED in df.columns:
        checks["row_shape"] = _count(F.col(MALFORMED).isNotNull())
    counted = distinct_rows.agg(*[c.alias(name) for name, c in checks.items()])
    return counted.unpivot([], list(checks), "check", "violations").withColumn(
        "passed", F.col("violations") == 0
    )


@dataclass(frozen=True)
class ValidationResult:
    dataset_type: str
    is_valid: bool
    passed_checks: int
    total_checks: int
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    timestamp: str = ""

    def summary(self) -> str:
        state = "VALID" if self.is_valid else "INVALID"
        return (
            f"{self.dataset_type} Validation: {state} "
            f"({self.passed_checks}/{self.total_checks} checks passed)"
        )


def validate(
    df: DataFrame, labelled: bool, warnings_only: Sequence[str] = WARNINGS_ONLY
) -> ValidationResult:
    """Runs the checks of a table with the file columns (text or typed)."""
    rows = [r.asDict() for r in quality_checks(df, labelled).collect()]
    failed = [r for r in rows if not r["passed"]]
    texts = {r["check"]: f"{r['check']}: {r['violations']} violation(s)" for r in failed}
    required = LABELLED_COLUMNS if labelled else UNLABELLED_COLUMNS
    absent = [c for c in required if c not in df.columns]
    if absent:
        texts["required_columns"] = f"required_columns: missing {', '.join(absent)}"
    errors = [t for check, t in texts.items() if check not in warnings_only]
    return ValidationResult(
        dataset_type=TRAINING if labelled else TEST,
        is_valid=not errors,
        passed_checks=len(rows) - len(failed),
        total_checks=len(rows),
        errors=errors,
        warnings=[t for check, t in texts.items() if check in warnings_only],
        checks=rows,
        timestamp=datetime.now(timezone.utc).isoformat(),
    )


def kpi_ids(df: DataFrame, column: str = "kpi_id") -> DataFrame:
    """Distinct KPI IDs; none for a table without the column."""
    if column not in df.columns:
        return df.sparkSession.range(0).select(F.col("id").cast("string").alias("kpi_id"))
    name = f"`{column}`"
    return df.where(F.col(name).isNotNull()).select(F.col(name).alias("kpi_id")).distinct()


def kpi_id_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """KPI IDs of both tables."""
    return kpi_ids(train).join(kpi_ids(test), "kpi_id", "left_semi").orderBy("kpi_id")


def kpi_id_new(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test KPI IDs that training has not seen."""
    return kpi_ids(test).join(kpi_ids(train), "kpi_id", "left_anti").orderBy("kpi_id")


def kpi_id_consistency(train: DataFrame, test: DataFrame) -> DataFrame:
    """The check across both tables, in the form of ``quality_checks``: test KPI IDs that training
    has not seen are its violations."""
    unseen = kpi_ids(test).join(kpi_ids(train), "kpi_id", "left_anti")
    return unseen.agg(
        F.lit("kpi_ids_known").alias("check"), F.count(F.lit(1)).alias("violations")
    ).withColumn("passed", F.col("violations") == 0)


def kpi_id_counts(train: DataFrame, test: DataFrame) -> DataFrame:
    def counted(df: DataFrame, name: str) -> DataFrame:
        return kpi_ids(df).agg(
            F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("kpi_count")
        )

    return counted(train, TRAINING).unionByName(counted(test, TEST))


def compare_kpi_ids(
    train: DataFrame, test: DataFrame, column: str = KPI_ID, lists: bool = False
) -> dict:
    """Counts and tables (``*_df``) of the KPI IDs of each table, of both, and new in the test table.

    With ``lists`` the sorted IDs come along as complete lists, whatever their number; that is for
    tables known to be small.
    """
    a, b = kpi_ids(train, column), kpi_ids(test, column)
    frames = {
        "train": a.orderBy("kpi_id"),
        "test": b.orderBy("kpi_id"),
        "overlap": kpi_id_overlap(a, b),
        "new": kpi_id_new(a, b),
    }
    result: dict = {}
    for name, frame in frames.items():
        result[f"{name}_kpi_count"] = frame.count()
        result[f"{name}_df"] = frame
        if lists:
            result[f"{name}_kpi_ids"] = [r["kpi_id"] for r in frame.collect()]
    return result


def render_report(train: ValidationResult, test: ValidationResult, ids: dict) -> str:
    """The validation report as text. IDs are in the tables it names, of any length."""
    # Title, section heads and status words of the report layout.
    rule, line = "=" * 70, "-" * 70
    out = [rule, "KPI DATASET VALIDATION REPORT", rule, ""]
    for title, result in (("TRAINING", train), ("TEST", test)):
        out += [f"{title} DATASET VALIDATION", line, f"Timestamp: {result.timestamp}"]
        out += [f"Status: {'VALID' if result.is_valid else 'INVALID'}"]
        out += [f"Checks Passed: {result.passed_checks}/{result.total_checks}"]
        out += [f"ERROR: {e}" for e in result.errors]
        out += [f"WARNING: {w}" for w in result.warnings]
        out += ["", ""]
    out += ["KPI ID ANALYSIS", rule, ""]
    for name, title, note in (
        ("train", "TRAINING KPI IDs", "unique"),
        ("test", "TEST KPI IDs", "unique"),
        ("overlap", "OVERLAP KPI IDs", "present in both"),
    ):
        out += [f"{title} ({ids[f'{name}_kpi_count']} {note}):", f"  table kpi_ids_{name}", ""]
    if ids["new_kpi_count"]:
        out += [f"WARNING - {ids['new_kpi_count']} test KPI IDs are not in the training set"]
        out += ["  table kpi_ids_new"]
    else:
        out += ["OK - All test KPI IDs are present in the training set (no new KPI IDs)"]
    out += ["", rule, "END OF REPORT", rule]
    return "\n".join(out) + "\n"


def write_validation_report(
    spark, train: ValidationResult, test: ValidationResult, ids: dict, path: str
) -> None:
    """Writes the text report through the Hadoop file system the path belongs to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(str(path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(target, True)
    try:
        stream.write(render_report(train, test, ids).encode("utf-8"))
    finally:
        stream.close()
