"""KPI tables: CSV scans, typing and the internal series form.

CSV columns are read as text and typed by a projection, so a bad field becomes NULL (and a counted
violation in ``operators.quality``) instead of aborting a job over many files. A row with more or
fewer fields than the header keeps its whole text in the column ``MALFORMED``, so nothing of it is
lost and the quality checks count it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null

KPI_ID = "KPI ID"
LABELLED_COLUMNS = ("timestamp", "value", "label", KPI_ID)
UNLABELLED_COLUMNS = ("timestamp", "value", KPI_ID)
KPI_COLUMNS = ("kpi_id", "event_time", "value", "label")
# The text of a row whose number of fields is not that of the header, NULL for all other rows.
MALFORMED = "_malformed"

# Texts that stand for a missing field in the CSV files.
MISSING_TEXTS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Limits of what a bare number means as a time: the year 5138 in seconds, and the first year of a
# date without separators.
MOST_SECONDS = 1e11
FIRST_YEAR = 1900


class LoadResult(NamedTuple):
    train_df: DataFrame | None
    test_df: DataFrame | None
    errors: list[str]


def _path(directory: str, name: str) -> str:
    return f"{str(directory).rstrip('/')}/{name}"


def _text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in (*columns, MALFORMED)])


def _blank_to_null(raw: DataFrame) -> DataFrame:
    """Texts that stand for a missing field as NULL, in all columns but ``MALFORMED``.

    The reader tells malformed rows only where all fields are read; the condition, always true, has
    a query on ``MALFORMED`` alone read them."""
    fields = [c for c in raw.columns if c != MALFORMED]
    read = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in fields])) >= 0
    return raw.select(
        *[
            F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c)
            for c in fields
        ],
        F.when(read, F.col(MALFORMED)).alias(MALFORMED),
    )


def _scan(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    try:
        header = reader.csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    marked = reader.schema(_text_schema(header)).option("columnNameOfCorruptRecord", MALFORMED)
    return _blank_to_null(marked.csv(path))


def parse_lines(lines: DataFrame, columns: Sequence[str], line: str = "value") -> DataFrame:
    """The text form of a KPI table that arrives as lines without a header (a text table, a queue):
    ``columns`` and ``MALFORMED``, exactly as a file with these lines is read."""
    schema = ", ".join(f"`{c}` string" for c in (*columns, MALFORMED))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    return _blank_to_null(lines.select(F.from_csv(F.col(line), schema, options).alias("_row")).select("_row.*"))


def _loaded(raw: DataFrame, as_text: bool, malformed: str) -> DataFrame:
    if malformed not in ("keep", "drop"):
        raise ValueError(f"malformed must be keep or drop, not {malformed!r}")
    if malformed == "drop":
        raw = raw.where(F.col(MALFORMED).isNull())
    return raw if as_text else typed(raw.drop(MALFORMED))


def load_train(
    spark: SparkSession, directory: str, as_text: bool = False, malformed: str = "keep"
) -> DataFrame:
    """``train.csv`` of a directory, in file column order. ``as_text`` skips the typing and adds
    ``MALFORMED``, which is what the quality checks want. ``malformed``: ``keep`` rows with more or
    fewer fields than the header (as far as their fields go) or ``drop`` them."""
    return _loaded(_scan(spark, _path(directory, "train.csv")), as_text, malformed)


def load_test(
    spark: SparkSession, directory: str, as_text: bool = False, malformed: str = "keep"
) -> DataFrame:
    return _loaded(_scan(spark, _path(directory, "test.csv")), as_text, malformed)


def load_both(spark: SparkSession, directory: str, as_text: bool = False) -> LoadResult:
    """Both tables; a table that cannot be read or is empty is reported in ``errors``."""
    errors: list[str] = []
    tables: list[DataFrame | None] = []
    for name, load in (("training", load_train), ("test", load_test)):
        try:
            table = load(spark, directory, as_text)
            if table.isEmpty():
                raise ValueError("the dataset has no rows")
            tables.append(table)
        except (FileNotFoundError, ValueError, AnalysisException) as error:
            errors.append(f"{name} data: {error}")
            tables.append(None)
    return LoadResult(tables[0], tables[1], errors)


def paths_exist(spark: SparkSession, directory: str) -> bool:
    for name in ("train.csv", "test.csv"):
        try:
            spark.read.text(_path(directory, name))
        except AnalysisException:
            return False
    return True


def number(df: DataFrame, column: str) -> Column:
    """``column`` as a double, NULL for NaN and for text that is no number."""
    return nan_to_null(F.col(f"`{column}`").try_cast("double"))


def whole_number(df: DataFrame, column: str) -> Column:
    """``column`` as an int, NULL unless it is a whole number (``1`` and ``1.0`` are)."""
    as_double = number(df, column)
    return F.when(as_double == F.floor(as_double), as_double.try_cast("int"))


def instant(df: DataFrame, column: str) -> Column:
    """Epoch seconds or milliseconds (numeric or text) and ISO texts as timestamps.

    A text of eight digits that reads as a date from ``FIRST_YEAR`` on is one (``20210102``);
    numbers beyond ``MOST_SECONDS`` are milliseconds."""
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(kind, T.DateType):
        return c.cast("timestamp")
    n = number(df, column)
    epoch = F.timestamp_seconds(F.when(F.abs(n) > MOST_SECONDS, n / 1000).otherwise(n))
    if isinstance(kind, T.StringType):
        text = F.trim(c)
        day = F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        day = F.when(F.year(day) >= FIRST_YEAR, day)
        return F.coalesce(day, epoch, F.try_to_timestamp(c))
    return epoch


def typed(raw: DataFrame) -> DataFrame:
    """File columns with their types; the timestamp keeps its text, ``to_series`` parses it."""
    casts = {
        "value": lambda: number(raw, "value"),
        "label": lambda: whole_number(raw, "label"),
        KPI_ID: lambda: F.col(f"`{KPI_ID}`").cast("string"),
    }
    return raw.select(
        *[(casts[c]() if c in casts else F.col(f"`{c}`")).alias(c) for c in raw.columns]
    )


def to_series(df: DataFrame) -> DataFrame:
    """Internal form ``kpi_id, event_time, value[, label]`` of a table with the file columns."""
    columns = [
        F.col(f"`{KPI_ID}`").cast("string").alias("kpi_id"),
        instant(df, "timestamp").alias("event_time"),
        number(df, "value").alias("value"),
    ]
    if "label" in df.columns:
        columns.append(whole_number(df, "label").alias("label"))
    return df.select(*columns)
