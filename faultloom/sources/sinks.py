"""Report sinks. Every report is computed once. Reports of a few rows become one file with the
report's name; reports with a row per KPI are a directory of part files unless one file is asked
for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def _hadoop(df: DataFrame):
    spark = df.sparkSession
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def _promote(df: DataFrame, directory: str, name: str, fmt: str) -> None:
    """Writes one part file and gives it its report name, on any Hadoop file system."""
    base = str(directory).rstrip("/")
    staging = f"{base}/_{name}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(staging)

    files, conf = _hadoop(df)
    target = files.Path(f"{base}/{name}")
    fs = target.getFileSystem(conf)
    part = fs.globStatus(files.Path(f"{staging}/part-*"))[0].getPath()
    fs.delete(target, True)
    fs.rename(part, target)
    fs.delete(files.Path(staging), True)


def write_report(df: DataFrame, directory: str, name: str) -> None:
    """A report of a few rows as ``directory/name.csv``."""
    _promote(df, directory, f"{name}.csv", "csv")


def write_table(
    df: DataFrame, directory: str, name: str, order: Sequence[str], single_file: bool = False
) -> None:
    """A report with any number of rows, sorted by ``order``: a directory of part files
    ``directory/name.csv``, or, if the caller asks for it, one file of that name. The form never
    depends on the number of rows."""
    if single_file:
        _promote(df.orderBy(*order), directory, f"{name}.csv", "csv")
    else:
        target = f"{str(directory).rstrip('/')}/{name}.csv"
        df.orderBy(*order).write.mode("overwrite").option("header", True).csv(target)


def write_json_object(df: DataFrame, directory: str, name: str) -> None:
    """A one-row DataFrame as ``directory/name.json``."""
    _promote(df, directory, f"{name}.json", "json")
