"""Tables that are computed once, in the folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs: ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary folder; executors of a cluster could not share one, so it is an error
    there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stage-"))
    return context._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder: later readers see the same rows, and
    lost executors do not lose them. The shuffle files behind it are removed at once."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query made under this setting
    finally:
        spark.conf.set(_CLEANUP, before)
