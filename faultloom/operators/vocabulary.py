"""Open vocabularies: event types found in the data, and blocks as sparse count vectors.

``logs.occurrence_matrix`` has a column per event type of a given list. Here the types are numbered
by a distributed rank, and a block is two short arrays, whatever the number of types.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import attach
from .logs import BLOCK, event_frequencies
from .slices import ROWS_PER_SLICE, running_totals
from .staging import shared_folder, staged


def event_vocabulary(
    events: DataFrame, least: int = 1, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``event, index, records``: the event types of at least ``least`` records, numbered from 0 by
    falling frequency, then by name. NULL events have no number."""
    counted = event_frequencies(events).where(F.col("event").isNotNull() & (F.col("records") >= least))
    ordered = counted.withColumn("_less", -F.col("records"))
    one = {"_n": F.lit(1).cast("bigint")}
    placed = running_totals(staged(ordered), [], ["_less", "event"], one, rows_per_slice)
    return placed.select("event", (F.col("_n_upto") - 1).cast("int").alias("index"), "records")


def sparse_occurrences(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``block_id, indices, counts, unknown``: how often each event type of ``vocabulary`` occurs in
    a block, by rising number, and how many events are of no type of it (or NULL).

    Events are counted by block and type first (map-side), so a block has at most one row per type
    where its arrays are made."""
    counted = events.groupBy(BLOCK, "event").agg(F.count(F.lit(1)).alias("_n"))
    numbered = attach(
        counted, vocabulary.select("event", "index"), ["event"], [BLOCK], how="left", count_keys=False
    )
    pair = F.when(F.col("index").isNotNull(), F.struct("index", F.col("_n").cast("double").alias("n")))
    blocks = numbered.groupBy(BLOCK).agg(
        F.array_sort(F.collect_list(pair)).alias("_pairs"),
        F.sum(F.when(F.col("index").isNull(), F.col("_n")).otherwise(0)).alias("unknown"),
    )
    return blocks.select(
        BLOCK,
        F.transform("_pairs", lambda p: p["index"]).alias("indices"),
        F.transform("_pairs", lambda p: p["n"]).alias("counts"),
        "unknown",
    )


def with_vectors(sparse: DataFrame, size: int, column: str = "features") -> DataFrame:
    """Adds the sparse ``pyspark.ml`` vector of ``indices`` and ``counts``.

    No built-in function makes sparse vectors. Their stored form is a struct, so the table is
    written as Parquet to the shared folder and read back with the vector type, which keeps the
    rows out of Python; trainers read them many times anyway."""
    from pyspark.ml.linalg import VectorUDT

    spark = sparse.sparkSession
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
        F.col("indices"), F.col("counts").alias("values"),
    )
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    sparse.withColumn(column, stored).write.parquet(path)
    schema = T.StructType([*sparse.schema.fields, T.StructField(column, VectorUDT())])
    return spark.read.schema(schema).parquet(path)
