"""Bounded, reproducible samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import staged


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo the number of folds; a missing identifier counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, id_col: str = "doc_id",
           text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, y, t) of at most per_class rows of each label that satisfy `train`, and the counts of all of them.

    Rows are taken in the order of a hash of the identifier, so the sample does not depend on partitions. An
    identifier with several labels counts with the smallest; labels other than 0 and 1 are ignored. Of rows that
    share an identifier one is taken, by a hash of the text; copies fold before they are shuffled.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y"))
    rows = docs.where(train).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    ids = staged(rows.select("id").join(known, "id"))
    counts = {int(r["y"]): int(r["count"]) for r in ids.groupBy("y").count().collect()}
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [ids.where(F.col("y") == y).dropDuplicates(["id"]).orderBy(*order).limit(per_class) for y in (0, 1)]
    found = rows.join(F.broadcast(chosen[0].union(chosen[1])), "id")
    one = found.groupBy("id").agg(F.min("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t"))
    return one.select("id", "y", "t"), counts
