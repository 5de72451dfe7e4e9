"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition sorts its digests into a run. In each round, groups of neighbouring runs send their
entries to one task per digest range, which merges them in order; rounds go on until one run is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import partitions, ship, staged

KEY = ("text_sha256", "text_chars", "text_check")
ENTRY = ("run", *KEY, "keep_id", "group_size")


def with_digests(docs: DataFrame, text: Column) -> DataFrame:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return docs.withColumns({
        "text_sha256": F.sha2(text, 256),
        "text_chars": F.length(text).cast("long"),
        "text_check": F.xxhash64(text),
    })


def _differs(entries: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """Whether each entry but the first differs from the one before it in any of the columns."""
    n = entries.num_rows
    out = np.zeros(n - 1, dtype=bool)
    for c in columns:
        column = entries.column(c)
        out |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each run and digest from entries that rise by run, digest and preference of their identifier.

    Digest, length and second hash must all agree for entries to merge; the first identifier stays and sizes add
    up. Entries that do not rise are an error. One batch and one open entry are held at a time.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        entries = batch if held is None else pa.concat_batches([held, batch])
        n = entries.num_rows
        run, digest = entries.column("run").to_numpy(), entries.column("text_sha256")
        falls = pc.less(digest.slice(1), digest.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if ((run[1:] < run[:-1]) | (falls & (run[1:] == run[:-1]))).any():
            raise ValueError("a digest run is not in order")
        first = np.concatenate(([0], np.flatnonzero(_differs(entries, ("run", *KEY))) + 1))
        sizes = np.add.reduceat(entries.column("group_size").to_numpy(), first)
        merged = entries.take(pa.array(first))
        at = merged.schema.get_field_index("group_size")
        merged = merged.set_column(at, merged.schema.field(at), pa.array(sizes))  # its field may allow no NULLs
        held = merged.slice(len(first) - 1)
        if len(first) > 1:
            yield merged.slice(0, len(first) - 1)
    if held is not None:
        yield held


def merge_runs(rows: DataFrame, runs: int, keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """One row per digest from rows (run, id, digest key).

    Every partition sorts its rows and folds them into a run with one entry per digest, without a shuffle. A
    round merges `fan_in` neighbouring runs at a time (2: the binomial tree of pairs): of each group of runs, every
    range of digests goes to a task of its own and is merged there in sorted order, the smallest (or largest)
    identifier staying. log(runs, fan_in) rounds leave one run. A digest that holds a third of all rows has at most
    one entry per run, so no task ever gets more than `fan_in` entries of it; ranges are even, as digests are.
    """
    ship(rows.sparkSession)
    first = F.asc_nulls_last if keep == "smallest" else F.desc_nulls_last
    parts = partitions(rows.sparkSession)
    level = rows.select("run", *KEY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    order = [F.col("run"), *[F.col(k) for k in KEY], first("keep_id")]
    schema = level.schema
    level = level.sortWithinPartitions(*order).mapInArrow(merge_sorted, schema)
    left = max(runs, 1)
    while True:
        left = -(-left // fan_in)
        to = F.lit(0) if left == 1 else F.floor(F.col("run") / F.lit(fan_in)).cast("int")
        ranges = max(1, parts // left)
        at = F.conv(F.substring("text_sha256", 1, 7), 16, 10).cast("long") * ranges
        task = F.pmod(F.col("run").cast("long") * ranges + F.shiftright(at, 28), F.lit(parts)).cast("int")
        level = level.withColumn("run", to.cast("int")).select(*ENTRY).repartitionById(parts, task)
        level = level.sortWithinPartitions(*order).mapInArrow(merge_sorted, schema)
        if left == 1:
            return level.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 fan_in: int = 16) -> DataFrame:
    """Groups of equal texts: (text_sha256, text_chars, text_check, keep_id, group_size).

    Texts count as equal when SHA-256, length and a second, independent 64-bit hash all agree (the verification
    of every merge). A NULL text counts as empty; a NULL identifier is never chosen unless the group has no other.
    A very long text is only ever its digest here; ties are repeated rows, of which any stands for all.
    """
    rows = with_digests(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), F.col("t")).select(
        F.spark_partition_id().alias("run"), "id", *KEY)
    return merge_runs(rows, docs.rdd.getNumPartitions(), keep, fan_in)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     fan_in: int = 16) -> DataFrame:
    """One row per document: its identifier, keep_id, group_size, kept, text_sha256.

    Rows that repeat both identifier and text are counted one by one and flagged alike. An empty table gives no
    rows. Columns besides the two named ones are ignored.
    """
    mine = with_digests(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), F.col("t")).drop("t")
    # Staged, so that the join shuffles both sides anew and Spark can split a digest of very many copies.
    groups = staged(exact_groups(docs, id_col, text_col, keep, fan_in))
    return mine.join(groups, list(KEY)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were.

    Joined by identifier and digest, which has one row per group, so copies never meet. Of rows that repeat
    identifier and text, one stays.
    """
    groups = exact_groups(docs, id_col, text_col, keep).select(
        F.col("keep_id").alias("__keep"), *[F.col(k).alias(f"__{k}") for k in KEY])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    mine = with_digests(docs.select(whole), F.col("__row")[text_col]).select(
        "__row", F.col("__row")[id_col].alias("__id"), *KEY)
    same = F.col("__id").eqNullSafe(F.col("__keep"))
    for k in KEY:
        same = same & (F.col(k) == F.col(f"__{k}"))
    kept = mine.join(groups, same).groupBy("__id", *KEY).agg(F.first("__row").alias("__row"))
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
