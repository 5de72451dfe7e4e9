"""Importance resampling towards a target distribution, with hashed features from length-bucketed CRC matrices."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import ascii_lower, partitions, ship, staged, text_slices, words_of

#: Features of more bytes than this are too few to fill a matrix and are hashed one by one.
LONGEST = 256
#: Bytes of feature matrices that are worked on at a time.
MATRIX_BYTES = 1 << 23

_BETWEEN = np.ones(256, dtype=bool)  # all but digits, small letters and bytes outside ASCII
_BETWEEN[ord("0") : ord("9") + 1] = False
_BETWEEN[ord("a") : ord("z") + 1] = False
_BETWEEN[128:] = False


def _crc_table() -> np.ndarray:
    """What a byte does to a reflected CRC-32 (polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_CRC = _crc_table()


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every feature data[start:end].

    Features of equal length are the rows of a matrix of bytes, of which the distinct ones are kept; the CRCs
    of all its rows are updated column by column and go back to the places of the features.
    """
    out = np.zeros(len(start), np.uint32)
    length = end - start
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(length[order]) > 0))) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        size = int(length[order[a]])
        if size > LONGEST:
            for at in order[a:b]:
                out[at] = zlib.crc32(data[start[at] : end[at]].tobytes())
            continue
        step = max(MATRIX_BYTES // max(size, 1), 1)
        for lo in range(a, b, step):
            at = order[lo : min(lo + step, b)]
            matrix = data[start[at][:, None] + np.arange(size)]
            rows = np.zeros((len(at), -(-size // 8) * 8), np.uint8)  # whole 64-bit numbers compare fast
            rows[:, :size] = matrix
            if rows.shape[1] == 8:
                _, first, back = np.unique(rows.view(np.uint64).ravel(), return_index=True, return_inverse=True)
            else:
                _, first, back = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
            crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
            for column in matrix[first].T:
                crc = _CRC[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[at] = (crc ^ np.uint32(0xFFFFFFFF))[back]
    return out


def _features(texts: pa.Array, buckets: int, max_n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words of each row, then row and bucket of every feature) of slices of texts."""
    for a, b, data, bounds in text_slices(texts):
        data = ascii_lower(data)
        start, end, row = words_of(data, bounds, _BETWEEN)
        words = np.bincount(row, minlength=b - a)
        if max_n > 1 and len(start):  # words joined by one space each
            size = end - start + 1
            to = np.cumsum(size) - size
            joined = np.full(int(size.sum()), 32, np.uint8)
            inside = np.arange(len(joined)) - np.repeat(to, size)
            word = inside < np.repeat(size - 1, size)
            joined[word] = data[(np.repeat(start, size) + inside)[word]]
            data, start, end = joined, to, to + size - 1
        rows, found = [], []
        for n in range(1, max_n + 1):
            at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
            rows.append(row[at])
            found.append(crcs(data, start[at], end[at + n - 1]) % np.uint32(buckets))
        yield a, b, words, np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _counted(buckets: int, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, bucket in _features(batch.column(0), buckets, max_n):
                sums += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    return run


def _weighed(gains, buckets: int, max_n: int):  # gains: a broadcast array
    """(id, n_words, n_features, weight) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, row, bucket in _features(batch.column(1), buckets, max_n):
                weight = np.zeros(b - a, np.int64)
                np.add.at(weight, row, gains.value[bucket])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words.astype(np.int64)),
                     pa.array(np.bincount(row, minlength=b - a).astype(np.int64)), pa.array(weight)],
                    names=["id", "n_words", "n_features", "weight"])

    return run


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, max_n: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; the driver gets one row for each bucket."""
    rows = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = rows.mapInArrow(_counted(buckets, max_n), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(p(bucket | target) / p(bucket | source))), both with one count more in every bucket."""
    both = [(float(c.sum() + len(c)), c.astype(float) + 1) for c in (source, target)]
    (s_all, s), (t_all, t) = both
    return np.array([math.floor(1000 * math.log(y * s_all / (x * t_all))) for x, y in zip(s, t)], np.int64)


def ranks(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place (from 1) in an order, which is found by ranges, so no task sees all rows.

    Rows that are equal in `order` follow by their place in a staged copy, so they too are spread over ranges.
    """
    rows = staged(rows.withColumn("__at", F.monotonically_increasing_id()))
    n = max(partitions(rows.sparkSession), 8)
    sort = [*order, F.col("__at")]
    placed = staged(rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()))
    # The upper bits of the number are the range, the lower 33 the place in it.
    held = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(held.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a range
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    upto = F.element_at(F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)]), (held + 1).cast("int"))
    return placed.withColumn(name, upto + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at")


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000,
                      max_n: int = 2, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text",
                      target_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank.

    Features are all runs of 1 to max_n words (digits, letters, bytes outside ASCII; A-Z in lower case) joined
    by a space, repeats counted; a feature's bucket is its CRC-32 modulo `buckets` (see crcs). A bucket's gain
    is the log ratio of its shares in the target and in the documents, in thousandths, and weight the sum of
    the gains of a document's features. score adds a Gumbel draw that depends on seed and identifier alone, so
    the highest scores are a sample without replacement in proportion to exp(weight / 1000). Of the N
    documents of at least `least_words` words, floor(percent * N / 100) are drawn; rank is their order, NULL
    for all others. Ties go to the smaller identifier.

    The bucket counts of all documents and of all target texts reach the driver (two numbers a bucket);
    documents are read once for the counts and once for the weights.

    NULL and empty texts have no features and weight 0. Texts are read whole, very long ones in one slice. Rows
    that repeat identifier and text tie, and are ranked next to each other in no fixed order; a missing
    identifier draws like '' and comes after all others in a tie. An empty target leaves every gain to the
    documents' shares alone. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, max_n), bucket_counts(target, target_text_col, buckets, max_n))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.mapInArrow(_weighed(spark.sparkContext.broadcast(gains), buckets, max_n), "id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0))))
    scored = staged(rows.withColumn("score", F.col("weight") + gumbel))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = ranks(able, [F.col("score").desc(), F.col("id").asc_nulls_last()], "rank")
    out = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
