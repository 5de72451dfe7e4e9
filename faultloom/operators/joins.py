"""Attaching a per-key summary to rows whose keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import estimated_bytes

SALTS = 32
BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_KEYS = 200_000


def few_keys(rows: DataFrame, keys: Sequence[str], limit: int = BROADCAST_KEYS) -> bool:
    """Whether ``rows`` have at most ``limit`` distinct keys. Reads the key columns only, and
    combines them map-side."""
    return rows.select(*keys).distinct().limit(limit + 1).count() <= limit


def attach(
    rows: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    count_keys: bool = True,
    salts: int = SALTS,
) -> DataFrame:
    """Joins ``summary`` (one row per key of ``rows``) to ``rows``.

    A summary estimated below ``BROADCAST_BYTES`` is broadcast. So is one of at most
    ``BROADCAST_KEYS`` rows: with ``count_keys``, the keys of a large table are counted first,
    which costs a scan of the key columns and saves a shuffle of all rows. Any other summary is
    copied ``salts`` times and shuffled with the rows, each key spread over ``salts`` tasks by a
    hash of the ``spread`` columns.
    """
    if estimated_bytes(summary) <= BROADCAST_BYTES or (count_keys and few_keys(rows, keys)):
        return rows.join(F.broadcast(summary), list(keys), how)
    salted = rows.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")
    )
    copies = summary.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
