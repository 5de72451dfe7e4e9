"""What several operators share: staged tables and vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are hashed at a time inside a task; a longer text is hashed in pieces of this size.
SLICE_BYTES = 1 << 20

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _shared_folder(spark: SparkSession) -> None:
    """Where no folder is named, a local session gets a temporary one; executors of a cluster could not share it."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stage-"))


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder the cluster names; it goes when the cluster clears that folder."""
    spark = df.sparkSession
    _shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the folder the cluster names; lost executors do not lose it.

    The shuffle files behind it are removed as soon as it is written.
    """
    spark = df.sparkSession
    _shared_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query made under this setting
    finally:
        spark.conf.set(CLEANUP, before)


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of a session, once; on a cluster they have no other copy."""
    context = spark.sparkContext
    if getattr(context, "_faultloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "faultloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._faultloom_shipped = True


def unused(columns: list[str], name: str) -> str:
    """name, or the first of _name, __name, ... that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds) of runs of rows with about `budget` bytes; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words_of(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words do not cross row bounds.

    between: which bytes are no part of a word, white space (\\x20, \\x09-\\x0D) if not given.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and those of its inverse."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = int(_draws(seed + 77, 1)[0]) | 1
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, SLICE_BYTES + 1), b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if n <= 4 * SLICE_BYTES:
            _POWERS[seed] = have
    return have


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over its bytes, from prefix sums of pieces of bounded size."""
    out = np.empty(len(start), np.uint64)
    table = _draws(seed, 256)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(int(np.searchsorted(end, start[i] + SLICE_BYTES, side="right")), i + 1)
            piece = data[start[i] : end[j - 1]]
            up, down = _powers(seed, len(piece) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[piece] * up[: len(piece)], dtype=np.uint64)))
            s, e = start[i:j] - start[i], end[i:j] - start[i]
            out[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            i = j
    return out


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every n consecutive words, rows not regarded; empty if there are fewer words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factor = int(_draws(seed + 991, 1)[0]) | 1
    with np.errstate(over="ignore"):
        done, out = 1, words
        for bit in bin(n)[3:]:
            out = out[: len(out) - done] * np.uint64(pow(factor, done, 1 << 64)) + out[done:]
            done *= 2
            if bit == "1":
                out = out[: len(out) - 1] * np.uint64(factor) + words[done : done + len(out) - 1]
                done += 1
        return mixed(out)
