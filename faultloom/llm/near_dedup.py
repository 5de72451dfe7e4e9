"""Near duplicates: MinHash signatures and a multi-index Hamming join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import ascii_lower, gram_hashes, mixed, partitions, ship, staged, text_slices, unused, word_hashes, words_of
from faultloom.llm.components import components

#: Signature: this many MinHash values of 16 bits each.
VALUES = 64
#: Signatures that differ in at most this many values are compared on their full sets. At similarity 0.8 the
#: number of different values is binomial with mean 12.8 and deviation 3.2, so a pair is missed about once in
#: 200,000 pairs of exactly that similarity, and far more rarely above it.
MAX_DIFFERENT = 28
#: By pigeonhole, signatures with at most 28 different values have at most one in some of 15 chunks.
CHUNKS = 15
#: Members of a bucket that are compared in one task; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
#: Bits of the parity sketch of a set. Two sets differ in at least as many elements as their sketches do in bits.
SKETCH = 2048
#: Identifiers up to which a semi-join with the documents is a broadcast; beyond it, it is a shuffle join.
BROADCAST_IDS = 2_000_000


def _shingles(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and the row of each."""
    data = ascii_lower(data)
    start, end, row = words_of(data, bounds)
    words = word_hashes(data, start, end)
    rows = len(bounds) - 1
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    hashes, of = [], []
    if len(words) >= n:
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        hashes.append(gram_hashes(words, n)[at])
        of.append(row[at])
    for m in range(1, n):  # a shorter text is one shingle
        short = np.flatnonzero(counts == m)
        if len(short):
            hashes.append(gram_hashes(words, m, seed=m)[first[short]])
            of.append(short)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, of = np.concatenate(hashes), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    h, of = h[order], of[order]
    cuts = np.searchsorted(of, np.arange(rows + 1))
    for a, b in zip(cuts, cuts[1:]):
        h[a:b].sort()
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
    return h[new], of[new]


def _signed(n: int):
    """(id, n_shingles, two hashes of the set, signature, parity sketch) of every row (id, text)."""
    factors = mixed(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = mixed(np.arange(1001, 1001 + VALUES, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column(1)):
                h, of = _shingles(data, bounds, n)
                sizes = np.bincount(of, minlength=b - a)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                sums = np.zeros((2, b - a), np.uint64)
                sig: list = [None] * (b - a)
                sketch: list = [None] * (b - a)
                if len(full):
                    sums[0, full] = np.add.reduceat(mixed(h), starts)
                    sums[1, full] = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    values = np.empty((len(full), VALUES), np.uint16)
                    for k in range(VALUES):
                        least = np.minimum.reduceat(h * factors[k] + shifts[k], starts)
                        values[:, k] = (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
                    odd = np.bincount(of * SKETCH + (h >> np.uint64(53)).astype(np.int64), minlength=(b - a) * SKETCH) & 1
                    odd = np.packbits(odd.astype(bool).reshape(b - a, SKETCH)[full], axis=1)
                    for r, v, o in zip(full, values, odd):
                        sig[r], sketch[r] = v.tobytes(), o.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(sizes.astype(np.int64)),
                     pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())],
                    names=["id", "n_shingles", "set_a", "set_b", "sig", "sketch"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every chunk and every value of it that may be wrong: a key of the chunk's other values."""
    chunks = np.array_split(np.arange(VALUES), CHUNKS)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for at in range(0, len(ids), 20_000):
            some = ids[at : at + 20_000]
            sig = np.frombuffer(b"".join(batch.column(1).slice(at, 20_000).to_pylist()), np.uint16).reshape(-1, VALUES).astype(np.uint64)
            keys = []
            for c, chunk in enumerate(chunks):
                for wrong in chunk:
                    key = np.full(len(some), c * VALUES + int(wrong) + 1, np.uint64)
                    for v in chunk:
                        if v != wrong:
                            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, v])
                    keys.append(key)
            flat = np.stack(keys, axis=1).ravel().view(np.int64)
            which = np.tile(np.arange(VALUES, dtype=np.int16), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(which), pa.array(np.repeat(some, VALUES))], names=["key", "which", "id"])


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _possible(n_a, n_b, sketch_a: np.ndarray, sketch_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and sketches may be linked; False is proof that they are not.

    Linked sets differ in at most (100 - percent) / (100 + percent) of their added sizes, and not in fewer
    elements than their sketches in bits.
    """
    apart = np.bitwise_count(sketch_a ^ sketch_b).sum(axis=1, dtype=np.int64)
    return (100 + percent) * apart <= (100 - percent) * (n_a + n_b)


def _close(percent: int):
    """Of pairs (a, b, sizes, signatures, sketches), those that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
            one, two = (_matrix(batch.column(k), np.uint16, VALUES) for k in (4, 5))
            near = (one != two).sum(axis=1) <= MAX_DIFFERENT
            near &= _possible(n_a, n_b, *(_matrix(batch.column(k), np.uint64, SKETCH // 64) for k in (6, 7)), percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])

    return run


_CHUNK_OF = np.concatenate([np.full(len(c), k) for k, c in enumerate(np.array_split(np.arange(VALUES), CHUNKS))])
_CHUNK_AT = np.flatnonzero(np.concatenate(([True], _CHUNK_OF[1:] != _CHUNK_OF[:-1])))


def _first_key(differ: np.ndarray) -> np.ndarray:
    """Of rows of different values (n, VALUES): the first key both signatures have, by the value it leaves out."""
    wrong = np.add.reduceat(differ, _CHUNK_AT, axis=1)
    chunk = np.argmax(wrong <= 1, axis=1)
    inside = differ & (_CHUNK_OF == chunk[:, None])
    return np.where(inside.any(axis=1), np.argmax(inside, axis=1), _CHUNK_AT[chunk])


def _bucket_pairs(which: int, ids: np.ndarray, labels: np.ndarray, sides: np.ndarray, sizes: np.ndarray, sig: np.ndarray,
                  sketch: np.ndarray, most: int | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of one block of a bucket that may be linked and differ in label.

    most: each member's nearest so many only. Without it, all pairs whose first common key this bucket is, so a
    pair comes from one bucket only.
    """
    out = []
    for i in range(len(ids)):
        other = labels != labels[i]
        if sides[i]:
            other &= sides != sides[i]
        if most is None:
            other[:i] = False
        other &= (100 * sizes >= percent * sizes[i]) & (percent * sizes <= 100 * sizes[i])
        j = np.flatnonzero(other)
        if not len(j):
            continue
        differ = sig[j] != sig[i]
        far = differ.sum(axis=1)
        near = far <= MAX_DIFFERENT
        near[near] = _possible(sizes[j[near]], sizes[i], sketch[j[near]], sketch[i], percent)
        if most is None:
            near[near] = _first_key(differ[near]) == which
            j = j[near]
        else:
            j, far = j[near], far[near]
            if len(j) > most:
                j = j[np.argsort(far, kind="stable")[:most]]
        out += [(ids[i], ids[k]) for k in j]
    return out


def _cross(most: int | None, percent: int):
    """Pairs of a partition's rows (key, which, id, label, side, size, sig, sketch), sorted by key, that lie in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            key, which, ids, labels, sides, sizes = (rows.column(k).to_numpy() for k in range(6))
            sig, sketch = _matrix(rows.column(6), np.uint16, VALUES), _matrix(rows.column(7), np.uint64, SKETCH // 64)
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
            found: set = set()
            for a, b in zip(cuts, np.append(cuts[1:], len(key))):
                if b - a > 1:
                    found.update((min(p), max(p)) for p in _bucket_pairs(
                        int(which[a]), ids[a:b], labels[a:b], sides[a:b], sizes[a:b], sig[a:b], sketch[a:b], most, percent))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last or (held and held[-1].column(0)[0].as_py() != key[0]):
                yield flush(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _sets(n: int):
    """(id, sorted distinct shingle hashes) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column(1)):
                h, of = _shingles(data, bounds, n)
                cuts = np.searchsorted(of, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([h[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())],
                    names=["id", "shingles"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) that are linked on their full sets."""
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_IDS
    sets = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "t").mapInArrow(_sets(n), "id long, shingles binary")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return staged(full.mapInArrow(_linked(percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    A document's set holds the hashes of its distinct shingles of n words (A-Z in lower case; a shorter text
    is one shingle). Two documents are linked if 100 * intersection >= percent * union; component_id is the
    smallest identifier reachable over links, kept tells whether it is the document's own.

    1. Documents with equal sets are one class, stood for by its smallest identifier.
    2. Every class has a signature of 64 MinHash values of 16 bits. It is split into 15 chunks; a chunk may
       hold one wrong value, so for each value a key of the chunk's other values is indexed (64 keys). Any two
       signatures with at most 28 different values share a key.
    3. In each bucket, every class is compared with the smallest one; close pairs are confirmed on full sets,
       and components of confirmed links become labels. Buckets whose members all have one label are done, so
       a large group of near copies never becomes pairs.
    4. In the other buckets, close pairs of different label are confirmed: the nearest few of every member, round
       after round as long as labels merge, at last all that are left, each from one bucket only. Large buckets
       are dealt out as pairs of blocks. Pairs whose sizes or parity sketches (2,048 bits a set) prove that
       they are not linked are left out, so groups of copies just below the threshold cost no full comparisons.

    NULL or blank texts have empty sets and are linked with nothing. Rows that share an identifier are one node:
    links of either are links of both. A row without identifier is linked with nothing and kept. Other columns
    are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    signed = staged(rows.mapInArrow(_signed(n), "id long, n_shingles long, set_a long, set_b long, sig binary, sketch binary"))
    real = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    whole = ["n_shingles", "set_a", "set_b"]
    # Staged, so that the join shuffles both sides anew and Spark can split a class of very many copies.
    classes = staged(real.groupBy(*whole).agg(F.min("id").alias("rep")))
    members = staged(real.join(classes, whole).select("id", "rep", "n_shingles", "sig", "sketch"))
    reps = staged(members.where("id = rep").select("id", F.col("n_shingles").alias("n"), "sig", "sketch").dropDuplicates(["id", "sig", "sketch"]))
    keys = reps.select("id", "sig").mapInArrow(_keys, "key long, which short, id long")
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("size")).where("hub < top")
    shared = staged(keys.join(hubs.drop("top"), "key"))

    stars = shared.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("x"), F.col("sketch").alias("u"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("y"), F.col("sketch").alias("v"))
    fits = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    stars = stars.join(one, "a").join(two, "b").where(fits).select("a", "b", "n_a", "n_b", "x", "y", "u", "v").mapInArrow(_close(percent), "a long, b long")
    tested = staged(stars.distinct())
    # Rows that share an identifier make their classes one node.
    twice = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
    twice = members.join(twice, "id").where("rep != a").select("a", F.col("rep").alias("b"))
    links = staged(_confirmed(tested, rows, n, percent).union(twice).distinct())
    labels = components(links)
    most: int | None = 4
    while True:
        known = labels.withColumnRenamed("component", "known")
        marked = shared.join(known, "id", "left").select("key", "which", "size", "id", F.coalesce("known", "id").alias("label"))
        mixed_keys = marked.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
        open_rows = marked.join(mixed_keys, "key")
        # Buckets of more than a block go out once for each pair of blocks; side tells the two blocks apart.
        blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("long")
        mine = F.pmod(F.xxhash64("id"), blocks)
        dealt = open_rows.withColumns({"blocks": blocks, "mine": mine}).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select(
            F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"),
            "which", "id", "label", F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"))
        parts = max(partitions(docs.sparkSession), 8)
        dealt = dealt.join(reps, "id").select("key", "which", "id", "label", "side", "n", "sig", "sketch").repartition(parts, "key").sortWithinPartitions("key", "id")
        fresh = dealt.mapInArrow(_cross(most, percent), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
        fresh = staged(fresh)
        found = _confirmed(fresh, rows, n, percent)
        merged = not found.isEmpty()
        if merged:
            links = staged(links.union(found))
            labels = components(links)
        if most is None:
            break
        tested = staged(tested.union(fresh))
        if not merged:
            most = None
    by_rep = labels.select(F.col("id").alias("rep"), "component")
    found_of = members.join(by_rep, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    joined = signed.select("id", "n_shingles").join(found_of, "id", "left")
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"),
                         F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the document of the smallest identifier of each group (see near_duplicates), all columns as they were."""
    name = unused(docs.columns, "kept")
    kept = near_duplicates(docs, n, percent, id_col, text_col).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_semi")
