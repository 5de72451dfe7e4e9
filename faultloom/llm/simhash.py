"""SimHash near duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import ship, staged
from faultloom.llm.components import components

BITS = 64
#: Bytes of text that are cut into words at a time.
PIECE = 1 << 20
#: Variants that a block of them is meant to hold; the number of blocks follows from the fingerprints. A block
#: that holds more is worked off in passes of this size.
BLOCK_VARIANTS = 4_000_000
#: Blocks are 2 to this power at least, so that many tasks share few fingerprints.
LEAST_POWER = 10

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _bits(words: list[bytes], n: int, seed: int) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of all shingles of `words`, and the number of shingles."""
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda at, size: at + size + 1, initial=0))
    ends = starts[min(n, len(words)) :]  # each one past the space that follows
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends)]), np.uint8)
    return np.unpackbits(hashes).reshape(-1, BITS).sum(axis=0, dtype=np.int64), len(ends)


def fingerprint(text: bytes, n: int, seed: int) -> int:
    """The bits that are set in more than half of the hashes of a text's shingles, as an unsigned number.

    Shingles are n words (A-Z in lower case) joined by spaces, repeats included; a shorter text is one
    shingle, a text without words has none and the fingerprint zero. Long texts are read in pieces.
    """
    counts, total, words, at = np.zeros(BITS, np.int64), 0, [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words += text[at:end].translate(_LOWER).split()
        at = end
        if len(words) >= n or (at == len(text) and not total and words):
            some, m = _bits(words, n, seed)
            counts, total = counts + some, total + m
            words = words[len(words) - n + 1 :] if n > 1 else []
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _fingerprints(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"", n, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    return run


class Ball:
    """All changes of a fingerprint within half the radius, by the blocks of variants they lead to.

    The 64 bits are dealt to `power` groups; the parities of a number's groups are its block. A variant of a
    fingerprint lies in the block of the fingerprint, changed by the parities of what was changed.
    """

    def __init__(self, power: int, radius: int):
        self.radius = radius
        bits = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        self.groups = [np.bitwise_or.reduce(g) for g in np.array_split(bits, power)]
        far = (radius + 1) // 2
        masks = [sum(1 << b for b in bits) for m in range(far + 1) for bits in combinations(range(BITS), m)]
        masks = np.array(masks, np.uint64)
        parity = self.block(masks)
        order = np.argsort(parity, kind="stable")
        self.masks, parity = masks[order], parity[order]
        self.steps, cuts = np.unique(parity, return_index=True)
        self.cuts = np.append(cuts, len(masks))
        #: For an odd radius, one of two fingerprints goes a step further than the other.
        self.near = np.bitwise_count(self.masks) <= radius // 2

    def block(self, prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), np.int64)
        for k, mask in enumerate(self.groups):
            out |= (np.bitwise_count(prints & mask).astype(np.int64) & 1) << k
        return out

    def variants(self, prints: np.ndarray, block: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Variants of the prints that lie in a block, whose they are, and whether they are near ones; of
        `parts` equal parts of all numbers only one."""
        step = self.block(prints) ^ block
        order = np.argsort(step, kind="stable")
        found, owners, near = [], [], []
        for a, b in zip(*self._runs(step[order])):
            at = int(np.searchsorted(self.steps, step[order[a]]))
            lo, hi = self.cuts[at], self.cuts[at + 1]
            some = order[a:b]
            v = (prints[some][:, None] ^ self.masks[lo:hi][None, :]).ravel()
            o, w = np.repeat(some, hi - lo), np.tile(self.near[lo:hi], len(some))
            if parts > 1:
                mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts) == part
                v, o, w = v[mine], o[mine], w[mine]
            found.append(v)
            owners.append(o)
            near.append(w)
        return np.concatenate(found), np.concatenate(owners), np.concatenate(near)

    def size(self, prints: np.ndarray, block: int) -> int:
        at = np.searchsorted(self.steps, self.block(prints) ^ block)
        return int(np.diff(self.cuts)[at].sum())

    @staticmethod
    def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        return first, np.append(first[1:], len(values))


@lru_cache(maxsize=4)
def _ball(power: int, radius: int) -> Ball:
    return Ball(power, radius)


def _planes(ids: np.ndarray) -> bytes:
    """Identifiers byte by byte, the highest bytes first, which are mostly equal and pack well."""
    return np.ascontiguousarray(ids.astype(">i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">i8").ravel().astype(np.int64)


def _sent(power: int, radius: int):
    """Fingerprints packed for every block that holds variants of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball(power, radius)
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            ids = batch.column(1).to_numpy()
            if not len(ids):
                continue
            block = (ball.block(prints)[:, None] ^ ball.steps[None, :]).ravel()
            which = np.repeat(np.arange(len(ids)), len(ball.steps))
            order = np.argsort(block, kind="stable")
            block, which = block[order], which[order]
            runs = list(zip(*Ball._runs(block)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[a]) for a, _ in runs], pa.int64()),
                 pa.array([prints[which[a:b]].tobytes() for a, b in runs], pa.binary()),
                 pa.array([_planes(ids[which[a:b]]) for a, b in runs], pa.binary())], names=["block", "prints", "ids"])

    return run


def _pairs(prints: np.ndarray, ball: Ball, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (hub, other) of fingerprints that share a variant of a block.

    Any two that a variant brings together through a near one are linked, so one member of each bucket, the
    first of its near ones, stands for it; pairs that several variants find are kept once.
    """
    n, parts = len(prints), -(-ball.size(prints, block) // BLOCK_VARIANTS)
    codes = []
    for part in range(parts):
        v, owner, near = ball.variants(prints, block, part, parts)
        ordered = np.sort(v)
        several = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(several):
            continue
        at = np.minimum(np.searchsorted(several, v), len(several) - 1)
        hit = several[at] == v
        bucket, owner, near = at[hit], owner[hit], near[hit]
        order = np.lexsort((owner, ~near, bucket))
        bucket, owner, near = bucket[order], owner[order], near[order]
        first = np.searchsorted(bucket, np.arange(len(several)))
        hub = owner[first][bucket]
        codes.append(np.unique((hub * n + owner)[(hub != owner) & near[first][bucket]]))
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    hub, other = np.divmod(code, n)
    right = np.bitwise_count(prints[hub] ^ prints[other]) <= ball.radius
    return hub[right], other[right]


def _linked(power: int, radius: int):
    """Of one block, links (a, b) that connect what its verified pairs connect: to each fingerprint's identifier
    the smallest one of its part."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ball = _ball(power, radius)
        prints = np.frombuffer(b"".join(frame["prints"]), np.uint64)
        ids = np.concatenate([_from_planes(d) for d in frame["ids"]])
        order = np.argsort(ids, kind="stable")
        prints, ids = prints[order], ids[order]
        hub, other = _pairs(prints, ball, int(frame["block"].iloc[0]))
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[hub], label[other])
            new = label.copy()
            np.minimum.at(new, hub, low)
            np.minimum.at(new, other, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        linked = np.flatnonzero(ids[label] != ids)
        return pd.DataFrame({"a": ids[label[linked]], "b": ids[linked]})

    return run


def simhash_duplicates(docs: DataFrame, n: int = 5, radius: int = 4, seed: int = 42, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints are SimHashes of the XXH64 hashes of n-word shingles (see fingerprint). Two documents are
    linked if their fingerprints differ in at most `radius` bits; component_id is the smallest identifier
    reachable over links.

    1. Documents of equal fingerprint are one class, stood for by the smallest identifier.
    2. Two fingerprints within the radius have a number within half of it of both. Every fingerprint emits all
       numbers within half the radius (for 4 bits: 2,081) and meets the others at their common variants.
       Variants travel in blocks: the parities of `power` groups of bits are a variant's block, so a
       fingerprint is sent once to each block that holds variants of it (for 10 groups: 56) and is expanded
       there. `power` follows from the number of fingerprints and holds a block at BLOCK_VARIANTS on average;
       parities even out blocks although short texts have few bits set. A fuller block goes in passes.
    3. In each block, what meets is deduplicated and verified; the links of a block go on as one link for each
       fingerprint that has any, never as all pairs. Components of the links of all blocks are labels.

    NULL texts count as empty; texts without words have the fingerprint zero and are linked as such. Very long
    texts are read in pieces. Rows that share an identifier are one node: links of either are links of both;
    repeated rows come out repeated. A row without identifier is linked with nothing and has no component_id.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    prints = staged(rows.mapInArrow(_fingerprints(n, seed), "id long, print long"))
    real = prints.where("id is not null")
    classes = staged(real.groupBy("print").agg(F.min("id").alias("rep")))
    ball = sum(math.comb(BITS, m) for m in range((radius + 1) // 2 + 1))
    power = min(max(math.ceil(math.log2(max(classes.count(), 1) * ball / BLOCK_VARIANTS)), LEAST_POWER), BITS - 2)
    sent = classes.mapInArrow(_sent(power, radius), "block long, prints binary, ids binary")
    links = sent.groupBy("block").applyInPandas(_linked(power, radius), "a long, b long").distinct()
    # Rows that share an identifier make their classes one node.
    several = staged(real.groupBy("id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo < hi").select("id"))
    of = real.join(several, "id").join(classes, "print").select("id", "rep")
    least = of.groupBy("id").agg(F.min("rep").alias("a"))
    links = links.union(of.join(least, "id").where("rep != a").select("a", F.col("rep").alias("b")))
    labels = components(staged(links.distinct())).withColumnRenamed("id", "rep")
    # Staged, so that the join shuffles both sides anew and Spark can split a fingerprint of very many copies.
    known = staged(classes.join(labels, "rep", "left").select("print", F.coalesce("component", "rep").alias("component")))
    return prints.join(known, "print", "left").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
