"""SimHash near duplicates against every pair of fingerprints."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultloom.llm import simhash
from faultloom.llm.queries import op11_simhash_near_dedup
from conftest import SMALL

SCHEMA = "doc_id long, text string, fingerprint int, component_id string, id double, print string"


def plain_fingerprint(text, n=4, seed=42):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """By row: the smallest identifier reachable, rows of one identifier being one node."""
    rows = [(d, f) for d, f in prints if d is not None]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, f) in enumerate(rows):
        for b, g in rows[:i]:
            if (f ^ g).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in up}


def compare(spark, rows, n=4, radius=4):
    docs = spark.createDataFrame([(d, t, 1, None, 0.5, "x") for d, t in rows], SCHEMA)
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_duplicates(docs, n, radius).collect())
    prints = [(d, plain_fingerprint(t, n)) for d, t in rows]
    to = plain_components(prints, radius)
    assert got == sorted((str(d), f"{f:016x}", to.get(d)) for d, f in prints)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    compare(spark, [
        (1, "Same words HERE now"), (2, "same  words\there now"), (3, None), (4, ""), (5, " \n "), (6, "one"), (6, "two words"),
        (7, "two words"), (8, "one"), (None, "one"), (9, long), (10, long + " end"), (11, "Ünï 😀 Ünï code " * 9), (11, "Ünï 😀 Ünï code " * 9)])
    empty = simhash.simhash_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs]
    to = plain_components(prints, 4)
    got = {(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in op11_simhash_near_dedup(spark, SMALL).collect()}
    assert got == {(d, f, to[d]) for d, f in prints}


@pytest.mark.parametrize("radius,power,variants", [(4, 10, 4_000_000), (4, 10, 500), (4, 14, 3000), (3, 10, 4_000_000), (2, 11, 40), (1, 10, 9)])
def test_every_pair_within_the_radius_meets(radius, power, variants, monkeypatch):
    """Walks of a few bits at a time, so that many pairs lie at, just within and just beyond the radius."""
    monkeypatch.setattr(simhash, "BLOCK_VARIANTS", variants)
    rng = np.random.default_rng(radius)
    prints = set()
    for _ in range(25):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            prints.add(at)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(b)
    prints = np.array(sorted(prints), np.uint64)
    ball = simhash.Ball(power, radius)
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for block in range(1 << power):
        mine = np.flatnonzero(np.isin(ball.block(prints) ^ block, ball.steps))
        if len(mine):
            for a, b in zip(*simhash._pairs(prints[mine], ball, block)):
                x, y = find(mine[a]), find(mine[b])
                assert (int(prints[mine[a]]) ^ int(prints[mine[b]])).bit_count() <= radius
                up[max(x, y)] = min(x, y)
    want = plain_components([(i, int(f)) for i, f in enumerate(prints)], radius)
    assert {i: find(i) for i in range(len(prints))} == want


def test_a_text_in_pieces_has_the_fingerprint_of_the_whole(monkeypatch):
    text = ("some words and Some MORE words " * 40 + "averyveryverylongword" * 30 + " tail of it").encode()
    want = plain_fingerprint(text.decode())
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text, 4, 42) == want
        assert simhash.fingerprint(b"two words", 4, 42) == plain_fingerprint("two words")


def test_a_large_group_of_near_fingerprints(spark):
    """Half of all rows within two bits of one number: no pairs but one link each, and one component."""
    centre = 0x0123456789ABCDEF
    near = [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    far = [int(x) for x in np.random.default_rng(1).integers(0, 1 << 63, 2000)]
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, 5 + i) for i, f in enumerate(near + far)], "print long, rep long")
    links = rows.mapInArrow(simhash._sent(10, 4), "block long, prints binary, ids binary").groupBy("block").applyInPandas(
        simhash._linked(10, 4), "a long, b long").distinct()
    from faultloom.llm.components import components
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {5 + i: 5 for i in range(len(near))}
    assert links.where(F.col("a") >= F.col("b")).count() == 0
