"""Importance resampling and source divergence: SQL on the given tables, brute force on odd ones."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import oracle
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from faultloom.llm import divergence, importance
from faultloom.llm.oracles import ORACLES
from faultloom.llm.queries import QUERIES

LONG = " ".join(f"w{i % 97}é" for i in range(30_000))
ODD = [
    (1, "The Cat sat on the mat with 2 cats and the hat of the cat by the mat near the cat", "en", "a"),
    (2, None, "en", "a"), (3, "", None, "a"), (4, " ;. \n", "en", None), (5, LONG, "en", "b"), (5, LONG, "en", "b"), (5, LONG, "en", "b"),
    (None, "the cat " * 12, "en", "c"), (7, "Ünïcode ünïcode 😀 naïve " * 9, "fr", "a"), (8, "x" * 700 + " " + "y" * 20 + " cat", "en", "a"),
    (9, "x" * 700 + " " + "y" * 20 + " the", "en", "c"), (10, "y" * 20 + " Y" + "y" * 19 + " " + "x" * 700, "en", "b"), (11, "mat cat", None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, rank string, weight int, p int, n double, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, 2, 0.5, "i") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_source_divergence"])
def test_queries_match_sql(spark, db, name):
    equal, message = oracle.compare(QUERIES[name](spark, SMALL), db, ORACLES[name])
    assert equal, message


@pytest.mark.parametrize("step", [1 << 23, 64])
def test_crc_matrices(monkeypatch, step):
    monkeypatch.setattr(importance, "MATRIX_BYTES", step)
    rng = np.random.default_rng(3)
    words = [rng.integers(97, 101, n).astype(np.uint8).tobytes() for n in [1, 1, 2, 3, 7, 8, 9, 16, 17, 256, 257, 5000] * 40]
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    got = importance.crcs(np.frombuffer(b"".join(words), np.uint8), start, start + size)
    assert got.tolist() == [zlib.crc32(w) for w in words]


def plain_sample(rows, target, percent, least, buckets, max_n, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    docs = [(r[0], *features(r[1])) for r in rows]
    s = Counter(b for *_, f in docs for b in f)
    t = Counter(b for text in target for b in features(text)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * s_all / (float(s[b] + 1) * t_all)))
    out = []
    for d, words, f in docs:
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4])
    drawn = Counter((a[2] if not a[1] else None) for a in able[: len(able) * percent // 100])
    return out, drawn, [(None if a[1] else a[2]) for a in able[: len(able) * percent // 100]]


@pytest.mark.parametrize("max_n,percent", [(1, 50), (3, 80)])
def test_sample_of_odd_rows(spark, max_n, percent):
    target = ["cats and hats", None, "the mat; the hat"]
    want, _, order = plain_sample(ODD, target, percent, 5, 500, max_n, "s")
    got = importance.importance_sample(
        table(spark, ODD), spark.createDataFrame([(t,) for t in target], "text string"), percent, 5, 500, max_n, "s").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    assert sorted((key(tuple(r)) for r in got)) == sorted(map(key, want))
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == order
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(order) + 1))
    none = importance.importance_sample(table(spark, []), spark.createDataFrame([], "text string"))
    assert none.columns == ["doc_id", "n_features", "weight", "score", "rank"] and none.count() == 0


def test_ranks_of_ties_over_many_ranges(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("score"), F.lit("x").alias("at"))
    got = importance.ranks(rows, [F.col("score").desc()], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001))
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True) and len({r["id"] for r in got}) == 3000


def plain_divergence(rows, least, top):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r[1] or ""))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for g, _, w in docs if g == lang for t in set(w))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, w in docs:
            if g == lang:
                counts[s].update(t for t in w if t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        whole = sum(counts.values(), Counter())
        over = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            pairs = [(-sum(over(share(c, t), share(o, t)) for t in kept), i) for i, o in counts.items() if i != s]
            terms = [(-over(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, i, -v, k + 1) for k, (v, i) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:most])}
    return out


def odd_sources(seed):
    rng = np.random.default_rng(seed)
    words = ["a", "bb", "Ccc", "longerword", "sixteenletters.x", "seventeenletters", "überlänge" * 3, "é", "z" * 70_000]
    return ODD + [(100 + i, " ".join(rng.choice(words, rng.integers(0, 9))), "en" if i % 3 else "de", f"s{rng.integers(0, 6)}") for i in range(60)]


@pytest.mark.parametrize("least,top,cells,groups", [(3, 200, 2_000_000, 20_000), (1, 3, 5, 0)])
def test_divergence_of_odd_rows(spark, monkeypatch, least, top, cells, groups):
    monkeypatch.setattr(divergence, "PAIR_CELLS", cells)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", groups)
    rows = odd_sources(least)
    got = divergence.source_divergence(table(spark, rows), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == plain_divergence(rows, least, top)


def test_divergence_without_rows(spark):
    assert divergence.source_divergence(table(spark, [])).count() == 0
    bare = divergence.source_divergence(table(spark, [(1, None, None, "a"), (2, "once", "", "b")]))
    assert {tuple(r) for r in bare.collect()} == {("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)}


def test_shares_are_exact_for_very_frequent_terms(spark):
    n, total, terms = 10**15 + 7, 3 * 10**15 + 1, 10**9 + 9
    row = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long"))).first()
    assert row[0] == 1 + 10**9 * (n + 1) // (total + terms)
