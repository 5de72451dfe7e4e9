"""The operators against brute force, on odd inputs, and on empty tables."""

import hashlib
import math
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from faultloom.llm import (
    common, decontaminate, exact_dedup, html_text, labelled, licenses, mixing, near_dedup, pii, quality_knn, substring, toxicity,
)
from faultloom.llm.components import components

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
NEAR = " ".join(f"same{i}" for i in range(60))
#: NULLs in any column, empty and blank texts, a very long one, ties, repeated rows and clashing extra columns.
ODD = [
    (1, NEAR, "en", "a", 1, 0.5, "x"), (2, NEAR, "en", "a", None, None, None), (2, NEAR, "en", "a", None, None, None),
    (3, NEAR + " more", None, None, 3, 1.0, "y"), (4, None, "en", "b", 4, 0.0, ""), (5, "", "de", "b", 5, 0.0, ""),
    (6, " \t\n ", None, "b", 6, 0.0, ""), (7, LONG, "en", None, 7, 0.0, ""), (8, "one", "en", "c", 8, 0.0, ""),
    (None, "no identifier at all here " * 9, "en", "c", 9, 0.0, ""), (9, "Ünïcode 😀 " * 30, "en", "c", 9, 0.0, ""),
    (9, "another text under the same identifier " * 5, "en", "c", 9, 0.0, ""),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, score double, keep_id string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return sorted((r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect())


def words(text):
    return (text or "").encode().split()


def test_word_hashes_follow_words_not_places():
    import pyarrow as pa

    rows = ["a b  a", None, "", "ab b\tb\n", LONG]
    seen = {}
    for first, end, data, bounds in common.text_slices(pa.array(rows), budget=4):
        start, stop, row = common.words_of(data, bounds)
        got = [bytes(data[a:b]) for a, b in zip(start, stop)]
        assert got == [w for r in rows[first:end] for w in words(r)]
        for w, h in zip(got, common.word_hashes(data, start, stop)):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_gram_hashes_depend_on_words_and_order_alone():
    w = np.arange(1, 40, dtype=np.uint64) * np.uint64(7919)
    for n in (1, 2, 5, 10, 20):
        g = common.gram_hashes(np.concatenate((w, w[::-1], w)), n)
        assert len(g) == 3 * len(w) - n + 1
        assert (g[: len(w) - n + 1] == g[2 * len(w) :][: len(w) - n + 1]).all()
        assert n == 1 or not set(g[: len(w) - n + 1]) & set(g[len(w) : 2 * len(w) - n + 1])
    assert len(common.gram_hashes(w[:3], 4)) == 0


# exact duplicates


def test_exact_duplicates_of_odd_rows(odd, none):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_duplicates(odd, fan_in=2).collect()}
    near = got[1, hashlib.sha256(NEAR.encode()).hexdigest()]
    assert (near["keep_id"], near["group_size"], near["kept"]) == (1, 3, True)
    empty = got[5, hashlib.sha256(b"").hexdigest()]
    assert (empty["keep_id"], empty["group_size"]) == (4, 2)
    largest = exact_dedup.exact_duplicates(odd, keep="largest").where("doc_id = 1").first()
    assert (largest["keep_id"], largest["kept"]) == (2, False)
    assert exact_dedup.exact_duplicates(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({(r[1] or "") for r in ODD})
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


@pytest.mark.parametrize("runs,fan_in", [(1, 2), (7, 2), (40, 3)])
def test_merge_rounds_do_not_change_groups(spark, runs, fan_in):
    rows = spark.range(600).select(
        (F.col("id") % runs).cast("int").alias("run"), "id", F.concat(F.lit("k"), F.col("id") % 11).alias("text_sha256"),
        F.lit(1).cast("long").alias("text_chars"), F.lit(2).cast("long").alias("text_check"))
    got = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.merge_runs(rows, runs, fan_in=fan_in).collect()}
    assert got == {f"k{i}": (i, len(range(i, 600, 11))) for i in range(11)}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_sorted_runs_merge_as_plain_groups_do(spark, keep):
    """A digest with a third of all rows, NULL identifiers, digests that agree and lengths that do not."""
    rows = spark.range(0, 3000, 1, 23).select(
        F.spark_partition_id().alias("run"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"),
        F.sha2(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 400).cast("string")), 256).alias("text_sha256"),
        (F.col("id") % 2).alias("text_chars"), F.lit(2).cast("long").alias("text_check")).persist()
    best = min if keep == "smallest" else max
    want = defaultdict(list)
    for r in rows.collect():
        want[r["text_sha256"], r["text_chars"]].append(r["id"])
    want = {k: (best([i for i in v if i is not None], default=None), len(v)) for k, v in want.items()}
    for fan_in in (2, 16):
        merged = exact_dedup.merge_runs(rows, 23, keep, fan_in).collect()
        assert len(merged) == len(want)
        assert {(r["text_sha256"], r["text_chars"]): (r["keep_id"], r["group_size"]) for r in merged} == want


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates_of_partitions_of_several_batches(spark, keep):
    """Partitions of 12,500 rows come to Python as more than one batch each."""
    docs = spark.range(0, 25_000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 8000).cast("string")).alias("text"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs, keep=keep).collect()}
    copies = {i: range(i, 25_000, 8000) for i in range(8000)}
    best = {i: v[0] if keep == "smallest" else v[-1] for i, v in copies.items()}
    assert got == {d: (best[i], len(v), d == best[i]) for i, v in copies.items() for d in v}


def test_merging_carries_open_entries_over_batches_and_refuses_disorder():
    def batch(*entries):
        columns = list(zip(*entries))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(exact_dedup.ENTRY))

    parts = [batch((0, "a", 1, 1, 5, 2)), batch((0, "a", 1, 1, 9, 1), (0, "b", 1, 1, 2, 1)),
             batch((0, "b", 2, 1, 1, 1), (1, "a", 1, 1, 3, 4))]
    got = [tuple(r.values()) for out in exact_dedup.merge_sorted(iter(parts)) for r in out.to_pylist()]
    assert got == [(0, "a", 1, 1, 5, 3), (0, "b", 1, 1, 2, 1), (0, "b", 2, 1, 1, 1), (1, "a", 1, 1, 3, 4)]
    assert list(exact_dedup.merge_sorted(iter([]))) == []
    with pytest.raises(ValueError):
        list(exact_dedup.merge_sorted(iter([parts[1], parts[0]])))


# near duplicates


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = words((t or "").lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    both = defaultdict(int)
    for ds in where.values():
        for i, b in enumerate(ds):
            for a in ds[:i]:
                both[a, b] += 1
    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(150):  # copies of one text with few to many changes, most of them not linked to each other
        copy = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            copy[at] = f"c{rng.integers(10**6)}"
        rows.append((d, " ".join(copy).upper() if d % 7 == 0 else " ".join(copy)))
    rows += [(1000 + d, " ".join(f"o{d}y{i}" for i in range(30))) for d in range(40)]
    rows += [(2000, "Two Words"), (2001, "two words"), (2002, ""), (2003, None)]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4).collect()}
    want = brute_components(rows, 4, 80)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    of = {r["doc_id"]: r for r in rows}
    assert of[2]["component_id"] == of[3]["component_id"] == 1
    assert of[None]["kept"] and of[4]["component_id"] == 4 and of[6]["n_shingles"] == 0
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 9, None}
    assert near_dedup.near_duplicates(none).count() == 0


def test_buckets_in_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = [(d, " ".join([*(f"w{i}" for i in range(60)), f"end{d}", *(f"x{d}-{i}" for i in range(d % 4))])) for d in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, 5, 80).items()}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 530)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(500, 530)} == {500}


def test_sketches_never_refute_a_link():
    rng = np.random.default_rng(1)
    for n in (5, 60, 3000, 40_000):
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        one, two = pool[:n], np.concatenate((pool[: n - n // 10], pool[n : n + n // 20]))
        both = len(np.intersect1d(one, two))
        if 100 * both < 80 * (len(one) + len(two) - both):
            continue
        sketch = [np.packbits((np.bincount((x >> np.uint64(53)).astype(int), minlength=2048) & 1).astype(bool)).view(np.uint64)[None] for x in (one, two)]
        assert near_dedup._possible(np.array([len(one)]), len(two), *sketch, 80)[0]


# repeated passages


def brute_repeats(rows, window=20):
    first = {}
    for d, t in sorted(rows):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (d, p))
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (d, p):
                gone.update(range(p, p + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark, texts):
    loop = "round and round " * 40
    rows = [*texts, (10**6, loop), (10**6 + 1, loop[5:]), (10**6 + 2, " ".join(["x"] * 500)), (-5, texts[3][1]), (10**6 + 3, LONG), (10**6 + 4, "p " + LONG)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_partitions_of_several_batches(spark):
    """Partitions of 12,500 rows come to Python as more than one batch each; of every text all copies but the first go."""
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{j}x"), (F.col("id") % 8000).cast("string")) for j in range(25)])
    docs = spark.range(0, 25_000, 1, 2).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(docs, texts=False).collect()}
    assert got == {d: (25, 0 if d < 8000 else 25) for d in range(25_000)}


def test_repeats_of_odd_rows(odd, none):
    rows = substring.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert of[1][0]["n_removed"] == 0 and [r["n_removed"] for r in of[2]] == [60, 60] and of[3][0]["n_removed"] == 60
    assert of[3][0]["kept_text"] == "more" and of[4][0]["n_words"] == 0
    assert substring.remove_repeats(none).count() == 0


# mixing


def test_mix_reaches_targets(small, odd, none):
    rows = mixing.mix(small).collect()
    assert len(rows) == small.count()
    taken, target, size = defaultdict(int), {}, {}
    source = {r["doc_id"]: r["source"] for r in small.collect()}
    most = defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
        most[s] = max(most[s], r["size"])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["repeats"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert all(target[s] <= 2 * size[s] + 1e-6 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = mixing.mix(small.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    mixed = mixing.mix(odd, extra=["size", "lang"])
    assert {"mix_size", "size", "lang"} <= set(mixed.columns) and mixed.count() == len(ODD)
    assert mixing.mix(none).count() == 0


def test_water_fill_clamps_and_spreads(spark):
    table = spark.createDataFrame([("a", 10.0, 3.0), ("b", 100.0, 1.0), ("c", 100.0, 2.0), ("d", 0.0, 1.0)], "source string, source_size double, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(table, 200.0, 2.0).collect()}
    assert got == {"a": 20.0, "b": pytest.approx(60.0), "c": pytest.approx(120.0), "d": 0.0}


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pattern_spans_match_plain_patterns(spark, texts):
    hard = [
        "a@b.com_x@c.org, q@w.e.r.t", "x@y@z.com 1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "é😀 4111 1111 1111 1111 +1 (555) 555-1234)) 4111-1111-1111-1111-",
        "+1 2 3 4 5 6 7 8 9 0 1", "", None, "1" * 5000, "a@b a@b.c. @x.com .@x.y--.z", "123456789.1.2.3.4 +1.2.3.4", "4111111111111111@x.com 12.12.12.12",
        "1 2 " * 4000, "a." * 4000 + "@b.c",
    ]
    rows = [*texts, *((10**6 + i, t) for i, t in enumerate(hard))]
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for d, t in rows:
        assert got[d]["base_sha256"] == hashlib.sha256(plain_spans(t).encode()).hexdigest(), d


def disclosing_terms(texts, together, disclosure, certainty):
    """Terms whose information share about some entity is high enough, by a plain loop over the different texts."""
    different = {t or "" for _, t in texts}
    term = re.compile(r"(?<![\w'-])[^\W\d_][\w'-]*")
    having, holding = {}, {}
    for t in different:
        for w in {m.lower() for m in term.findall(t)}:
            having.setdefault(w, set()).add(t)
        for span in filter(None, plain_spans(t).split(",")):
            kind, a, b = span.split(":")
            holding.setdefault((kind, t[int(a) : int(b)]), set()).add(t)
    out = set()
    for c in holding.values():
        content = math.log2(len(different) / len(c))
        for w, h in having.items():
            both, n, z = len(h & c), len(h), certainty
            if both < together or content <= 0:
                continue
            low = (both / n + z * z / (2 * n) - z * math.sqrt(both / n * (1 - both / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if math.log2(len(different) / len(c) * low) >= disclosure * content:
                out.add(w)
    return out, term


@pytest.mark.parametrize("together,disclosure,certainty", [(2, 0.8, 1.0), (2, 0.5, 0.0), (3, 0.6, 2.0)])
def test_terms_equal_a_plain_count_of_information_shares(spark, texts, together, disclosure, certainty):
    rows = [*texts, *((10**6 + i, t) for i, (_, t) in enumerate(texts[:60]))]  # copies, which are no evidence
    rows += [(2 * 10**6 + i, f"Zebulon{i % 7} of ward{i % 3} wrote from z{i % 7}@mail.org about {'x' * i}") for i in range(40)]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), together=together, disclosure=disclosure, certainty=certainty)
    want, term = disclosing_terms(rows, together, disclosure, certainty)
    assert "zebulon3" in want and "of" not in want
    got = {r["doc_id"]: r for r in out.collect()}
    for d, t in rows:
        covered = [(s["start"], s["end"]) for s in got[d]["base"]]
        spans = {m.span() for m in term.finditer(t or "") if m[0].lower() in want and not any(a <= m.start() < b for a, b in covered)}
        assert {(s["start"], s["end"]) for s in got[d]["spans"] if s["rank"] == 4} == spans, d


def test_copies_of_one_text_are_no_evidence(spark):
    rows = [(i, f"report {i} plain words") for i in range(40)] + [(100 + i, "Zebulon called from +1 555 123 4567 here") for i in range(9)]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").collect()
    assert len(out) == 9 and all([s["rank"] for s in r["spans"]] == [3] for r in out)


def test_terms_in_any_case_are_spanned(spark):
    forms = ["Zeb\u0130lon", "ZEB\u0130LON", "zebi\u0307lon", "STRA\u1e9eE", "stra\u00dfe", "\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2"]
    rows = [(i, f"plain words {i}") for i in range(50)] + [(100 + i, f"a@list.org {' '.join(forms)} {i}") for i in range(4)]
    rows += [(200, "3" + forms[0] + " x-" + forms[4] + " " + forms[2] + "s")]  # parts of longer words are other terms
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").collect()}
    text = rows[50][1]
    want = [(text.index(f, 10), text.index(f, 10) + len(f)) for f in forms]
    assert [(s["start"], s["end"]) for s in got[100] if s["rank"] == 4] == want and got[200] == []


def test_long_lists_of_entities_and_terms(spark):
    one = " ".join(f"Name{i} n{i}@list.org," for i in range(6000))
    rows = [(i, f"plain words {i}") for i in range(50)] + [(100, one), (101, one + " end")]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").collect()}
    assert [(s["start"], s["end"], s["rank"]) for s in out[100]["base"]] == [(m.start(), m.end(), 0) for m in re.finditer(r"n[0-9]+@list\.org", one)]
    names = [(m.start(), m.end()) for m in re.finditer(r"Name[0-9]+", one)]
    assert [(s["start"], s["end"]) for s in out[101]["spans"] if s["rank"] == 4] == names


def test_terms_that_disclose_an_entity_are_added(spark, odd, none):
    rows = [(i, f"report {i} plain words common here") for i in range(40)]
    rows += [(100 + i, f"common Zebulon called from +1 555 123 456{7} common here {i}") for i in range(3)]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r["doc_id"]: [(s["match"], s["rank"]) for s in r["spans"]] for r in out.collect()}
    assert ("zebulon", 4) in spans[100] and ("common", 4) not in spans[100] and spans[0] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "[PHONE]" in clean[100] and "Zebulon" not in clean[100] and clean[0] == rows[0][1]
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(none).count() == 0


def test_terms_far_from_their_entity_and_without_it_are_spanned(spark):
    far = "plain words common here " * 8
    rows = [(i, f"report {i} {far}") for i in range(60)]
    rows += [(100 + i, f"Zebulon {far} +1 555 123 4567 {far} zebulon {i}") for i in range(4)]
    rows += [(200, f"{far} ZEBULON"), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs.unionByName(docs.where("doc_id = 0"))).collect()}
    for d, t in rows:
        want = [m.span() for m in re.finditer("zebulon", t or "", re.I)]
        assert [(s["start"], s["end"]) for s in spans[d] if s["rank"] == 4] == want, d
    assert "zebulon" not in pii.sanitised(docs.where("doc_id <> 201")).where("doc_id >= 100").selectExpr("lower(string_agg(text))").first()[0]


# licenses


def plain_matches(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    out = {}
    for name, notice in licenses.TEMPLATES.items():
        t = re.findall(r"[^\W_]+", notice.lower())
        step = max(1, len(t) // 8)
        grams = {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
        hits = []
        for a in range(0, len(w), step):
            q = w[a : a + len(t) + step - 1]
            share = len({tuple(q[i : i + 5]) for i in range(max(1, len(q) - 4))} & grams) / len(grams)
            if share >= 0.8:
                hits.append((share, -a))
        if hits:
            out[name] = (max(hits)[0], -max(hits)[1], len(hits))
    return out


def test_license_matches_equal_a_full_search(spark, texts, odd, none):
    rows = [*texts, *((10**6 + i, "foo bar " * 30 + t + " baz" * 20) for i, t in enumerate(licenses.TEMPLATES.values()))]
    rows += [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, licenses.TEMPLATES["MIT notice"].replace("merge, publish", "merge and publish"))]
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"], r["windows"]) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(d, k): v for d, t in rows for k, v in plain_matches(t).items()}
    assert licenses.license_matches(odd).count() == 0 and licenses.license_matches(none).count() == 0


# decontamination


def full_alignment(one, two):
    best = 0
    above = [0] * (len(one) + 1)
    for y in two:
        row = [0]
        for i, x in enumerate(one):
            row.append(max(0, above[i] + (2 if x == y else -1), above[i + 1] - 1, row[i] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_equals_the_full_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        one, two = (rng.integers(0, 4, rng.integers(1, 15)) for _ in range(2))
        assert decontaminate.align(one, two)[0] == full_alignment(one, two)


def test_planted_copies_are_found_and_others_left(spark, small, odd, none):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known = {r["item_id"]: plain(r["text"]) for r in items.collect()}
    rng = np.random.default_rng(4)
    planted = []
    for k, (i, w) in enumerate(known.items()):
        edited = list(w)
        for at in rng.choice(len(w), len(w) // 8, replace=False):
            edited[at] = f"edit{at}"
        planted.append((10**6 + k, "before it " + " ".join(edited) + " after it", i))
    docs = small.select("doc_id", "text").union(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.benchmark_matches(docs, items).collect()}
    assert all((d, i) in got for d, _, i in planted)
    for r in small.collect():  # every pair that a full alignment finds, and no other
        w = plain(r["text"])
        for i, item in known.items():
            if len(set(item) & set(w)) >= len(set(item)) / 3 and len(w) < 600:
                assert ((r["doc_id"], i) in got) == (full_alignment(item, w) >= 0.5 * 2 * len(item)), (r["doc_id"], i)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "no identifier at all here"), (None, "one"), (3, "no identifier at all here")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.benchmark_matches(odd, odd_items).collect()} == {None}
    assert decontaminate.drop_contaminated(odd, odd_items).columns == odd.columns
    assert decontaminate.benchmark_matches(none, items).count() == 0
    assert decontaminate.benchmark_matches(odd, odd_items.limit(0)).count() == 0


def test_items_beyond_a_block_are_all_sought(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    items = [(i, " ".join(f"q{i}w{k}" for k in range(12))) for i in range(5)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id long, text string")
    got = decontaminate.benchmark_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"], r["n_words"]) for r in got) == [(i, i, 1, 12) for i in range(5)]


def test_one_seed_is_enough_and_repeated_passages_are_rows(spark):
    item = [f"q{k}" for k in range(15)]
    changed = [f"new{k}" if k in (3, 6, 9, 12) else w for k, w in enumerate(item)]
    docs = spark.createDataFrame(
        [(1, " ".join(["x", *changed, "y"])), (2, " ".join(["x", *item, *item, "y"])), (3, " ".join(item * 4)), (4, "nothing of it at all")],
        "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = sorted((r["doc_id"], r["first_word"], r["n_words"], r["score"]) for r in decontaminate.benchmark_matches(docs, items).collect())
    assert got == [(1, 1, 15, (22 - 4) / 30), (2, 1, 15, 1.0), (2, 16, 15, 1.0), *[(3, 15 * k, 15, 1.0) for k in range(4)]]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [4]


# classifiers


def test_sample_takes_one_row_of_an_identifier(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(900)] + [(k, None) for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)] + [(1, 1)], "doc_id long, quality int")
    rows, counts = labelled.sample(docs, labels, "quality", F.lit(True), 5)
    rows = rows.collect()
    assert len(rows) == 10 and len({r["id"] for r in rows}) == 10 and counts == {0: 19, 1: 919}
    every, _ = labelled.sample(docs, labels, "quality", F.lit(True), 100)
    assert sorted(r["id"] for r in every.collect()) == list(range(1, 40))


def held_out(spark, scored, label, train):
    rows = scored.where(~train).join(spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet"), "doc_id").select("score", label).collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_on_held_out_rows(spark, odd, none):
    folder = f"{SMALL}/../sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train = labelled.fold("doc_id", 5) != 0
    scored = quality_knn.quality_scores(docs.select("doc_id", "text"), labels, train)
    score, y = held_out(spark, scored, "quality", train)
    assert ((score >= 0.3) == y).mean() >= 0.95 and score.min() >= 0 and score.max() <= 1
    odd_labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (8, None), (None, 1)], "doc_id long, quality int")
    rows = quality_knn.quality_scores(odd, odd_labels, F.lit(True), keep=odd.columns, score_col="__score")
    assert rows.columns == [*odd.columns, "__score"] and rows.where("__score between 0 and 1").count() == len(ODD)
    assert {r["score"] for r in quality_knn.quality_scores(odd.select("doc_id", "text"), odd_labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality_knn.quality_scores(none, labels, train, keep=["lang"]).count() == 0


def test_toxicity_on_held_out_rows_and_misspellings(spark, odd, none):
    folder = f"{SMALL}/../sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train = labelled.fold("doc_id", 4) != 2
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), labels, train)
    score, y = held_out(spark, scored, "toxic", train)
    pairs = score[y == 1][:, None] - score[y == 0][None]
    assert (pairs > 0).mean() >= 0.9
    rows = [(i, f"the plain {'horrid' if i % 4 == 0 else 'lovely'} thing number {i} goes on") for i in range(400)]
    toxic = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    unseen = [(1000, "the plain horridd thing number goes on"), (1001, "the plain lovelyy thing number goes on")]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(spark.createDataFrame(rows + unseen, "doc_id long, text string"), toxic, F.col("doc_id") < 400).collect()}
    assert got[1000] > 0.5 > got[1001]
    odd_rows = toxicity.toxicity_scores(odd, toxic, F.lit(True), keep=odd.columns, score_col="__score")
    assert odd_rows.where("__score between 0 and 1").count() == len(ODD)
    assert toxicity.toxicity_scores(none, labels, train).count() == 0


# pages


def test_text_of_pages(spark):
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body class="with-sidebar"><header><h1>Site</h1></header>'
        '<div id="cookie-notice">We use cookies</div><div class="page-with-sidebar"><article><h1>A &lt; B</h1><p>One\n two<p class="ad">buy<p>Three&nbsp;x <b>y</b>z'
        '<section class="comments"><p>nice</p></section><table><tr><td>c1<td>c2</table></article></div><aside>s</aside><footer>f</footer>'
    )
    no_article = "<body><div>Shared head</div><p>Own {0}</p><div>Shared foot</div></body>"
    rows = [
        (1, "http://h.x/a/1", page), (2, "http://g.x/b/1", no_article.format("one")), (3, "http://g.x/b/2?q", no_article.format("two")),
        (4, "http://g.x/b/2?q", None), (5, None, "<p>lonely"), (6, "not a url", ""), (6, "not a url", ""), (None, "http://z.x/", "<p>cut <b>off &am"),
        (7, "http://y.x/long", "<p>" + "word " * 200_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert got[1]["text"] == "A < B\n\nOne two\n\nThree x yz\n\nc1\n\nc2"
    assert got[2]["text"] == "Own one" and got[2]["n_shared"] == 2 and got[2]["near_id"] in (3, 4)
    assert got[4]["text"] == "" and got[5]["text"] == "lonely" and got[None]["text"] == "cut off &am" and got[7]["n_chars"] == 999_999
    assert html_text.extract_text(df).count() == len(rows) and html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<p>one</p><svg/><p>two</p>", ["one", "two"]), ('<p>one <svg class="i"/>x</p><math/><p>two</p>', ["one x", "two"]),
    ("<p>a<math><mi>x</mi><annotation>tex</annotation></math>b</p>", ["axb"]), ("<svg><title>t</title><style/><desc>d</desc><path/></svg><p>two</p>", ["two"]),
    ("<svg><p>one</p><script>no()</script><p>two</p>", ["one", "two"]), ("<noscript><p>one</p></noscript><object><p>two</p></object><canvas>three</canvas>", ["one", "two", "three"]),
    ("<p>one</p><style>no</style><template><p>no</p></template><p>two</p>", ["one", "two"]),
])
def test_only_what_is_never_shown_is_skipped(page, want):
    assert [t for _, t in html_text.lines(f"<article>{page}</article>")] == want


def plain_pairs(rows):
    """near_id of every page from a plain sort by host, path and identifier."""
    order = sorted((url.split("/")[2], url[len("http://") + len(url.split("/")[2]) :], i) for i, url, _ in rows)
    out = {}
    for k, (host, path, i) in enumerate(order):
        beside = [o for o in (order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None) if o and o[0] == host]
        out[i] = max(beside, key=lambda o: len(os.path.commonprefix([path, o[1]])))[2] if beside else None
    return out


@pytest.mark.parametrize("parts", ["1", "4", "13", "400"])
def test_pages_of_a_large_host_have_the_neighbours_of_a_plain_sort(spark, parts):
    rng = np.random.default_rng(5)
    page = "<body><div>Head {0}</div><p>Own {1}</p></body>"
    urls = [f"http://hot.x/en/{n}.html" for n in rng.permutation(6000)[:200]] + [f"http://hot.x/s/{''.join(rng.choice(list('abcdef'), 9))}-{n}" for n in range(150)]
    urls += [f"http://h{n}.x/a/{k}" for n in range(8) for k in range(n)]
    rows = [(int(i), u, page.format(i % 3, i)) for i, u in zip(rng.permutation(len(urls)), urls)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows) and {r["page_id"]: r["near_id"] for r in got} == plain_pairs(rows)


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(300):
        one, two = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        table = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
        for i, x in enumerate(one):
            for j, y in enumerate(two):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = html_text.shared(one, two)
        assert sum(found) == table[-1][-1]
        rest = iter(two)
        assert all(x in rest for x, f in zip(one, found) if f)


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
        import html as h

        plain = [" ".join(h.unescape(re.sub(r"<[^>]*>?", " " if False else "", b.replace("<br>", " "))).split()) for b in blocks]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in plain if b), r["page_id"]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
