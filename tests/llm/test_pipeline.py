"""The stages of the corpus pipeline: each held against brute force on its own input, and on odd tables."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from test_text_operators import LONG, NEAR, brute_components, full_alignment

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "__text string, __kept int, __id int, __keep string, score double, repeats int, size string"


def stages():
    return dict(corpus_pipeline.STAGES)


def test_order_of_the_stages():
    assert list(stages()) == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "mixing"]


def test_stages_equal_brute_force(spark):
    """Each stage, on what the one before it kept of the given documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    scored = stages()["quality_classifier"](spark, docs, SMALL).persist()
    assert scored.columns == columns
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in scored.collect()}
    held = {d for d in known if __import__("zlib").crc32(str(d).encode()) % 5 == 0}
    right = [(d in kept) == bool(known[d]) for d in known]
    assert sum(right) >= 0.9 * len(right) and held
    assert all(d in kept for d in known if known[d] == 1 and d not in held)

    exact = stages()["exact_dedup"](spark, scored, SMALL).persist()
    first = {}
    for r in scored.collect():
        first[r["text"]] = min(r["doc_id"], first.get(r["text"], r["doc_id"]))
    assert {r["doc_id"] for r in exact.collect()} == set(first.values()) and exact.columns == columns

    near = stages()["minhash_near_dedup"](spark, exact, SMALL).persist()
    groups = brute_components([(r["doc_id"], r["text"]) for r in exact.collect()], 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {d for d, (_, c) in groups.items() if d == c} and near.columns == columns

    clean = stages()["benchmark_decontamination"](spark, near, SMALL).persist()
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in items]
    stay = set()
    for r in near.collect():
        w = plain(r["text"])
        mine = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        if not any(g & mine and full_alignment(item, w) >= 0.5 * 2 * len(item) for item, g in zip(items, grams)):
            stay.add(r["doc_id"])
    assert {r["doc_id"] for r in clean.collect()} == stay and clean.columns == columns

    mixed = stages()["mixing"](spark, clean, SMALL).collect()
    taken, sizes, target = defaultdict(int), defaultdict(int), {}
    of = {r["doc_id"]: (r["source"], len((r["text"] or "").encode().split())) for r in clean.collect()}
    for s, n in of.values():
        sizes[s] += n
    for r in mixed:
        source, n = of[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (n, sizes[source], n * r["repeats"]) and 1 <= r["repeats"] <= 2
        taken[source] += r["taken"]
        target[source] = r["target"]
    longest = max(n for _, n in of.values())
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    labels = [(1, 1, 0), (2, 0, 0), (2, 1, None), (8, None, 1), (None, 1, 1), (7, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "one"), (3, " ".join(f"q{i}" for i in range(12)))], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


def test_exact_stage_of_partitions_of_several_batches(spark):
    """Partitions of 12,500 rows come to Python as more than one batch each."""
    docs = spark.range(0, 25_000, 1, 2).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 8000).cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    got = stages()["exact_dedup"](spark, docs, SMALL).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(i, f"text {i}") for i in range(8000)]


def odd_rows():
    seed = " ".join(f"q{i}" for i in range(12))
    return [
        (1, NEAR, "en", "a", 1), (2, NEAR, "en", "a", None), (2, NEAR, "en", "a", None), (3, NEAR + " more", None, None, 3),
        (4, None, "en", "b", 4), (5, "", "de", "b", 5), (6, " \t\n ", None, "b", 6), (7, LONG, "en", None, 7), (8, "one", "en", "c", 8),
        (None, "no identifier here", "en", "c", 9), (10, f"copy of {seed} it", "en", "c", 9), (9, "Ünïcode 😀 " * 30, "en", "c", 9)]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, folder, stage):
    rows = [(*r, None, 1, 2, "k", 0.5, 3, "s") for r in odd_rows()]
    docs = spark.createDataFrame(rows, f"{DOCUMENTS}, {CLASHING}")
    out = stages()[stage](spark, docs, folder)
    found = out.collect()
    texts = [r["text"] for r in found]
    if stage != "mixing":
        assert out.columns == docs.columns and all(tuple(r) in set(rows) for r in found)
    if stage == "exact_dedup":
        assert len(found) == len({r[1] or "" for r in rows})
    if stage == "minhash_near_dedup":
        assert NEAR + " more" not in texts and len(found) in (len(rows) - 2, len(rows) - 3)
    if stage == "benchmark_decontamination":
        assert len(found) == len(rows) - 1 and not any("q5" in (t or "") for t in texts)
    if stage == "mixing":
        assert {"mix_repeats", "mix_size", "repeats", "size", "text", "__kept"} <= set(out.columns)
    none = stages()[stage](spark, docs.limit(0), folder)
    assert none.columns == out.columns and none.count() == 0


def test_whole_run(spark):
    """Rows of a run, written and read between stages: those of the stages in turn."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    want = docs.select("doc_id", "repeats", F.sha2("text", 256).alias("h")).collect()
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "repeats", F.sha2("text", 256).alias("h")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 50
    assert hashlib.sha256(b"").hexdigest() not in {r["h"] for r in got}
