"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm.common import gram_hashes, ship, text_slices, unused, word_hashes, words_of

#: Words of a seed; scores of a match, a mismatch and a gap; share of the best score from which a passage counts.
SEED, MATCH, MISMATCH, GAP, THRESHOLD = 3, 2, -1, -1, 0.5
#: A seed is rare if words drawn by their corpus frequencies would give it less often than this per word of text.
RARE = 1e-7
#: Test items of one pass over the documents, which bounds what is broadcast.
ITEMS = 5_000

_OTHER = np.ones(256, dtype=bool)
_OTHER[ord("0") : ord("9") + 1] = False
_OTHER[ord("a") : ord("z") + 1] = False
_OTHER[128:] = False


def _hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, row bounds in words); words are letters and digits in lower case."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for a, b, data, bounds in text_slices(pc.utf8_lower(texts.fill_null(""))):
        start, end, row = words_of(data, bounds, _OTHER)
        yield a, b, word_hashes(data, start, end), np.searchsorted(row, np.arange(b - a + 1))


class Items:
    """A block of test items with their seeds, small enough to go to every task."""

    def __init__(self, ids: list[int], words: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray, total: int):
        self.ids, self.words = ids, words
        share = {int(w): (int(c) + 1) / (total + 1) for w, c in zip(vocabulary, counts)}
        seeds, owners, offsets = [], [], []
        for k, w in enumerate(words):
            n = min(SEED, len(w))
            h = gram_hashes(w, n, seed=0 if n == SEED else n)
            p = np.array([np.prod([share[int(x)] for x in w[i : i + n]]) for i in range(len(h))])
            rare = np.flatnonzero(p < RARE)
            if not len(rare):  # an item of common words only is sought by all of its n-grams
                rare = np.arange(len(h))
            seeds.append(h[rare])
            owners.append(np.full(len(rare), k))
            offsets.append(rare)
        seed, owner, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, owners, offsets))
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner, self.offset = seed[order].astype(np.uint64), owner[order], offset[order]
        self.lengths = sorted({min(SEED, len(w)) for w in words})
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True


def align(one: np.ndarray, two: np.ndarray) -> tuple[int, int]:
    """(best Smith-Waterman score, end in two) of two word sequences with linear gaps; one row of cells at a time."""
    best, end = 0, 0
    above = np.zeros(len(one) + 1, np.int64)
    slope = np.arange(len(one) + 1) * -GAP
    for j, word in enumerate(two):
        row = np.zeros(len(one) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(one == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope  # gaps along the row
        top = int(row.max())
        if top > best:
            best, end = top, j + 1
        above = row
    return best, end


def _found(words: np.ndarray, bounds: np.ndarray, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, words) of every passage that aligns with an item well enough."""
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at, entry = [], []
    for n in items.lengths:
        h = gram_hashes(words, n, seed=0 if n == SEED else n)
        place = np.flatnonzero(items.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = place[row_of[place] == row_of[place + n - 1]]
        lo, hi = (np.searchsorted(items.seed, h[place], side=s) for s in ("left", "right"))
        many = hi - lo
        at.append(np.repeat(place, many))
        entry.append(np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    at, entry = np.concatenate(at or [np.zeros(0, int)]).astype(int), np.concatenate(entry or [np.zeros(0, int)]).astype(int)
    row, owner = row_of[at], items.owner[entry]
    begin = at - items.offset[entry]
    order = np.lexsort((begin, owner, row))
    row, owner, begin, at = row[order], owner[order], begin[order], at[order]
    lengths = np.array([len(w) for w in items.words] or [0])
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (begin[1:] - begin[:-1] > lengths[owner[1:]])
    firsts = np.flatnonzero(new)
    out = []
    for a, b in zip(firsts, np.append(firsts[1:], len(row))):
        k, r = int(owner[a]), int(row[a])
        item = items.words[k]
        pad = len(item) // 4 + 2
        seeds = np.sort(at[a:b])
        parts = [(max(int(begin[a]) - pad, int(bounds[r])), min(int(begin[b - 1]) + len(item) + pad, int(bounds[r + 1])))]
        while parts:  # the best passage, then what is left before and after it, as long as seeds lie there
            lo, hi = parts.pop()
            if hi - lo < threshold * len(item) or np.searchsorted(seeds, lo) == np.searchsorted(seeds, hi):
                continue
            best, end = align(item, words[lo:hi])
            score = best / (MATCH * len(item))
            if score >= threshold:
                _, back = align(item[::-1], words[lo : lo + end][::-1])
                out.append((r, k, score, lo + end - back - int(bounds[r]), back))
                parts += [(lo, lo + end - back), (lo + end, hi)]
    return out


def _blocks(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str):
    """Broadcast blocks of test items, with the corpus frequencies of their words."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("t")).where("id is not null and t is not null")
    last = None
    while True:
        block = (rows if last is None else rows.where((F.col("id") > last[0]) | ((F.col("id") == last[0]) & (F.col("t") > F.lit(last[1]))))).distinct().orderBy("id", "t").limit(ITEMS).collect()
        if not block:
            return
        last = (block[-1]["id"], block[-1]["t"])
        ids, words = [], []
        for a, b, w, bounds in _hashed(pa.array([r["t"] for r in block], pa.string())):
            for r in range(b - a):
                if bounds[r + 1] > bounds[r]:
                    ids.append(block[a + r]["id"])
                    words.append(w[bounds[r] : bounds[r + 1]].copy())
        vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        sent = spark.sparkContext.broadcast(vocabulary)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            sums, total = np.zeros(len(known) + 1, np.int64), 0
            for batch in batches:
                for _, _, w, _ in _hashed(batch.column(0)):
                    total += len(w)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                        sums += np.bincount(np.where(known[at] == w, at, len(known)), minlength=len(known) + 1)
            used = np.flatnonzero(sums[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(sums[used], total))], names=["word", "n"])

        counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counts = {r["word"]: r["n"] for r in counted.collect()}  # as many rows as the block has words
        table = Items(ids, words, vocabulary, np.array([counts.get(k, 0) for k in range(len(vocabulary))]), counts.get(-1, 0))
        yield spark.sparkContext.broadcast(table)
        if len(block) < ITEMS:
            return


def benchmark_matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, n_words) of every passage that copies a test item.

    Words are runs of letters and digits in lower case. Seeds are an item's sequences of three words that are
    rare: the product of their words' frequencies, counted over the whole corpus, is below RARE (so a passage
    planted many times stays rare). Where a document has seeds of an item on nearby diagonals, the passage
    around them is aligned with the item; score is the Smith-Waterman score (match 2, mismatch and gap -1) as
    a share of the item's perfect score, so changed, added and dropped words each cost their part. Every seed
    starts an alignment, a single one too. A document may hold several passages of one item, also back to back;
    each is a row: beside the best one, the words before and after it are aligned again as long as they hold
    seeds and reach the threshold. Of equally good alignments the one that ends first counts.

    Items go to the tasks in blocks of bounded size, one pass over the documents each; no rows are shuffled.
    NULL or empty texts and items match nothing, equal items match alike; items without identifier are
    ignored, documents without one are reported with NULL. Texts are read whole, very long ones in a slice of
    their own; repeated rows give their rows each. Empty tables give no rows. Other columns are ignored.
    """
    out = None
    for sent in _blocks(docs, items, text_col, item_col, item_text_col):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = sent.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for a, _, words, bounds in _hashed(batch.column(1)):
                    rows += [(ids[a + r], table.ids[k], s, f, n) for r, k, s, f, n in _found(words, bounds, table, threshold)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "first_word", "n_words"])

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
            search, "doc_id long, item_id long, score double, first_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, n_words long")
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those that hold a copy of a test item (see benchmark_matches), all columns as they were."""
    kept = docs
    for sent in _blocks(docs, items, text_col, item_col, item_text_col):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for a, _, words, bounds in _hashed(batch.column(0).cast(pa.string())):
                    for r, *_ in _found(words, bounds, sent.value, threshold):
                        bad[a + r] = True
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(~bad)) for c in batch.columns[1:]], schema=pa.schema([*batch.schema][1:]))

        kept = kept.select(F.col(text_col).cast("string").alias(unused(docs.columns, "text")), "*").mapInArrow(clean, docs.schema)
    return kept
