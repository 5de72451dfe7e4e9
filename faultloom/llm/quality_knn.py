"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import mixed, ship, text_slices, unused, word_hashes, words_of
from faultloom.llm.labelled import sample

#: Hashed terms: shapes of four characters, three bytes of text, and what happens from word to word.
SHAPES, CHARS, EVENTS = 2048, 1984, 64
TERMS = SHAPES + CHARS + EVENTS
#: Labelled rows of each class at most, latent dimensions, neighbours, and the power of their similarity.
PER_CLASS, DIMENSIONS, NEIGHBOURS, POWER = 2000, 48, 15, 8

_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def _grams(codes: np.ndarray, row_of: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(257) + codes[k : len(codes) - n + 1 + k]
    inside = row_of[: len(h)] == row_of[n - 1 :]
    return row_of[: len(h)][inside], (mixed(h[inside]) % np.uint64(size)).astype(np.int64)


def terms(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of each family's terms, one row a text."""
    rows = len(bounds) - 1
    out = np.zeros((rows, TERMS), np.float32)
    row_of = np.repeat(np.arange(rows), np.diff(bounds))
    at = 0
    for codes, n, size in ((_SHAPE[data], 4, SHAPES), (data.astype(np.uint64), 3, CHARS)):
        of, term = _grams(codes, row_of, n, size)
        out[:, at : at + size] = np.bincount(of * size + term, minlength=rows * size).reshape(rows, size)
        at += size
    start, end, row = words_of(data, bounds)
    h = word_hashes(data, start, end)
    order = np.lexsort((h, row))
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])))
        event = np.where(same, 0, np.where(again, 1, 2))
    else:
        event = np.full(len(h), 2)
    counts = np.bincount(row * 3 + event, minlength=rows * 3).reshape(rows, 3) if len(h) else np.zeros((rows, 3))
    out[:, at : at + 3] = counts
    out[np.arange(rows), at + 3 + np.minimum(np.log2(np.diff(bounds) + 1).astype(int), EVENTS - 4)] = 0.1 * np.maximum(counts.sum(axis=1), 1)
    for a, b in ((0, SHAPES), (SHAPES, SHAPES + CHARS), (SHAPES + CHARS, TERMS)):
        out[:, a:b] = np.sqrt(out[:, a:b] / np.maximum(out[:, a:b].sum(axis=1, keepdims=True), 1e-9))
    return out


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text_slices(batch.column(2)):
            rows = [r.tobytes() for r in terms(data, bounds).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(1).slice(a, b - a), pa.array(rows, pa.binary())], names=["id", "y", "terms"])


def fit(x: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(projection of terms to latent dimensions, unit latent vectors of the rows of x), by a seeded randomised SVD.

    x is weighted in place.
    """
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    w = x
    w *= idf
    d = min(dimensions, *x.shape)
    probe = np.random.default_rng(0).standard_normal((x.shape[1], min(d + 16, x.shape[1]))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(w @ probe)
        probe = w.T @ q
    _, _, v = np.linalg.svd(q.T @ w, full_matrices=False)
    return (idf[:, None] * v[:d].T).astype(np.float32), unit(w @ v[:d].T)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def votes(vectors: np.ndarray, known: np.ndarray, y: np.ndarray, share: float, block: int = 512) -> np.ndarray:
    """Share of label 1 among the nearest known vectors, weighted by a power of the cosine; `share` without any."""
    out = np.empty(len(vectors))
    k = min(NEIGHBOURS, len(known))
    for a in range(0, len(vectors), block):
        cos = vectors[a : a + block] @ known.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(known) else np.tile(np.arange(k), (len(cos), 1))
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        out[a : a + block] = np.where(total > 0, (weight * y[near]).sum(axis=1) / np.where(total > 0, total, 1), share)
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                   label: str = "quality", keep: list[str] | None = None, per_class: int = PER_CLASS,
                    score_col: str = "score") -> DataFrame:
    """(doc_id, score, *keep) of every document: the weighted share of label 1 among its nearest labelled vectors.

    At most `per_class` labelled rows of each label (those with the smallest hash of the identifier) are turned
    into term vectors on the executors; the latent space is fitted to them on the driver. Model and labelled
    vectors are bounded by these parameters (about 1.6 MB) and go to every task, where cosines of all documents
    with all labelled vectors are exact products of blocks.

    NULL texts count as empty; an empty text has the vector of its length alone. Without labelled rows every
    score is 0.5, with rows of one label only it is that label. Columns in `keep` are passed through;
    the score, the last column, is called _<score_col> if one of them has its name. Texts are read whole, very
    long ones in slices; rows that repeat come out repeated, with one score; of equally near or equally hashed
    rows the choice is fixed by their order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    score_col = unused(keep or [], score_col)
    chosen, _ = sample(docs, labels, label, train, per_class, id_col, text_col)
    got = chosen.mapInArrow(_term_rows, "id long, y int, terms binary").orderBy("id", "terms").collect()
    y = np.array([r["y"] for r in got], np.float64)
    if got:
        x = np.frombuffer(b"".join(r["terms"] for r in got), np.float16).reshape(-1, TERMS).astype(np.float32)
        del got
        project, known = fit(x)
    else:
        project, known, y = np.zeros((TERMS, 1), np.float32), np.zeros((1, 1), np.float32), np.array([0.5])
    share = float(y.mean())
    model = spark.sparkContext.broadcast((project, known, y, share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, known, y, share = model.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, bounds in text_slices(batch.column(0)):
                scores.append(votes(unit(terms(data, bounds) @ project), known, y, share))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.clip(np.concatenate(scores), 0, 1))], names=[*batch.schema.names[1:], score_col])

    names = [*([id_col] if id_col not in (keep or []) else []), *(keep or [])]
    rows = docs.select(F.col(text_col).cast("string").alias(unused(names, "text")), *[F.col(f"`{c}`") for c in names])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = rows.mapInArrow(score, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{score_col}` double"]))
    return out
