"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import mixed, ship, unused
from faultloom.llm.labelled import sample

#: Lengths of character n-grams (word borders count as a character), hashed rows of the embedding table, its width.
GRAMS, BUCKETS, WIDTH = (3, 4, 5, 6), 1 << 17, 8
#: Labelled rows of each class at most, passes over them, rows a step, learning rate.
PER_CLASS, EPOCHS, STEP_ROWS, RATE = 1500, 12, 32, 0.5
SLICE_CHARS = 400_000


def _text_groups(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram of every word, in lower case, with one border at each end."""
    lower = [t.lower() for t in texts]
    whole = " " + " ".join(lower) + " "
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes = np.where(space, 32, codes).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    row = np.concatenate((row[:1], row)) if len(row) else np.zeros(len(codes), np.int64)
    upto = np.concatenate(([0], np.cumsum(space)))
    rows, buckets = [], []
    h = codes
    for n in range(2, max(GRAMS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n not in GRAMS or len(h) <= 0:
            continue
        inner = upto[n - 1 : len(codes)][: len(h)] - upto[1 : len(h) + 1]
        at = np.flatnonzero(inner == 0)
        rows.append(row[at + 1])
        buckets.append((mixed(h[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
    return np.concatenate(rows), np.concatenate(buckets)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y, buckets, counts) of rows (id, y, text)."""
    for batch in batches:
        out, texts = [], batch.column(2).to_pylist()
        for group in _text_groups(texts):
            of, bucket = grams(group)
            key, count = np.unique(of.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            cuts = np.searchsorted(key, np.arange(len(group) + 1, dtype=np.int64) * BUCKETS)
            out += [((key[a:b] % BUCKETS).astype(np.int32).tobytes(), count[a:b].astype(np.float32).tobytes()) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["id", "y", "buckets", "counts"])


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, odds: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight of every bucket, its share of the logit, bias): what scoring needs of embeddings and softmax.

    Embeddings and softmax are trained together by Adagrad on the cross entropy. An n-gram enters the average
    of its text with its count, weighted by how far apart its document frequencies in the two labels are (in
    standard errors), so that the many n-grams of ordinary words do not drown the few that tell. `odds`: log odds of label 1 among all
    rows less those of the sample; added to the bias, as the sample is taken by class.
    """
    seen = np.zeros(BUCKETS, np.float32)
    for b, _ in bags:
        seen[b] += 1
    with_1 = np.zeros(BUCKETS, np.float32)
    for (b, _), one in zip(bags, y):
        with_1[b] += one
    n_1, n_0 = float((y == 1).sum()), float((y == 0).sum())
    share = (seen + 1) / (len(bags) + 2)
    apart = np.abs((with_1 + 0.5) / (n_1 + 1) - (seen - with_1 + 0.5) / (n_0 + 1)) / np.sqrt(share * (1 - share) * (1 / n_1 + 1 / n_0))
    weight = np.where(seen > 1, np.maximum(apart - 1.5, 0) + 0.02, 0).astype(np.float32)
    rng = np.random.default_rng(0)
    table = rng.uniform(-0.5, 0.5, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    table[seen == 0] = 0
    soft, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    soft[:, 1] = rng.uniform(-0.5, 0.5, WIDTH)
    soft[:, 0] = -soft[:, 1]
    g_table, g_soft, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)
    target = np.eye(2, dtype=np.float32)[y.astype(int)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), STEP_ROWS):
            rows = [r for r in order[a : a + STEP_ROWS] if len(bags[r][0])]
            if not rows:
                continue
            b = np.concatenate([bags[r][0] for r in rows])
            c = np.concatenate([bags[r][1] for r in rows]) * weight[b]
            starts = np.cumsum([0] + [len(bags[r][0]) for r in rows])[:-1]
            size = np.repeat(np.maximum(np.add.reduceat(c, starts), 1e-9), [len(bags[r][0]) for r in rows])
            c = (c / size).astype(np.float32)
            mean = np.add.reduceat(table[b] * c[:, None], starts, axis=0)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - target[rows]) / len(rows)
            d_soft, d_bias, d_mean = mean.T @ d, d.sum(axis=0), d @ soft.T
            d_rows = np.repeat(d_mean, [len(bags[r][0]) for r in rows], axis=0) * c[:, None]
            used, inverse = np.unique(b, return_inverse=True)
            d_used = np.stack([np.bincount(inverse, weights=d_rows[:, k], minlength=len(used)) for k in range(WIDTH)], axis=1).astype(np.float32)
            g_table[used] += (d_used**2).mean(axis=1)
            table[used] -= RATE * d_used / np.sqrt(g_table[used])[:, None]
            g_soft += d_soft**2
            soft -= 0.1 * RATE * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= 0.1 * RATE * d_bias / np.sqrt(g_bias)
    return weight, (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0] + odds)


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text",
                    label: str = "toxic", keep: list[str] | None = None, per_class: int = PER_CLASS,
                    score_col: str = "score") -> DataFrame:
    """(doc_id, *keep, score) of every document: the softmax probability of label 1.

    At most `per_class` labelled rows of each label (those with the smallest hash of the identifier) are turned
    into bags of n-grams on the executors and trained on at the driver. A document's logit is a weighted mean
    over its n-grams, so the model that goes to every task is two numbers a bucket (1 MB).

    NULL texts count as empty; a text without known n-grams scores as the bias alone. Without labelled rows of
    both labels every score is the share of label 1, or 0 if there are none. Columns in `keep` are passed through;
    the score, the last column, is called _<score_col> if one of them has its name. Texts are read whole, very
    long ones in slices; rows that repeat come out repeated, with one score; of equally near or equally hashed
    rows the choice is fixed by their order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    score_col = unused(keep or [], score_col)
    chosen, counts = sample(docs, labels, label, train_rows, per_class, id_col, text_col)
    got = chosen.mapInArrow(_bags, "id long, y int, buckets binary, counts binary").orderBy("id", "buckets").collect()
    y = np.array([r["y"] for r in got])
    if len(set(y)) == 2:
        bags = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in got]
        odds = np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum())
        fitted = train(bags, y, float(odds))
    else:
        fitted = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 40.0 if len(y) and y[0] == 1 else -40.0
    model = spark.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, share, bias = model.value
        both = weight * share
        for batch in batches:
            scores = [np.zeros(0)]
            for group in _text_groups(batch.column(0).to_pylist()):
                of, bucket = grams(group)
                total = np.bincount(of, weights=weight[bucket], minlength=len(group))
                logit = np.bincount(of, weights=both[bucket], minlength=len(group)) / np.maximum(total, 1e-9) + bias
                scores.append(1 / (1 + np.exp(-np.clip(logit, -50, 50))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(scores))], names=[*batch.schema.names[1:], score_col])

    names = [*([id_col] if id_col not in (keep or []) else []), *(keep or [])]
    rows = docs.select(F.col(text_col).cast("string").alias(unused(names, "text")), *[F.col(f"`{c}`") for c in names])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return rows.mapInArrow(score, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{score_col}` double"]))
