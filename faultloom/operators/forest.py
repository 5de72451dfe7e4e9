"""Isolation forest: unsupervised anomaly scores for feature rows.

The forest is small by construction (``trees`` trees over ``sample`` rows each), so Spark draws
the samples and grows one tree per group, and every executor scores its own rows in Arrow batches
against the finished forest. Samples are chosen by a seeded hash of the row, so a recomputed task
draws the same rows.

Scores follow the published definition: 2 ** (-mean path length / c(sample size)).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Executors get the tree functions with the task, whether or not this package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 100
SAMPLE = 256
SEED = 42
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, path double"


def mean_path(rows):
    """Average path length of an unsuccessful search in a tree over ``rows`` rows."""
    n = np.maximum(np.asarray(rows, dtype="float64"), 2.0)
    full = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(np.asarray(rows) > 2, full, np.where(np.asarray(rows) == 2, 1.0, 0.0))


def grow_tree(tree: int, points: np.ndarray, limit: int, seed: int) -> pd.DataFrame:
    """One isolation tree as a node table. Leaves have ``feature`` -1 and carry their expected
    path length."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    pending = [(np.arange(len(points)), 0, None)]
    while pending:
        rows, depth, slot = pending.pop()
        node = len(nodes)
        if slot is not None:
            nodes[slot[0]][slot[1]] = node
        low = points[rows].min(axis=0)
        high = points[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(usable) == 0:
            nodes.append([tree, node, -1, 0.0, node, node, depth + float(mean_path(len(rows)))])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = points[rows, feature] <= cut
        nodes.append([tree, node, feature, cut, node, node, 0.0])
        pending.append((rows[below], depth + 1, (node, 4)))
        pending.append((rows[~below], depth + 1, (node, 5)))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "path"])


def tree_arrays(nodes: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """The node table as arrays for each tree."""
    return [
        tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
        for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")
    ]


def _points(columns: Sequence[pd.Series]) -> np.ndarray:
    return np.nan_to_num(np.column_stack([c.to_numpy(dtype="float64") for c in columns]), nan=0.0)


def mean_depths(points: np.ndarray, trees: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The path length of every point, averaged over the trees."""
    total = np.zeros(len(points))
    row = np.arange(len(points))
    for feature, cut, left, right, path in trees:
        at = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            below = points[row, feature[at]] <= cut[at]
            at = np.where(inner, np.where(below, left[at], right[at]), at)
        total += path[at]
    return total / len(trees)


@dataclass(frozen=True)
class IsolationForestModel:
    features: tuple[str, ...]
    nodes: pd.DataFrame
    sample: int
    threshold: float

    def save(self, spark: SparkSession, path: str) -> None:
        """The node table as Parquet beside the settings; see ``load``."""
        from .saved import write_model

        settings = {"features": list(self.features), "sample": self.sample, "threshold": self.threshold}
        nodes = spark.createDataFrame(self.nodes, NODE_SCHEMA)
        write_model(spark, path, "isolation forest", settings, {"nodes": nodes})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForestModel:
        from .saved import read_settings, read_table

        settings = read_settings(spark, path, "isolation forest")
        nodes = read_table(spark, path, "nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
        return cls(tuple(settings["features"]), nodes, settings["sample"], settings["threshold"])

    def transform(self, df: DataFrame) -> DataFrame:
        """Appends ``score`` in (0, 1] and ``prediction`` (1 at or above the threshold)."""
        trees = tree_arrays(self.nodes)
        scale = float(mean_path(self.sample)) or 1.0

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                columns = [columns] if isinstance(columns, pd.Series) else columns
                yield pd.Series(np.power(2.0, -mean_depths(_points(columns), trees) / scale))

        inputs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features]
        scored = df.withColumn("score", score(*inputs))
        return scored.withColumn("prediction", (F.col("score") >= self.threshold).cast("int"))


def _tree(trees: Column) -> Column:
    """The tree a drawn row goes to, from its hash and the deal."""
    return F.pmod(F.pmod(F.xxhash64("_hash"), trees) + F.col("_deal"), trees).cast("int").alias("tree")


@dataclass(frozen=True)
class IsolationForest:
    """``fit`` counts the table and draws from it once; the driver only ever sees the node table,
    at most ``trees * 2 * sample`` rows."""

    features: tuple[str, ...]
    trees: int = TREES
    sample: int = SAMPLE
    seed: int = SEED
    threshold: float = 0.6

    def draw(self, df: DataFrame, row_id: Sequence[str]) -> DataFrame:
        """``tree`` plus features: about ``sample`` rows per tree, none twice in a tree.

        The ``trees * sample`` rows with the smallest hashes are dealt out to the trees; a table
        with fewer rows is dealt out several times, each time shifted by one tree. The row count
        gives a hash bound that about four times the wanted rows pass, so the top-k never merges
        candidates from every input split.
        """
        wanted = self.trees * self.sample
        rows = df.count()
        deals = min(self.trees, -(-wanted // max(rows, 1)))
        deal = F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))
        chosen = self._chosen(df, row_id, wanted, rows).withColumn("_deal", deal)
        return chosen.select(_tree(F.lit(self.trees)), *self.features)

    def _chosen(self, df: DataFrame, row_id: Sequence[str], wanted: int, rows: int) -> DataFrame:
        """The ``wanted`` rows with the smallest hashes, with their ``_hash``."""
        bound = min(int(-(2**63) + min(1.0, 4.0 * wanted / max(rows, 1)) * 2**64), 2**63 - 1)
        inputs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in self.features]
        ids = [F.col(c) for c in row_id]
        return (
            df.select(*inputs, F.xxhash64(*ids, F.lit(self.seed)).alias("_hash"))
            .where(F.col("_hash") <= bound)
            .orderBy("_hash")
            .limit(wanted)
        )

    def fit(self, df: DataFrame, row_id: Sequence[str]) -> IsolationForestModel:
        features, seed = list(self.features), self.seed
        limit = int(np.ceil(np.log2(max(self.sample, 2))))

        def grow(key, rows):
            points = rows.sort_values(features)[features].to_numpy(dtype="float64")
            return grow_tree(int(key[0]), points, limit, seed).assign(
                size=len(points)
            )

        grown = (
            self.draw(df, row_id)
            .groupBy("tree")
            .applyInPandas(grow, f"{NODE_SCHEMA}, size int")
            .toPandas()
        )
        if grown.empty:
            raise ValueError("the training table has no rows")
        size = int(round(grown.groupby("tree")["size"].first().mean()))
        return IsolationForestModel(self.features, grown.drop(columns="size"), size,
                                    self.threshold)

    def tune(
        self, df: DataFrame, row_id: Sequence[str], label: str, grid: Sequence[tuple[int, int]]
    ) -> tuple[IsolationForestModel, DataFrame]:
        """The (trees, sample) pair of ``grid`` with the largest exact ROC area, as a model, and the
        areas: ``trees, sample, auc`` (NULL if ``label`` has one class only). Ties go to the pair
        that comes first; each forest is the one ``fit`` would grow.

        The table is counted and drawn from once, all forests grow in one grouped job with the pair
        as part of the key, and one pass scores every row with all of them.
        """
        from .evaluate import roc_auc

        grid = list(dict.fromkeys((int(t), int(n)) for t, n in grid))
        features, seed = list(self.features), self.seed
        rows = df.count()
        pairs = F.array(*[
            F.struct(F.lit(i).alias("pair"), F.lit(t).alias("trees"), F.lit(t * n).alias("wanted"),
                     F.lit(min(t, -(-(t * n) // max(rows, 1)))).alias("deals"))
            for i, (t, n) in enumerate(grid)
        ])
        # At most the largest trees * sample rows are left here, so one task may number them.
        place = F.row_number().over(Window.orderBy("_hash", *features))
        drawn = (
            self._chosen(df, row_id, max(t * n for t, n in grid), rows)
            .withColumn("_place", place)
            .withColumn("_pair", F.explode(pairs))
            .where(F.col("_place") <= F.col("_pair.wanted"))
            .withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_pair.deals") - 1)))
            .select(F.col("_pair.pair").alias("pair"), _tree(F.col("_pair.trees")), *features)
        )
        limits = [int(np.ceil(np.log2(max(n, 2)))) for _, n in grid]

        def grow(key, part):
            points = part.sort_values(features)[features].to_numpy(dtype="float64")
            nodes = grow_tree(int(key[1]), points, limits[int(key[0])], seed)
            return nodes.assign(size=len(points), pair=int(key[0]))

        grown = drawn.groupBy("pair", "tree").applyInPandas(
            grow, f"{NODE_SCHEMA}, size int, pair int").toPandas()
        if grown.empty:
            raise ValueError("the training table has no rows")
        nodes = [grown[grown["pair"] == i] for i in range(len(grid))]
        sizes = [int(round(t.groupby("tree")["size"].first().mean())) for t in nodes]
        forests = [(tree_arrays(t), float(mean_path(n)) or 1.0) for t, n in zip(nodes, sizes)]

        @F.pandas_udf("array<double>")
        def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                columns = [columns] if isinstance(columns, pd.Series) else columns
                points = _points(columns)
                each = [np.power(2.0, -mean_depths(points, trees) / scale) for trees, scale in forests]
                yield pd.Series(list(np.column_stack(each)))

        inputs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
        scored = df.select(F.col(label).alias("y_true"), F.posexplode(scores(*inputs)).alias("pair", "score"))
        found = {r["pair"]: r["auc"] for r in roc_auc(scored, keys=["pair"]).collect()}
        best = max(range(len(grid)), key=lambda i: (found.get(i) is not None, found.get(i) or 0.0, -i))
        areas = df.sparkSession.createDataFrame(
            [(*grid[i], found.get(i)) for i in range(len(grid))], "trees int, sample int, auc double")
        kept = nodes[best].drop(columns=["size", "pair"])
        return IsolationForestModel(self.features, kept, sizes[best], self.threshold), areas
