"""Detectors with a fit / transform split: the KPI detector (isolation forest on features) and
the log detector (random forest on the occurrence matrix)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import best_threshold
from .forest import SAMPLE, SEED, TREES, IsolationForest, IsolationForestModel


@dataclass(frozen=True)
class KpiDetector:
    features: tuple[str, ...]
    row_id: tuple[str, ...]
    trees: int = TREES
    sample: int = SAMPLE
    seed: int = SEED
    threshold: float = 0.6
    model_name: str = "kpi-baseline"

    def fit(self, df: DataFrame, label: str | None = None) -> IsolationForestModel:
        """Grows the forest without labels; given a label column, the threshold is the one with
        the best F1 on the training rows."""
        forest = IsolationForest(self.features, self.trees, self.sample, self.seed, self.threshold)
        model = forest.fit(df, self.row_id)
        if label is None:
            return model
        tuned = best_threshold(model.transform(df), label, "score").first()
        threshold = tuned["threshold"] if tuned else self.threshold
        return IsolationForestModel(model.features, model.nodes, model.sample, threshold)


def held_out(key: str, folds: int = 5) -> Column:
    """Whether a row is one of the ``1 / folds`` that no model may learn from, by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit("held out"), F.col(key)), F.lit(folds)) == 0


@dataclass(frozen=True)
class LogDetector:
    """A random forest on count columns (``events``) or on a vector column (``vector``)."""

    events: tuple[str, ...] = ()
    trees: int = 20
    depth: int = 5
    seed: int = SEED
    model_name: str = "log-baseline"
    vector: str | None = None

    def pipeline(self, label: str):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        columns = [] if self.vector else [VectorAssembler(inputCols=list(self.events), outputCol="_features")]
        return Pipeline(stages=[
            *columns,
            RandomForestClassifier(
                labelCol=label, featuresCol=self.vector or "_features", predictionCol="_prediction",
                probabilityCol="_probability", rawPredictionCol="_raw",
                numTrees=self.trees, maxDepth=self.depth, seed=self.seed,
            ),
        ])

    def fit(self, matrix: DataFrame, label: str = "label") -> LogDetectorModel:
        return LogDetectorModel(self.pipeline(label).fit(matrix))

    def tune(
        self, matrix: DataFrame, label: str = "label", depths: Sequence[int] = (3, 5, 8),
        folds: int = 3,
    ) -> LogDetectorModel:
        """Picks the tree depth by cross-validated area under the ROC curve."""
        from pyspark.ml.evaluation import BinaryClassificationEvaluator
        from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

        pipeline = self.pipeline(label)
        grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].maxDepth, list(depths)).build()
        evaluator = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="_raw")
        search = CrossValidator(
            estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator,
            numFolds=folds, seed=self.seed,
        )
        return LogDetectorModel(search.fit(matrix).bestModel)


class LogDetectorModel:
    def __init__(self, fitted):
        self.fitted = fitted

    def save(self, path: str) -> None:
        """The fitted pipeline, trees as Parquet; a model that was there before is replaced."""
        self.fitted.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> LogDetectorModel:
        from pyspark.ml import PipelineModel

        return cls(PipelineModel.load(path))

    def transform(self, matrix: DataFrame) -> DataFrame:
        """Appends ``score`` (probability of an anomaly) and ``prediction``."""
        from pyspark.ml.functions import vector_to_array

        scored = self.fitted.transform(matrix)
        return scored.select(
            *matrix.columns,
            vector_to_array("_probability")[1].alias("score"),
            F.col("_prediction").cast("int").alias("prediction"),
        )
