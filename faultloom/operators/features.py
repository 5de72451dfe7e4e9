"""KPI features: cleaning, lags, rolling moments, calendar fields, scaling, feature report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import add_rolling
from .saved import read_settings, read_table, write_model
from .slices import ROWS_PER_SLICE, lookback_series

LAGS = (1, 5, 10)
WINDOWS = (5, 10)


def clean(
    df: DataFrame, ties: Sequence[str] = (), null_values: str = "drop", fill: float = 0.0
) -> DataFrame:
    """One row per (KPI ID, time), without NULL keys; NULL values are dropped, filled or kept.

    Of duplicate points the one with the smallest ``ties``, then value, stays. Duplicates collapse
    map-side.
    """
    kept = df.where(F.col("kpi_id").isNotNull() & F.col("event_time").isNotNull())
    if null_values == "drop":
        kept = kept.where(F.col("value").isNotNull())
    elif null_values == "fill":
        kept = kept.withColumn("value", F.coalesce("value", F.lit(float(fill))))
    elif null_values != "keep":
        raise ValueError(f"null_values must be drop, fill or keep, not {null_values!r}")
    rest = [c for c in df.columns if c not in ("kpi_id", "event_time", "value", *ties)]
    point = F.min(F.struct(*ties, "value", *rest)).alias("_point")
    return (
        kept.groupBy("kpi_id", "event_time").agg(point)
        .select("kpi_id", "event_time", "_point.*")
        .select(*df.columns)
    )


def add_calendar(df: DataFrame) -> DataFrame:
    """``hour_of_day`` and ``day_of_week`` (Monday is 0)."""
    return df.withColumns(
        {"hour_of_day": F.hour("event_time"), "day_of_week": F.weekday("event_time")}
    )


def add_series_features(
    df: DataFrame,
    ties: Sequence[str] = (),
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Lags and rolling mean / sample deviation per KPI over row frames ending at the row.

    A rolling figure is NULL until its frame is full of values. All of them share one window order
    and so one shuffle and one sort.
    """
    depth = max([*lags, *(n - 1 for n in windows)], default=0)
    series = lookback_series(df, ["kpi_id"], ["event_time", *ties], depth, rows_per_slice)
    rows = add_rolling(
        series.rows.withColumns({f"lag_{n}": F.lag("value", n).over(series.window) for n in lags}),
        series.window,
        "value",
        {f"_{n}": (0, n - 1) for n in windows},
    )
    named = {f"_{n}_{f}": f"rolling_{f}_{n}" for n in windows for f in ("mean", "std")}
    return series.finish(rows.withColumnsRenamed(named))


def kpi_features(
    df: DataFrame,
    ties: Sequence[str] = (),
    calendar: bool = True,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    featured = add_series_features(df, ties, rows_per_slice=rows_per_slice)
    return add_calendar(featured) if calendar else featured


def feature_columns(calendar: bool = True) -> list[str]:
    names = ["value", *[f"lag_{n}" for n in LAGS]]
    for n in WINDOWS:
        names += [f"rolling_mean_{n}", f"rolling_std_{n}"]
    return names + (["hour_of_day", "day_of_week"] if calendar else [])


def feature_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NULL count and extremes of each feature, from one aggregate: ``feature, nulls, min, max``."""
    per_feature = [
        F.struct(
            F.lit(f).alias("feature"),
            F.count_if(F.col(f).isNull()).alias("nulls"),
            F.min(F.col(f).cast("double")).alias("min"),
            F.max(F.col(f).cast("double")).alias("max"),
        )
        for f in features
    ]
    return df.agg(F.array(*per_feature).alias("_all")).select(F.inline("_all"))


@dataclass(frozen=True)
class FeatureScaler:
    """Standardisation learned on one table and applied to others; a few numbers per feature."""

    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> FeatureScaler:
        row = df.agg(
            *[F.avg(f).alias(f"m_{f}") for f in features],
            *[F.stddev_samp(f).alias(f"s_{f}") for f in features],
        ).first()
        return cls(
            {f: row[f"m_{f}"] for f in features},
            {f: row[f"s_{f}"] for f in features},
        )

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(f, self.means[f], self.deviations[f]) for f in self.means]
        table = spark.createDataFrame(rows, "feature string, mean double, deviation double")
        write_model(spark, path, "feature scaler", {"features": list(self.means)}, {"moments": table})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureScaler:
        order = read_settings(spark, path, "feature scaler")["features"]
        rows = {r["feature"]: r for r in read_table(spark, path, "moments").collect()}  # one a feature
        return cls({f: rows[f]["mean"] for f in order}, {f: rows[f]["deviation"] for f in order})

    def transform(self, df: DataFrame) -> DataFrame:
        """Replaces each feature by its z-score; NULLs become the learned mean, that is 0."""

        def scaled(f: str):
            if self.means[f] is None or not self.deviations[f]:
                return F.lit(0.0)
            centred = F.coalesce(F.col(f).cast("double"), F.lit(self.means[f])) - self.means[f]
            return centred / self.deviations[f]

        return df.withColumns({f: scaled(f) for f in self.means})


@dataclass
class KpiPreprocessor:
    """Cleaning, features and scaling with a fit / transform split."""

    ties: tuple[str, ...] = ()
    calendar: bool = True
    scaler: FeatureScaler | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """Settings, and the scaler once it is fitted, so that ``transform`` goes on elsewhere."""
        if self.scaler is not None:
            self.scaler.save(spark, f"{path.rstrip('/')}/scaler")
        settings = {"ties": list(self.ties), "calendar": self.calendar, "fitted": self.scaler is not None}
        write_model(spark, path, "KPI preprocessor", settings, {})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KpiPreprocessor:
        settings = read_settings(spark, path, "KPI preprocessor")
        scaler = FeatureScaler.load(spark, f"{path.rstrip('/')}/scaler") if settings["fitted"] else None
        return cls(tuple(settings["ties"]), settings["calendar"], scaler)

    def _features(self, df: DataFrame) -> DataFrame:
        return kpi_features(clean(df, self.ties), self.ties, self.calendar)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        featured = self._features(df)
        self.scaler = FeatureScaler.fit(featured, feature_columns(self.calendar))
        return self.scaler.transform(featured)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.scaler is None:
            raise ValueError("fit_transform must run before transform")
        return self.scaler.transform(self._features(df))
