"""Least squares from grouped sums, and the table in which fitted models are kept.

All means and covariances come from one aggregation with map-side combination; what reaches
the driver is one row, of a size that only the number of features decides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import exists

MODEL = "version string, trained_at timestamp, term string, coefficient double, rows long, r2 double"


@dataclass(frozen=True)
class LinearModel:
    version: str
    intercept: float
    coefficients: dict[str, float]
    rows: int
    r2: float | None


def fit(rows: DataFrame, features: list[str], target: str, version: str = "1") -> LinearModel:
    """Ordinary least squares over the rows without nulls in features and target. Where
    features depend on one another, the solution of least length in units of their
    deviations; a feature that never changes gets 0. Fails without rows."""
    x, y = [F.col(c).cast("double") for c in features], F.col(target).cast("double")
    known = rows.dropna(subset=[*features, target])
    sums = [F.count("*").alias("n"), F.avg(y).alias("y"), F.var_pop(y).alias("yy")]
    for i, a in enumerate(x):
        sums += [F.avg(a).alias(f"m{i}"), F.covar_pop(a, y).alias(f"y{i}")]
        sums += [F.covar_pop(a, b).alias(f"c{i}_{j}") for j, b in enumerate(x[: i + 1])]
    s = known.agg(*sums).first()
    if not s["n"]:
        raise ValueError("no row to learn from")
    p = len(features)
    cov = np.array([[s[f"c{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)]).reshape(p, p)
    to = np.array([s[f"y{i}"] for i in range(p)])
    means = np.array([s[f"m{i}"] for i in range(p)])
    moves = np.diag(cov) > 1e-12 * (1 + means**2) * np.finfo(float).eps ** 0.25  # else only rounding moves it
    scale = np.sqrt(np.where(moves, np.diag(cov), 1.0))
    beta = np.linalg.lstsq(np.where(np.outer(moves, moves), cov, 0) / np.outer(scale, scale), np.where(moves, to, 0) / scale, rcond=1e-9)[0] / scale
    r2 = float(beta @ to / s["yy"]) if s["yy"] else None
    intercept = float(s["y"] - sum(b * s[f"m{i}"] for i, b in enumerate(beta)))
    return LinearModel(version, intercept, {c: float(b) for c, b in zip(features, beta)}, s["n"], r2)


def predictor(model: LinearModel) -> Callable[[DataFrame], DataFrame]:
    """Adds ``expected``, never below 0; null where a feature is."""

    def run(features: DataFrame) -> DataFrame:
        value = F.lit(model.intercept)
        for c, b in model.coefficients.items():
            value = value + F.lit(b) * F.col(c)
        return features.withColumn("expected", F.when(value.isNotNull(), F.round(F.greatest(value, F.lit(0.0)), 6)))

    return run


def save(spark: SparkSession, model: LinearModel, path: str) -> None:
    """Appends the model's terms to the table; a version that is there already is refused."""
    if load(spark, path, model.version) is not None:
        raise ValueError(f"version {model.version} exists")
    terms = [(model.version, t, c, model.rows, model.r2) for t, c in [("", model.intercept), *model.coefficients.items()]]
    df = spark.createDataFrame(terms, "version string, term string, coefficient double, rows long, r2 double")
    df.select("version", F.current_timestamp().alias("trained_at"), "term", "coefficient", "rows", "r2").coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: str | None = None) -> LinearModel | None:
    """The model of a version, else the newest; None if there is none."""
    if not exists(spark, path):
        return None
    terms = spark.read.schema(MODEL).parquet(path)
    if version is None:
        version = terms.agg(F.max_by("version", F.struct("trained_at", "version"))).first()[0]
    found = {r["term"]: r for r in terms.where(F.col("version") == version).collect()}
    if not found:
        return None
    one = found.pop("")
    return LinearModel(version, one["coefficient"], {t: r["coefficient"] for t, r in found.items()}, one["rows"], one["r2"])
