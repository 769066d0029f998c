"""Model comparison and the set of result tables of a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators.clean import best_entry, without_noise
from tabscope.operators.density import dbscan
from tabscope.operators.features import assemble
from tabscope.operators.medoids import medoid_labels
from tabscope.operators.models import (
    accuracy,
    discriminant_predict,
    kmeans_labels,
    logistic_accuracy,
    mixture_labels,
    multiple_regression,
    simple_regression,
)
from tabscope.operators.neighbors import knn_predict
from tabscope.operators.profile import union_all
from tabscope.operators.silhouette import silhouette_euclidean
from tabscope.scratch import materialize
from tabscope.sources.files import write_table

NOT_APPLICABLE = "No aplica"
# Names and metrics of the report's lines, in their order.
MODELS = (
    ("Regresión lineal simple", "r2"),
    ("Regresión lineal múltiple", "r2"),
    ("Regresión logística", "accuracy"),
    ("LDA", "accuracy"),
    ("KNN", "accuracy"),
    ("KMeans", "silhouette"),
    ("KMedoids", "silhouette"),
    ("GMM", "silhouette"),
    ("DBSCAN", "silhouette"),
)


def score_row(result: DataFrame, order: int, score: str) -> DataFrame:
    """One model's line; a missing score is marked as not applicable."""
    model, metric = MODELS[order]
    line = result.limit(1).select(
        F.lit(order).alias("ord"), F.lit(model).alias("model"), F.lit(metric).alias("metric"), F.col(score).cast("double").alias("score")
    )
    return line.withColumn("note", F.when(F.col("score").isNull(), F.lit(NOT_APPLICABLE)).otherwise(F.lit("")))


def compare_models(
    df: DataFrame, scaled: DataFrame, features: Sequence[str], key: str, target: str, x: str, y: str,
    eps: float = 0.5, min_samples: int = 5, metrics: Sequence[str] = ("r2", "accuracy", "silhouette"),
) -> DataFrame:
    """One line per model of the wanted ``metrics``: R² of the regressions on ``df``, accuracy and silhouette on ``scaled``.

    Silhouettes use Euclidean distances over all rows, noise left out. Only the models asked for are fitted.
    """
    rest = [f for f in features if f != y]
    vectors = materialize(assemble(scaled.select(key, *features), features), "vectors") if "silhouette" in metrics else None

    def noiseless() -> DataFrame:
        return without_noise(scaled.select(key, *features).join(dbscan(scaled, features, key, eps, min_samples), key))

    def silhouette(labelled: DataFrame) -> DataFrame:
        return silhouette_euclidean(materialize(labelled.select("cluster", *features), "labelled"), features)

    lines = (
        lambda: (simple_regression(df, x, y), "r2"),
        lambda: (multiple_regression(df, rest, y), "r2"),
        lambda: (logistic_accuracy(scaled, features, target), "accuracy"),
        lambda: (accuracy(discriminant_predict(scaled, features, target), target, "prediction"), "accuracy"),
        lambda: (accuracy(knn_predict(scaled, features, target, key), target, "prediction"), "accuracy"),
        lambda: (silhouette(kmeans_labels(vectors, key)), "silhouette"),
        lambda: (silhouette(medoid_labels(scaled, features, key)), "silhouette"),
        lambda: (silhouette(mixture_labels(vectors, key)), "silhouette"),
        lambda: (silhouette(noiseless()), "silhouette"),
    )
    made = []
    for order, (line, (_, metric)) in enumerate(zip(lines, MODELS)):
        if metric in metrics:
            result, score = line()
            made.append(score_row(result, order, score))
    return union_all(made)


def best_model(comparison: DataFrame) -> DataFrame:
    """Highest silhouette; ties to the first listed."""
    return best_entry(comparison.filter(F.col("metric") == "silhouette"), "score", "ord")


def write_report(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each result table below ``folder`` and return its path."""
    return {name: write_table(table, f"{folder}/{name}") for name, table in tables.items()}
