"""Two-stage detection as columns on the scored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars


def _best(probabilities: Column) -> tuple[Column, Column]:
    """(0-based index of the first largest probability, that probability)."""
    top = F.array_max(probabilities)
    return (F.array_position(probabilities, top) - 1).cast("int"), top


def check_threshold(threshold: float) -> float:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"confidence threshold out of [0, 1]: {threshold}")
    return float(threshold)


def predict_with_confidence(
    df: DataFrame, threshold: float = S.CONFIDENCE_THRESHOLD, probabilities: str = "probabilities"
) -> DataFrame:
    """Add ``prediction`` (-1 below the threshold) and ``confidence``."""
    best, top = _best(F.col(probabilities))
    gated = F.when(top < check_threshold(threshold), S.UNKNOWN).otherwise(best)
    return df.withColumns({"prediction": gated.cast("int"), "confidence": top})


def two_stage_detection(
    df: DataFrame,
    classes=tuple(S.CLASSES),
    threshold: float = S.CONFIDENCE_THRESHOLD,
    stage1: str | None = "stage1_prediction",
    probabilities: str = "probabilities",
    normal: str = S.NORMAL,
) -> DataFrame:
    """Add prediction, label, confidence, detection path and final probabilities.

    First-stage 0 is benign and decides alone. Everything else, also a missing
    first stage (NULL, or ``stage1=None``), takes the second stage; a NULL
    probability array means that stage failed.
    """
    classes = list(classes)
    threshold = check_threshold(threshold)
    benign = F.coalesce(F.col(stage1) == 0, F.lit(False)) if stage1 else F.lit(False)
    scores = F.col(probabilities)
    failed = scores.isNull()
    best, top = _best(scores)
    low = top < threshold
    # without a class for normal traffic its code falls back to 0
    normal_code = classes.index(normal) if normal in classes else 0
    one_hot = F.array(*[F.lit(1.0 if i == normal_code else 0.0) for i in range(len(classes))])
    zeros = F.array(*[F.lit(0.0) for _ in classes])
    prediction = (
        F.when(benign, normal_code)
        .when(failed, S.DETECTION_FAILED)
        .when(low, S.NEEDS_REVIEW)
        .otherwise(best)
        .cast("int")
    )
    path = (
        F.when(benign, S.PATH_BENIGN)
        .when(failed, S.PATH_FAILED)
        .when(low, S.PATH_LOW_CONFIDENCE)
        .otherwise(S.PATH_ANOMALY)
    )
    return df.withColumns(
        {
            "prediction": prediction,
            "confidence": F.when(benign, 1.0).when(failed, 0.0).otherwise(top),
            "detection_path": path,
            "probabilities": F.when(benign, one_hot).when(failed, zeros).otherwise(scores),
        }
    ).withColumn("label", scalars.prediction_label("prediction", classes))


def detection_summary(df: DataFrame, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """One row of counts over a detected table.

    ``predicted_anomalies`` counts every label but normal, also those that need
    review; ``confirmed_anomalies`` counts attack classes only.
    """
    return df.agg(*summary_columns(label, confidence))


def summary_columns(label: str = "label", confidence: str = "confidence") -> list[Column]:
    """The aggregates of ``detection_summary``, which a write can observe as well."""
    special = list(S.CODE_LABELS.values())

    def rows(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return [
        F.count(F.lit(1)).alias("total_samples"),
        rows(F.col(label) != S.NORMAL).alias("predicted_anomalies"),
        rows(~F.col(label).isin(S.NORMAL, *special)).alias("confirmed_anomalies"),
        rows(F.col(confidence) > S.HIGH_CONFIDENCE).alias("high_confidence"),
        rows(F.col(label) == S.CODE_LABELS[S.NEEDS_REVIEW]).alias("needs_review"),
    ]


def prediction_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))
