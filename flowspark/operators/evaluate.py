"""Evaluation of predictions as aggregates over one confusion table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import error_type

F1_REQUIRED = 0.3
F1_GRADES = ((0.7, "excellent"), (0.5, "good"), (0.3, "fair"))
METRICS = ("accuracy", "precision", "recall", "f1")


def with_correctness(df: DataFrame, truth: str = "true_label", predicted: str = "label") -> DataFrame:
    return df.withColumn("is_correct", F.col(truth).eqNullSafe(F.col(predicted)))


def align_predictions(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Rows of ``truth`` with the columns of ``predictions`` for the same key.

    For labels and predictions that are stored apart; a row without a prediction is
    kept with NULLs.
    """
    extra = [c for c in predictions.columns if c != key and c not in truth.columns]
    # both grow with the data; a file of labels is a thousandth of its rows in memory, so its size would pass for a small table's
    return truth.join(predictions.select(key, *extra).hint("merge"), key, "left")


def align_by_position(truth: DataFrame, predictions: DataFrame, position: str = "position") -> DataFrame:
    """Rows of ``truth`` with the columns of the row of ``predictions`` at the same position.

    For stored tables that share no key, each read by ``tables.load_with_position``. A row beyond the end of
    ``predictions`` is kept with NULLs; columns that both have are those of ``truth``.
    """
    return align_predictions(truth, predictions, position)


def error_rows(df: DataFrame, truth: str = "true_label", predicted: str = "label") -> DataFrame:
    """Rows whose prediction differs from the truth."""
    return with_correctness(df, truth, predicted).filter(~F.col("is_correct"))


def error_types(df: DataFrame, truth: str = "true_label", predicted: str = "label") -> DataFrame:
    """Counts per ``true->predicted``."""
    return (
        error_rows(df, truth, predicted)
        .groupBy(error_type(truth, predicted).alias("error_type"))
        .agg(F.count("*").alias("rows"))
    )


def error_types_of(confusion: DataFrame) -> DataFrame:
    """``error_types`` from a table of confusion counts."""
    wrong = confusion.filter(~F.col("truth").eqNullSafe(F.col("predicted")))
    return wrong.groupBy(error_type("truth", "predicted").alias("error_type")).agg(F.sum("rows").alias("rows"))


def confusion_counts(df: DataFrame, truth: str = "true_label", predicted: str = "label") -> DataFrame:
    """(``truth``, ``predicted``, ``rows``), the base of every metric below."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("rows")
    )


def confusion_matrix(df: DataFrame, classes, truth: str = "true_label", predicted: str = "label") -> DataFrame:
    """One row per true class, one column per class of ``classes``."""
    return df.groupBy(F.col(truth).alias("truth")).agg(
        *[F.count_if(F.col(predicted) == c).alias(c) for c in classes]
    )


def _ratio(top, bottom) -> Column:
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, zero where undefined.

    Classes are those that occur as truth or as prediction.
    """
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("rows")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("rows").alias("s"), none.alias("p"), hit.cast("bigint").alias("t")),
        F.struct(F.col("predicted").alias("label"), none.alias("s"), F.col("rows").alias("p"), none.alias("t")),
    )
    totals = (
        confusion.select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted_rows"), F.sum("t").alias("hits"))
    )
    return totals.select(
        "label",
        _ratio("hits", "predicted_rows").alias("precision"),
        _ratio("hits", "support").alias("recall"),
        F.coalesce(
            F.try_divide(2.0 * F.col("hits"), (F.col("support") + F.col("predicted_rows")).cast("double")), F.lit(0.0)
        ).alias("f1"),
        "support",
        "hits",
    )


def accuracy_metrics(df: DataFrame, truth: str = "true_label", predicted: str = "label") -> DataFrame:
    """One row: accuracy and macro and support-weighted precision, recall and F1."""
    return metrics_of(confusion_counts(df, truth, predicted))


def metrics_of(confusion: DataFrame) -> DataFrame:
    """``accuracy_metrics`` from a table of confusion counts."""
    per_class = class_metrics(confusion)

    def weighted(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))

    names = ("precision", "recall", "f1")
    return per_class.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in names],
        *[weighted(c).alias(f"{c}_weighted") for c in names],
    )


def classification_report(df: DataFrame, truth: str = "true_label", predicted: str = "label") -> DataFrame:
    """Per-class rows plus the ``macro avg`` and ``weighted avg`` rows."""
    return report_of(confusion_counts(df, truth, predicted))


def report_of(confusion: DataFrame) -> DataFrame:
    """``classification_report`` from a table of confusion counts."""
    per_class = class_metrics(confusion).drop("hits")
    names = ("precision", "recall", "f1")
    macro = per_class.agg(
        F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")
    )
    weighted = per_class.agg(
        F.lit("weighted avg").alias("label"),
        *[
            F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c)
            for c in names
        ],
        F.sum("support").alias("support"),
    )
    return per_class.unionByName(macro).unionByName(weighted)


def per_class_accuracy(df: DataFrame, truth: str = "true_label", predicted: str = "label") -> DataFrame:
    return (
        with_correctness(df, truth, predicted)
        .groupBy(F.col(truth).alias("label"))
        .agg(
            F.count_if("is_correct").alias("correct"),
            F.count("*").alias("rows"),
            F.avg(F.col("is_correct").cast("double")).alias("accuracy"),
        )
    )


def confidence_stats(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Mean, population deviation and extremes of the confidence."""
    c = F.col(confidence)
    return df.agg(
        F.avg(c).alias("average_confidence"),
        F.stddev_pop(c).alias("confidence_std"),
        F.min(c).alias("min_confidence"),
        F.max(c).alias("max_confidence"),
    )


def grade(f1) -> Column:
    """Verbal grade of an F1 score."""
    (bound, name), *rest = F1_GRADES
    expr = F.when(f1 >= bound, name)
    for bound, name in rest:
        expr = expr.when(f1 >= bound, name)
    return expr.otherwise("needs_improvement")


def graded_classes(report: DataFrame) -> DataFrame:
    """Class rows with their F1 grade and whether they meet the requirement."""
    return report.withColumns({"grade": grade(F.col("f1")), "meets_requirement": F.col("f1") >= F1_REQUIRED})


def requirement_gate(report: DataFrame, attacks=tuple(S.ATTACK_CLASSES), required: float = F1_REQUIRED) -> DataFrame:
    """One row: whether every attack class reaches ``required``, and which do not.

    The report has one row per class; an attack class without a row fails.
    """
    f1 = {a: F.coalesce(F.max(F.when(F.col("label") == a, F.col("f1"))), F.lit(0.0)) for a in attacks}
    failing = F.array_compact(F.array(*[F.when(v < required, F.lit(a)) for a, v in f1.items()]))
    return report.agg(failing.alias("failing")).select(
        (F.size("failing") == 0).alias("requirements_met"),
        F.array_join(F.array_sort("failing"), ",").alias("failing_classes"),
    )


def compare_strategies(runs: DataFrame) -> DataFrame:
    """(``metric``, ``best_strategy``, ``best_value``) per metric of a runs table.

    A tie goes to the first name.
    """
    ranked = [
        F.struct(
            F.lit(m).alias("metric"),
            F.min_by("strategy", F.struct((-F.col(m)).alias("v"), F.col("strategy"))).alias("best_strategy"),
            F.max(m).alias("best_value"),
        )
        for m in METRICS
    ]
    return runs.agg(F.array(*ranked).alias("rows")).select(F.inline("rows"))


def best_strategy(runs: DataFrame) -> DataFrame:
    """The winner by F1."""
    return compare_strategies(runs).filter("metric = 'f1'").select("best_strategy", "best_value")


def evaluation_report(df: DataFrame, truth: str = "true_label", predicted: str = "label", confidence: str = "confidence") -> DataFrame:
    """One row of the figures that an evaluation run reports."""
    return df.agg(*report_columns(truth, predicted, confidence))


def report_columns(truth: str = "true_label", predicted: str = "label", confidence: str = "confidence") -> list[Column]:
    """The aggregates of ``evaluation_report``, which a write can observe as well."""
    c = F.col(confidence)
    correct = F.col(truth).eqNullSafe(F.col(predicted))

    def rows(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return [
        F.count(F.lit(1)).alias("total_samples"),
        rows(correct).alias("correct_predictions"),
        F.avg(correct.cast("double")).alias("accuracy"),
        rows(F.col(predicted) != S.NORMAL).alias("predicted_anomalies"),
        rows(c > S.HIGH_CONFIDENCE).alias("high_confidence_predictions"),
        rows(F.col(predicted) == S.CODE_LABELS[S.NEEDS_REVIEW]).alias("needs_review"),
        F.avg(c).alias("average_confidence"),
        F.stddev_pop(c).alias("confidence_std"),
        rows(~correct).alias("error_count"),
    ]
