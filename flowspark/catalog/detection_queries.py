"""Detection and evaluation on the scored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from .. import schema as S
from ..functions import scalars
from ..operators import detect, evaluate
from ..session import work_path
from ..sources import tables
from .registry import query, rounded
from .sql import scored_sql

LABELS = [*S.CLASSES, "needs_review"]


def _detected(spark, sf_dir):
    return detect.two_stage_detection(fixtures.scored_probabilities(spark, sf_dir))


@query(
    scored_sql(
        "SELECT flow_id, CAST(CASE WHEN top_prob < 0.5 THEN -1 ELSE top_class END AS INTEGER) AS prediction, "
        "top_prob AS confidence FROM scored"
    )
)
def confidence_gate(spark, sf_dir):
    gated = detect.predict_with_confidence(fixtures.scored_probabilities(spark, sf_dir))
    return gated.select("flow_id", "prediction", "confidence")


_PROBABILITY = (
    "round(CASE WHEN stage1_prediction = 0 THEN CASE WHEN {i} = 2 THEN 1.0 ELSE 0.0 END::DOUBLE "
    "WHEN top_class = {i} THEN top_prob ELSE (1 - top_prob) / 4 END, 6) AS p{i}"
)


@query(
    scored_sql(
        "SELECT detected.flow_id, prediction, label, confidence, detection_path, "
        + ", ".join(_PROBABILITY.format(i=i) for i in range(5))
        + " FROM detected JOIN scored ON scored.flow_id = detected.flow_id"
    )
)
def two_stage_detect(spark, sf_dir):
    return _detected(spark, sf_dir).select(
        "flow_id",
        "prediction",
        "label",
        "confidence",
        "detection_path",
        *[F.round(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(5)],
    )


@query(
    scored_sql(
        """SELECT flow_id, CASE WHEN flow_id % 7 = 0 AND stage1_prediction <> 0 THEN 'xgboost_failed'
     WHEN stage1_prediction = 0 AND flow_id % 5 <> 0 THEN 'lightgbm_benign' WHEN flow_id % 7 = 0 THEN 'xgboost_failed'
     WHEN top_prob < 0.8 THEN 'xgboost_low_confidence' ELSE 'xgboost_anomaly' END AS detection_path,
  CASE WHEN flow_id % 7 = 0 AND stage1_prediction <> 0 THEN 'detection_failed'
     WHEN stage1_prediction = 0 AND flow_id % 5 <> 0 THEN 'normal' WHEN flow_id % 7 = 0 THEN 'detection_failed'
     WHEN top_prob < 0.8 THEN 'needs_review' WHEN top_class = 0 THEN 'brute_force' WHEN top_class = 1 THEN 'database_attack'
     WHEN top_class = 2 THEN 'normal' WHEN top_class = 3 THEN 'spoofing' ELSE 'upload_attack' END AS label FROM scored"""
    )
)
def two_stage_failures(spark, sf_dir):
    """A first stage that is missing for some rows and a second that failed for others."""
    key = F.col("flow_id")
    broken = fixtures.scored_probabilities(spark, sf_dir).withColumns(
        {
            "stage1_prediction": F.when(key % 5 != 0, F.col("stage1_prediction")),
            "probabilities": F.when(key % 7 != 0, F.col("probabilities")),
        }
    )
    return detect.two_stage_detection(broken, threshold=0.8).select("flow_id", "detection_path", "label")


@query(
    scored_sql(
        """SELECT count(*) AS total_samples, count(*) FILTER (WHERE label <> 'normal') AS predicted_anomalies,
  count(*) FILTER (WHERE label NOT IN ('normal', 'needs_review', 'unknown', 'detection_failed')) AS confirmed_anomalies,
  count(*) FILTER (WHERE confidence > 0.8) AS high_confidence, count(*) FILTER (WHERE label = 'needs_review') AS needs_review FROM detected"""
    )
)
def detection_summary(spark, sf_dir):
    return detect.detection_summary(_detected(spark, sf_dir))


@query(scored_sql("SELECT label, count(*) AS rows FROM detected GROUP BY 1"))
def prediction_distribution(spark, sf_dir):
    return detect.prediction_distribution(_detected(spark, sf_dir))


@query(
    scored_sql(
        """SELECT flow_id, code, CASE code WHEN -2 THEN 'needs_review' WHEN -3 THEN 'detection_failed'
  WHEN 0 THEN 'brute_force' WHEN 1 THEN 'database_attack' WHEN 2 THEN 'normal' WHEN 3 THEN 'spoofing'
  WHEN 4 THEN 'upload_attack' ELSE 'unknown' END AS label
FROM (SELECT flow_id, CAST(flow_id % 11 - 4 AS INTEGER) AS code FROM scored) t"""
    )
)
def code_to_label(spark, sf_dir):
    codes = fixtures.scored(spark, sf_dir).select("flow_id", (F.col("flow_id") % 11 - 4).cast("int").alias("code"))
    return codes.withColumn("label", scalars.prediction_label("code", S.CLASSES))


# --- evaluation -------------------------------------------------------------------------


def metric_ctes(name: str, source: str, truth: str = "true_label", predicted: str = "label") -> tuple[str, ...]:
    """Per-class metrics of ``source`` as the CTE ``name``."""
    return (
        f"{name}_classes AS (SELECT {truth} AS label FROM {source} UNION SELECT {predicted} FROM {source})",
        f"""{name}_counts AS (SELECT label,
  (SELECT count(*) FROM {source} s WHERE s.{truth} = c.label) AS support,
  (SELECT count(*) FROM {source} s WHERE s.{predicted} = c.label) AS predicted_rows,
  (SELECT count(*) FROM {source} s WHERE s.{truth} = c.label AND s.{predicted} = c.label) AS hits FROM {name}_classes c)""",
        f"""{name} AS (SELECT label, support, hits,
  CASE WHEN predicted_rows = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / predicted_rows END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / support END AS recall,
  CASE WHEN support + predicted_rows = 0 THEN 0.0 ELSE 2.0 * hits / CAST(support + predicted_rows AS DOUBLE) END AS f1
  FROM {name}_counts)""",
    )


_AVERAGES = ", ".join(f"round(avg({m}), 6) AS {m}_macro" for m in ("precision", "recall", "f1")) + ", " + ", ".join(
    f"round(sum({m} * support) / sum(support), 6) AS {m}_weighted" for m in ("precision", "recall", "f1")
)


@query(
    scored_sql(
        f"SELECT round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy, {_AVERAGES} FROM m",
        *metric_ctes("m", "detected"),
    )
)
def accuracy_metrics(spark, sf_dir):
    return rounded(evaluate.accuracy_metrics(_detected(spark, sf_dir)))


@query(
    scored_sql(
        f"SELECT round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy, {_AVERAGES} FROM m",
        "partial AS (SELECT * FROM detected WHERE true_label <> 'upload_attack')",
        *metric_ctes("m", "partial"),
    )
)
def zero_division_metrics(spark, sf_dir):
    """A class that is predicted but never true."""
    return rounded(evaluate.accuracy_metrics(_detected(spark, sf_dir).filter("true_label <> 'upload_attack'")))


_REPORT = (
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
    "round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m"
)


@query(scored_sql(_REPORT, *metric_ctes("m", "detected")))
def classification_report(spark, sf_dir):
    return rounded(evaluate.classification_report(_detected(spark, sf_dir)))


@query(
    scored_sql(
        "SELECT true_label AS truth, "
        + ", ".join(f"count(*) FILTER (WHERE label = '{c}') AS {c}" for c in LABELS)
        + " FROM detected GROUP BY 1"
    )
)
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_detected(spark, sf_dir), LABELS)


@query(scored_sql("SELECT true_label AS truth, label AS predicted, count(*) AS rows FROM detected GROUP BY 1, 2"))
def confusion_counts(spark, sf_dir):
    return evaluate.confusion_counts(_detected(spark, sf_dir))


@query(
    scored_sql(
        "SELECT true_label AS label, count(*) FILTER (WHERE label = true_label) AS correct, count(*) AS rows, "
        "round(avg(CASE WHEN label = true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM detected GROUP BY 1"
    )
)
def per_class_accuracy(spark, sf_dir):
    return rounded(evaluate.per_class_accuracy(_detected(spark, sf_dir)))


@query(scored_sql("SELECT concat(true_label, '->', label) AS error_type, count(*) AS rows FROM detected WHERE label <> true_label GROUP BY 1"))
def error_types(spark, sf_dir):
    return evaluate.error_types(_detected(spark, sf_dir))


@query(
    scored_sql(
        "SELECT flows.flow_id, anomaly_type, CASE WHEN flows.flow_id % 10 <> 0 THEN label END AS label, "
        "coalesce(flows.flow_id % 10 <> 0 AND label = anomaly_type, FALSE) AS is_correct "
        "FROM flows JOIN detected ON detected.flow_id = flows.flow_id"
    )
)
def align_predictions(spark, sf_dir):
    """Truth and predictions from two tables, some predictions missing."""
    stored = _detected(spark, sf_dir).filter("flow_id % 10 <> 0").select("flow_id", "label", "confidence")
    truth = fixtures.flows(spark, sf_dir).select("flow_id", "anomaly_type")
    aligned = evaluate.align_predictions(truth, stored, "flow_id")
    return evaluate.with_correctness(aligned, "anomaly_type").select("flow_id", "anomaly_type", "label", "is_correct")


@query(scored_sql("SELECT flow_id, true_label, label, label = true_label AS is_correct FROM detected"))
def align_by_position(spark, sf_dir):
    """Truth and predictions stored apart without a common key, in files of other sizes but in the same order."""
    truth, found = work_path(spark, "truth"), work_path(spark, "predictions")
    flows = fixtures.flows(spark, sf_dir).select("flow_id", F.col(S.TARGET).alias("true_label"))
    flows.repartitionByRange(5, "flow_id").sortWithinPartitions("flow_id").write.parquet(truth)
    detected = _detected(spark, sf_dir).repartitionByRange(3, "flow_id").sortWithinPartitions("flow_id")
    detected.select("label").write.parquet(found)
    aligned = evaluate.align_by_position(tables.load_with_position(spark, truth), tables.load_with_position(spark, found))
    return evaluate.with_correctness(aligned).select("flow_id", "true_label", "label", "is_correct")


@query(scored_sql("SELECT flow_id, true_label, label, confidence FROM detected WHERE label <> true_label"))
def error_rows(spark, sf_dir):
    return evaluate.error_rows(_detected(spark, sf_dir)).select("flow_id", "true_label", "label", "confidence")


@query(
    scored_sql(
        "SELECT round(avg(confidence), 6) AS average_confidence, round(stddev_pop(confidence), 6) AS confidence_std, "
        "min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM detected"
    )
)
def confidence_stats(spark, sf_dir):
    return rounded(evaluate.confidence_stats(_detected(spark, sf_dir)))


_RUN = (
    "SELECT '{s}' AS strategy, CAST(sum(hits) AS DOUBLE) / sum(support) AS accuracy, avg(precision) AS precision, "
    "avg(recall) AS recall, avg(f1) AS f1 FROM {m}"
)
_RUNS = (
    "named AS (SELECT flow_id, true_label, CASE top_class WHEN 0 THEN 'brute_force' WHEN 1 THEN 'database_attack' "
    "WHEN 2 THEN 'normal' WHEN 3 THEN 'spoofing' ELSE 'upload_attack' END AS label FROM scored)",
    *metric_ctes("m1", "detected"),
    *metric_ctes("m2", "named"),
    "runs AS (" + _RUN.format(s="two_stage", m="m1") + " UNION ALL " + _RUN.format(s="single_stage", m="m2") + ")",
)


def _runs(spark, sf_dir):
    single = fixtures.scored(spark, sf_dir).withColumn("label", scalars.prediction_label("top_class", S.CLASSES))
    frames = {"two_stage": _detected(spark, sf_dir), "single_stage": single}
    return tables.union_by_name(
        [
            evaluate.accuracy_metrics(df).select(
                F.lit(name).alias("strategy"),
                "accuracy",
                *[F.col(f"{m}_macro").alias(m) for m in ("precision", "recall", "f1")],
            )
            for name, df in frames.items()
        ]
    )


@query(
    scored_sql(
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, (SELECT strategy FROM runs ORDER BY {m} DESC, strategy LIMIT 1) AS best_strategy, "
            f"round(max({m}), 6) AS best_value FROM runs"
            for m in ("accuracy", "precision", "recall", "f1")
        ),
        *_RUNS,
    )
)
def strategy_compare(spark, sf_dir):
    return rounded(evaluate.compare_strategies(_runs(spark, sf_dir)))


@query(
    scored_sql(
        """SELECT count(*) FILTER (WHERE f1 < 0.3) = 0 AS requirements_met,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE f1 < 0.3), '') AS failing_classes
FROM m WHERE label IN ('brute_force', 'database_attack', 'spoofing', 'upload_attack')""",
        *metric_ctes("m", "detected"),
    )
)
def requirement_gate(spark, sf_dir):
    return evaluate.requirement_gate(evaluate.class_metrics(evaluate.confusion_counts(_detected(spark, sf_dir))))


@query(
    scored_sql(
        "SELECT label, CASE WHEN f1 >= 0.7 THEN 'excellent' WHEN f1 >= 0.5 THEN 'good' WHEN f1 >= 0.3 THEN 'fair' "
        "ELSE 'needs_improvement' END AS grade, f1 >= 0.3 AS meets_requirement FROM m",
        *metric_ctes("m", "detected"),
    )
)
def f1_grades(spark, sf_dir):
    metrics = evaluate.class_metrics(evaluate.confusion_counts(_detected(spark, sf_dir)))
    return evaluate.graded_classes(metrics).select("label", "grade", "meets_requirement")


@query(
    scored_sql(
        """SELECT count(*) AS total_samples, count(*) FILTER (WHERE label = true_label) AS correct_predictions,
  round(avg(CASE WHEN label = true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) FILTER (WHERE label <> 'normal') AS predicted_anomalies,
  count(*) FILTER (WHERE confidence > 0.8) AS high_confidence_predictions,
  count(*) FILTER (WHERE label = 'needs_review') AS needs_review,
  round(avg(confidence), 6) AS average_confidence, round(stddev_pop(confidence), 6) AS confidence_std,
  count(*) FILTER (WHERE label <> true_label) AS error_count FROM detected"""
    )
)
def evaluation_report(spark, sf_dir):
    path = work_path(spark, "evaluation")
    tables.save_evaluation(_detected(spark, sf_dir), path, "true_label")
    stored = spark.read.parquet(f"{path}/rows")
    return rounded(evaluate.evaluation_report(stored))


@query(scored_sql("SELECT flow_id, label AS predicted_label, confidence, detection_path FROM detected"))
def prediction_table(spark, sf_dir):
    path = work_path(spark, "predictions")
    tables.save_predictions(_detected(spark, sf_dir), path)
    return spark.read.parquet(path).select("flow_id", "predicted_label", "confidence", "detection_path")
