import pytest
from pyspark.sql import functions as F

from flowspark import schema as S
from flowspark.operators import detect, evaluate

CLASSES = ["ddos", "normal", "port_scan"]


def scores(spark):
    data = [
        (1, 0, [0.1, 0.2, 0.7]),
        (2, 1, [0.1, 0.2, 0.7]),
        (3, 1, [0.4, 0.3, 0.3]),
        (4, 1, None),
        (5, None, [0.9, 0.1, 0.0]),
        (6, 1, [0.5, 0.5, 0.0]),
    ]
    return spark.createDataFrame(data, "k int, stage1_prediction int, probabilities array<double>")


def by_key(df, *columns):
    return {r["k"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_two_stages(spark):
    got = by_key(
        detect.two_stage_detection(scores(spark), CLASSES), "prediction", "label", "confidence", "detection_path", "probabilities"
    )
    assert got == {
        1: (1, "normal", 1.0, "lightgbm_benign", [0.0, 1.0, 0.0]),
        2: (2, "port_scan", 0.7, "xgboost_anomaly", [0.1, 0.2, 0.7]),
        3: (-2, "needs_review", 0.4, "xgboost_low_confidence", [0.4, 0.3, 0.3]),
        4: (-3, "detection_failed", 0.0, "xgboost_failed", [0.0, 0.0, 0.0]),
        5: (0, "ddos", 0.9, "xgboost_anomaly", [0.9, 0.1, 0.0]),
        6: (0, "ddos", 0.5, "xgboost_anomaly", [0.5, 0.5, 0.0]),
    }


def test_without_first_stage(spark):
    got = by_key(detect.two_stage_detection(scores(spark), CLASSES, 0.8, stage1=None), "prediction")
    assert got == {1: (-2,), 2: (-2,), 3: (-2,), 4: (-3,), 5: (0,), 6: (-2,)}


def test_confidence_gate(spark):
    got = by_key(detect.predict_with_confidence(scores(spark).filter("k <> 4")), "prediction", "confidence")
    assert got[2] == (2, 0.7) and got[3] == (-1, 0.4)
    with pytest.raises(ValueError):
        detect.predict_with_confidence(scores(spark), 1.5)


def test_summary(spark):
    detected = detect.two_stage_detection(scores(spark), CLASSES)
    assert detect.detection_summary(detected).first().asDict() == {
        "total_samples": 6,
        "predicted_anomalies": 5,
        "confirmed_anomalies": 3,
        "high_confidence": 2,
        "needs_review": 1,
    }
    assert {tuple(r) for r in detect.prediction_distribution(detected).collect()} == {
        ("normal", 1), ("port_scan", 1), ("needs_review", 1), ("detection_failed", 1), ("ddos", 2),
    }


def labelled(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] * 1 + [("b", "b")] * 2 + [("b", "c")] * 2 + [("d", "a")] * 2
    return spark.createDataFrame(pairs, "true_label string, label string")


def test_metrics(spark):
    per_class = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in evaluate.class_metrics(evaluate.confusion_counts(labelled(spark))).collect()}
    assert per_class["a"] == pytest.approx((0.6, 0.75, 2 / 3, 4))
    assert per_class["b"] == pytest.approx((2 / 3, 0.5, 4 / 7, 4))
    assert per_class["c"] == (0.0, 0.0, 0.0, 0) and per_class["d"] == (0.0, 0.0, 0.0, 2)
    m = evaluate.accuracy_metrics(labelled(spark)).first()
    assert m["accuracy"] == 0.5
    assert m["precision_macro"] == pytest.approx((0.6 + 2 / 3) / 4)
    assert m["recall_weighted"] == pytest.approx((0.75 * 4 + 0.5 * 4) / 10)
    report = {r["label"]: r["support"] for r in evaluate.classification_report(labelled(spark)).collect()}
    assert report == {"a": 4, "b": 4, "c": 0, "d": 2, "macro avg": 10, "weighted avg": 10}


def test_confusion_matrix_and_errors(spark):
    matrix = {r["truth"]: (r["a"], r["b"], r["c"]) for r in evaluate.confusion_matrix(labelled(spark), ["a", "b", "c"]).collect()}
    assert matrix == {"a": (3, 1, 0), "b": (0, 2, 2), "d": (2, 0, 0)}
    errors = {r["error_type"]: r["rows"] for r in evaluate.error_types(labelled(spark)).collect()}
    assert errors == {"a->b": 1, "b->c": 2, "d->a": 2}
    assert evaluate.error_rows(labelled(spark)).count() == sum(errors.values())
    accuracy = {r["label"]: (r["correct"], r["rows"], r["accuracy"]) for r in evaluate.per_class_accuracy(labelled(spark)).collect()}
    assert accuracy == {"a": (3, 4, 0.75), "b": (2, 4, 0.5), "d": (0, 2, 0.0)}


def test_published_accuracy(spark):
    for correct, total, accuracy in ((84, 85, 0.98824), (1463, 4006, 0.36520)):
        df = spark.range(total).select(
            F.lit("x").alias("true_label"), F.when(F.col("id") < correct, "x").otherwise("y").alias("label"), F.lit(0.9).alias("confidence")
        )
        report = evaluate.evaluation_report(df).first()
        assert report["accuracy"] == pytest.approx(accuracy, abs=5e-6)
        assert (report["correct_predictions"], report["error_count"]) == (correct, total - correct)
        assert report["high_confidence_predictions"] == total


def test_confidence_stats(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "confidence double")
    assert evaluate.confidence_stats(df).first()[:] == (2.0, 1.0, 1.0, 3.0)


# the published runs of two strategies
RUNS = [("original", 0.7715, 0.5107, 0.7377, 0.5139), ("undersample", 0.4689, 0.4364, 0.6447, 0.3152)]
F1 = {"brute_force": 0.17, "database_attack": 0.58, "normal": 0.90, "spoofing": 0.73, "upload_attack": 0.19}


def test_strategies(spark):
    runs = spark.createDataFrame(RUNS, "strategy string, accuracy double, precision double, recall double, f1 double")
    assert {r["best_strategy"] for r in evaluate.compare_strategies(runs).collect()} == {"original"}
    assert evaluate.best_strategy(runs).collect() == [("original", 0.5139)]
    tie = spark.createDataFrame([("b", 1.0, 1.0, 1.0, 1.0), ("a", 1.0, 1.0, 1.0, 1.0)], runs.schema)
    assert evaluate.best_strategy(tie).first()["best_strategy"] == "a"


def test_requirement_gate_and_grades(spark):
    report = spark.createDataFrame(list(F1.items()), "label string, f1 double")
    assert evaluate.requirement_gate(report).first()[:] == (False, "brute_force,upload_attack")
    assert evaluate.requirement_gate(report, required=0.1).first()[:] == (True, "")
    assert evaluate.requirement_gate(report.filter("label = 'normal'"), ("spoofing",)).first()[:] == (False, "spoofing")
    grades = {r["label"]: r["grade"] for r in evaluate.graded_classes(report).collect()}
    assert grades == {
        "brute_force": "needs_improvement", "database_attack": "good", "normal": "excellent", "spoofing": "excellent",
        "upload_attack": "needs_improvement",
    }
    assert S.ATTACK_CLASSES == ["brute_force", "database_attack", "spoofing", "upload_attack"]
