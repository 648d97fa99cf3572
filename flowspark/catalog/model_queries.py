"""Training, saved models and streams over the flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import fixtures
from .. import schema as S
from ..functions import ordering, scalars
from ..operators import detect, features, models
from ..operators.models import TreeSettings
from ..plans import dataset, prediction, training
from ..session import work_path
from ..sources.models import Detector, ModelRegistry, latest_model, register_model, training_runs
from ..sources import tables
from ..streaming import scoring
from .feature_queries import PREPROCESS_CTES, PREPROCESSED
from .quality_queries import REASONS
from .registry import query, rounded
from .sql import flows_sql, scored_sql

SETTINGS = TreeSettings()


def _training(spark, sf_dir, **options):
    return training.train_detector(fixtures.flows(spark, sf_dir), "flow_id", settings=SETTINGS, **options)


@query()
def train_two_stage(spark, sf_dir):
    """Every flow scored by a detector trained on a part of them."""
    detector = _training(spark, sf_dir).detector
    path = work_path(spark, "detector")
    detector.save(spark, path)
    scored = Detector.load(spark, path).score(fixtures.flows(spark, sf_dir))
    return rounded(scored.select("flow_id", S.TARGET, "prediction", "label", "confidence", "detection_path"))


@query(
    flows_sql(
        "SELECT anomaly_type, count(*) AS rows, count(*) AS sums_to_one, count(*) AS code_matches_path, "
        "count(*) AS confidence_is_top FROM flows GROUP BY 1"
    )
)
def detection_invariants(spark, sf_dir):
    """Rows of each class on which a trained detector keeps its own rules."""
    scored = _training(spark, sf_dir).detector.score(fixtures.flows(spark, sf_dir))
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    path, code, sure = F.col("detection_path"), F.col("prediction"), F.col("confidence")
    agrees = (
        F.when(path == S.PATH_BENIGN, (F.col("label") == S.NORMAL) & (sure == 1.0))
        .when(path == S.PATH_LOW_CONFIDENCE, (code == S.NEEDS_REVIEW) & (sure < S.CONFIDENCE_THRESHOLD))
        .when(path == S.PATH_ANOMALY, (code >= 0) & (sure >= S.CONFIDENCE_THRESHOLD))
    )
    return scored.groupBy(S.TARGET).agg(
        F.count("*").alias("rows"),
        F.count_if(F.abs(total - 1.0) < 1e-9).alias("sums_to_one"),
        F.count_if(agrees).alias("code_matches_path"),
        F.count_if(sure == F.array_max("probabilities")).alias("confidence_is_top"),
    )


@query()
def boosted_classes(spark, sf_dir):
    """Class probabilities of one boosted model per class."""
    flows = ordering.stored(fixtures.flows(spark, sf_dir), "boosting-input")
    fitted = features.FlowPreprocessor(S.TARGET, ("flow_id",), True).fit(flows, cache=False)
    rows = ordering.stored(fitted.transform(flows), "boosting-rows")
    stage = models.train_stage_two(rows, fitted.features, learner="boosted", settings=SETTINGS)
    predicted = stage.predict(rows)
    return rounded(
        predicted.select(
            "flow_id", "label", *[F.col("probabilities")[i].alias(f"p_{c}") for i, c in enumerate(stage.classes)]
        )
    )


@query()
def weighted_training(spark, sf_dir):
    """Report of a forest trained with balanced class weights."""
    return rounded(_training(spark, sf_dir, weighted=True).report)


@query(
    flows_sql(
        "SELECT anomaly_type, count(*) AS rows, count(*) AS labelled, count(*) AS sums_to_one FROM flows GROUP BY 1"
    )
)
def raw_scaled_training(spark, sf_dir):
    """Raw captures through the adapter and a saved scaler to a trained detector."""
    raw = features.drop_identifiers(fixtures.raw_flows(spark, sf_dir))
    trained = training.train_detector(
        raw, "flow_id", settings=SETTINGS, raw=True, scaling="standard"
    )
    path = work_path(spark, "detector")
    trained.detector.save(spark, path)
    scored = Detector.load(spark, path).score(raw)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy(S.TARGET).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label").isin(*S.CLASSES, S.CODE_LABELS[S.NEEDS_REVIEW])).alias("labelled"),
        F.count_if(F.abs(total - 1.0) < 1e-9).alias("sums_to_one"),
    )


@query()
def feature_importance(spark, sf_dir):
    return _training(spark, sf_dir).importance


@query()
def feature_gain_top(spark, sf_dir):
    detector = _training(spark, sf_dir).detector
    return rounded(models.top_features(models.feature_importance(detector.stage_two, spark, "gain")))


_PART = "(n * {ppm} + 500000) // 1000000"
_TRAIN_END, _VALIDATION_END = _PART.format(ppm=700000), _PART.format(ppm=850000)


@query(
    flows_sql(
        f"""SELECT 'original' AS strategy, CAST(sum({_TRAIN_END}) AS BIGINT) AS train_rows,
  CAST(sum({_VALIDATION_END} - {_TRAIN_END}) AS BIGINT) AS validation_rows,
  CAST(sum(n - {_VALIDATION_END}) AS BIGINT) AS test_rows, TRUE AS metrics_in_range
FROM (SELECT anomaly_type, count(*) AS n FROM flows GROUP BY 1) t"""
    )
)
def training_job_run(spark, sf_dir):
    """Runs table of a job that trains from a stored table, saves, registers and records."""
    data, model = work_path(spark, "flows") + ".parquet", work_path(spark, "detector")
    registry, runs = work_path(spark, "registry"), work_path(spark, "runs")
    tables.save_table(fixtures.flows(spark, sf_dir), data)
    training.training_job(
        spark, data, "flow_id", model, registry, runs, settings=SETTINGS
    )
    sound = [F.col(m).between(0.0, 1.0) for m in ("accuracy", "precision", "recall", "f1")]
    return training_runs(spark, runs).select(
        "strategy",
        "train_rows",
        "validation_rows",
        "test_rows",
        (sound[0] & sound[1] & sound[2] & sound[3]).alias("metrics_in_range"),
    )


@query(
    flows_sql(
        "SELECT TRUE AS stage_two_loaded, TRUE AS stage_one_loaded, 25 AS feature_count, "
        "string_agg(DISTINCT anomaly_type, ',' ORDER BY anomaly_type) AS classes FROM flows"
    )
)
def model_info(spark, sf_dir):
    """Metadata of the newest registered detector."""
    detector = _training(spark, sf_dir).detector
    path, registry = work_path(spark, "detector"), work_path(spark, "registry")
    detector.save(spark, path)
    register_model(spark, registry, "forest", path)
    info = Detector.load(spark, latest_model(spark, registry, "forest")).info(spark)
    return info.withColumn("classes", F.array_join("classes", ","))


@query(flows_sql("SELECT count(*) AS total_samples, TRUE AS equals_the_written_rows, TRUE AS in_order FROM flows"))
def predict_table(spark, sf_dir):
    """Summary of a scoring job over a stored table, against the rows that it wrote."""
    data, output = work_path(spark, "flows") + ".parquet", work_path(spark, "predictions")
    tables.save_table(fixtures.flows(spark, sf_dir), data)
    detector = _training(spark, sf_dir).detector
    summary = prediction.prediction_job(spark, detector, data, output)
    again = detect.detection_summary(spark.read.parquet(output), "predicted_label")
    same = F.lit(summary.exceptAll(again).count() == 0)
    counts = [F.col(c) for c in ("confirmed_anomalies", "predicted_anomalies", "total_samples")]
    return summary.select("total_samples", same.alias("equals_the_written_rows"), ((counts[0] <= counts[1]) & (counts[1] <= counts[2])).alias("in_order"))


_STRATEGY_ROWS = """SELECT strategy, 1 AS versions, CAST(sum(CASE strategy WHEN 'undersample' THEN least ELSE n - test_rows END) AS BIGINT) AS train_rows,
  CAST(sum(test_rows) AS BIGINT) AS test_rows, TRUE AS metrics_in_range, TRUE AS recorded_model_is_newest, CAST(sum(test_rows) AS BIGINT) AS scored_by_winner
FROM (SELECT *, min(n - test_rows) OVER () AS least FROM (SELECT n, (n * 200000 + 500000) // 1000000 AS test_rows
  FROM (SELECT anomaly_type, count(*) AS n FROM flows GROUP BY 1) t) u) v, (SELECT unnest(['original', 'undersample']) AS strategy) s GROUP BY 1"""


@query(flows_sql(_STRATEGY_ROWS))
def train_strategies(spark, sf_dir):
    """Detectors of two strategies, each a version; an interrupted save is none; the winner is loaded and scores the test rows."""
    path, runs = work_path(spark, "strategies"), work_path(spark, "runs")
    raw = fixtures.raw_flows(spark, sf_dir)
    labelled = raw.withColumn(S.TARGET, scalars.class_name("label")).drop("label")
    written = dataset.build_dataset(labelled, "flow_id", f"{path}/original")
    dataset.balance_dataset(written, "flow_id", path, ("undersample",))
    sets = {"original": written, "undersample": spark.read.parquet(f"{path}/undersample/data")}
    training.compare_strategies(sets, "flow_id", runs, settings=TreeSettings(trees=20, depth=6), registry=f"{path}/registry")
    registry = ModelRegistry(spark, f"{path}/registry")
    name, best = registry.best("f1_macro")
    winner = Detector.load(spark, best)
    registry.store("original", winner)  # written, but never committed
    scored = winner.score(written.filter("split = 'test'"))
    newest = registry.versions().groupBy(F.col("name").alias("strategy")).agg(
        F.max("version").alias("versions"), F.max_by("path", "version").alias("newest")
    )
    sound = [F.col(f"{s}{m}").between(0.0, 1.0) for s in ("", "train_") for m in ("accuracy", "precision", "recall", "f1")]
    return (
        training_runs(spark, runs)
        .join(newest, "strategy")
        .crossJoin(scored.agg(F.count("label").alias("scored_by_winner")))  # one row
        .select(
            "strategy",
            "versions",
            "train_rows",
            "test_rows",
            reduce(lambda a, b: a & b, sound).alias("metrics_in_range"),
            (F.col("model") == F.col("newest")).alias("recorded_model_is_newest"),
            "scored_by_winner",
        )
    )


# --- streams ------------------------------------------------------------------------------


def _flow_stream(spark, sf_dir):
    """Orders as a stream, their packets from the stored table."""
    stored = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = scoring.read_flow_stream(spark, sf_dir, stored.schema, pattern="orders.parquet")
    return fixtures.flows_from(orders, spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query(flows_sql(PREPROCESSED, *PREPROCESS_CTES))
def stream_preprocess(spark, sf_dir):
    """Statistics fitted on the stored flows, applied to the stream of them."""
    fitted = features.FlowPreprocessor(S.TARGET, ("flow_id",)).fit(fixtures.flows(spark, sf_dir))
    output, place = work_path(spark, "stream"), work_path(spark, "stream-state")
    scoring.score_stream(_flow_stream(spark, sf_dir), fitted.transform, output, place).awaitTermination()
    return rounded(spark.read.parquet(output))


@query()
def stream_score(spark, sf_dir):
    """Detections of a trained detector on the stream of flows."""
    detector = _training(spark, sf_dir).detector
    output, place = work_path(spark, "stream"), work_path(spark, "stream-state")
    scoring.score_stream(_flow_stream(spark, sf_dir), detector.score, output, place).awaitTermination()
    scored = spark.read.parquet(output)
    return rounded(scored.select("flow_id", "prediction", "label", "confidence", "detection_path"))


@query(
    scored_sql(
        f"""SELECT flow_id, CASE WHEN reasons = '' THEN 'scored' ELSE 'quarantined' END AS place, nullif(reasons, '') AS reasons,
  CASE WHEN reasons = '' THEN label END AS label, CASE WHEN reasons = '' THEN confidence END AS confidence
FROM (SELECT detected.flow_id, label, confidence, concat_ws(',', {REASONS}) AS reasons FROM flows JOIN detected ON detected.flow_id = flows.flow_id) t"""
    )
)
def stream_quarantine(spark, sf_dir):
    """Every flow of the stream, scored or set aside with its reasons; the first batch is run twice."""
    stored = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fixed = fixtures.scored_probabilities(spark, sf_dir).select("flow_id", "probabilities", "stage1_prediction")
    output, aside, place = (work_path(spark, name) for name in ("stream", "quarantine", "stream-state"))

    def score(batch):
        return detect.two_stage_detection(batch.join(fixed, "flow_id"))

    for state in (work_path(spark, "lost-state"), place):  # without the first run's state all is done again
        orders = scoring.read_flow_stream(spark, sf_dir, stored.schema, pattern="orders.parquet")
        flows = fixtures.flows_from(orders, spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
        scoring.score_and_quarantine(flows, score, output, aside, state).awaitTermination()
    scored = spark.read.parquet(output).select("flow_id", F.lit("scored").alias("place"), "label", "confidence")
    broken = spark.read.parquet(aside).select("flow_id", F.lit("quarantined").alias("place"), F.array_join("reasons", ",").alias("reasons"))
    return scored.unionByName(broken, allowMissingColumns=True)


@query(
    scored_sql(
        """SELECT count(*) AS total_samples, count(*) FILTER (WHERE label <> 'normal') AS predicted_anomalies,
  count(*) FILTER (WHERE label NOT IN ('normal', 'needs_review', 'unknown', 'detection_failed')) AS confirmed_anomalies,
  count(*) FILTER (WHERE confidence > 0.8) AS high_confidence, count(*) FILTER (WHERE label = 'needs_review') AS needs_review FROM detected"""
    )
)
def stream_summary(spark, sf_dir):
    """Summaries of the micro-batches of a stream, added up."""
    stored = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = scoring.read_flow_stream(spark, sf_dir, stored.schema, pattern="orders.parquet")
    output, place = work_path(spark, "summaries"), work_path(spark, "summary-state")
    scoring.summarize_stream(
        fixtures.probabilities_of(fixtures.scored_from(orders)), detect.two_stage_detection, output, place
    ).awaitTermination()
    return scoring.total_summary(spark, output)
