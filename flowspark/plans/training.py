"""Training jobs: preprocess, split, train, evaluate, save, record."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import ordering, stats
from ..operators import evaluate, models, profile, sampling
from ..operators.features import FlowPreprocessor, RawFlowAdapter
from ..operators.models import TreeSettings
from ..operators.scaling import fit_scaler
from ..session import work_path
from ..sources import tables
from ..sources.models import Detector, ModelRegistry, record_run, register_model, training_runs


SPLITS = ("train", "validation", "test")


@dataclass
class Training:
    """A trained detector with its evaluation tables; ``metrics`` are by split."""

    detector: Detector
    rows: dict[str, int]
    metrics: dict[str, dict[str, float]]
    report: DataFrame
    confusion: DataFrame
    importance: DataFrame

    @property
    def validation(self) -> dict[str, float]:
        return self.metrics.get("validation", {})

    @property
    def test(self) -> dict[str, float]:
        return self.metrics.get("test", {})

    def record(self, spark: SparkSession, runs: str, strategy: str, model: str | None = None) -> None:
        importance = {r["feature"]: r["importance"] for r in self.importance.collect()}
        record_run(spark, runs, strategy, self.rows, self.metrics, importance, model)


def train_on_split(
    dataset: DataFrame,
    features: list[str],
    target: str = S.TARGET,
    learner: str = "forest",
    settings: TreeSettings | None = None,
    weighted: bool = False,
    with_stage_one: bool = True,
    steps: list | None = None,
    split: str = "split",
) -> Training:
    """Fit both stages on the rows that ``split`` calls train, and evaluate them on every split there is.

    ``dataset`` has prepared features and is a stored table; ``steps`` are what prepared it and are kept in the detector.
    All rows are scored once, and every metric comes from the counts by split, class and prediction.
    """
    spark = dataset.sparkSession
    train, weight = dataset.filter(F.col(split) == "train"), None
    if train.limit(1).count() == 0:
        raise ValueError("no row is meant for training")
    if weighted:
        weight = "sample_weight"
        train = profile.with_sample_weights(train, profile.class_weights(train, target), target, weight)
    # both learners read their rows several times before they hold them
    with stats.scratch(models.training_columns(train, features, target, weight, settings)) as held:
        two = models.train_stage_two(held, features, target, learner, settings, weight)
        one = models.train_stage_one(held, features, target, settings, weight) if with_stage_one else None
    counted = two.predict(dataset).groupBy(F.col(split).alias("split"), F.col(target).alias("truth"), F.col("label").alias("predicted"))
    # a row per split and pair of classes
    found = counted.agg(F.count("*").alias("rows")).collect()
    confusion = spark.createDataFrame(found, "split string, truth string, predicted string, rows bigint")
    rows: dict[str, int] = {}
    for r in found:
        rows[r["split"]] = rows.get(r["split"], 0) + r["rows"]
    of = lambda name: confusion.filter(F.col("split") == name).drop("split")
    metrics = {name: evaluate.metrics_of(of(name)).first().asDict() for name in SPLITS if name in rows}
    return Training(
        Detector(steps or [], two, one), rows, metrics, evaluate.report_of(of("test")), of("test"), models.feature_importance(two, spark)
    )


def train_detector(
    df: DataFrame,
    key: str,
    target: str = S.TARGET,
    learner: str = "forest",
    settings: TreeSettings | None = None,
    weighted: bool = False,
    with_stage_one: bool = True,
    repair_infinite: bool = True,
    raw: bool = False,
    scaling: str | None = None,
    split_path: str | None = None,
    cache: bool = True,
) -> Training:
    """Fit the preparation and both stages and evaluate them on held-out rows.

    ``raw`` takes a flow-meter table with integer labels through the adapter instead
    of core flows through the preprocessor. ``scaling`` names a scaler to fit on the
    training rows; it is saved with the detector. ``df`` is evaluated once, into a table in the shared work
    folder that the fit and the preparation scan. The prepared rows are written once
    with their split, to ``split_path`` or the shared work folder, and every later
    step reads that table. Pass ``cache=False`` when ``df`` is a plain scan of a
    stored table.
    """
    spark = df.sparkSession
    if cache:
        df = ordering.stored(df, "training-input")
    if raw:
        fitted = RawFlowAdapter((key,)).fit(df, cache=False)
    else:
        fitted = FlowPreprocessor(target, (key,), repair_infinite).fit(df, cache=False)
    processed = profile.normalize_labels(fitted.transform(df), target)
    path = split_path or work_path(spark, "training")
    sampling.split_three_way(processed, key, target).write.mode("overwrite").partitionBy("split").parquet(path)
    stored = spark.read.parquet(path)
    features = S.numeric_columns(processed, (key, target)) if raw else fitted.features
    steps = [fitted]
    if scaling:
        scaler = fit_scaler(stored.filter(F.col("split") == "train"), features, scaling)
        stored = scaler.transform(stored)
        steps.append(scaler)
    return train_on_split(stored, features, target, learner, settings, weighted, with_stage_one, steps)


def training_job(
    spark: SparkSession,
    data: str,
    key: str,
    model: str,
    registry: str | None = None,
    runs: str | None = None,
    strategy: str = "original",
    target: str = S.TARGET,
    fmt: str = "auto",
    **options,
) -> Training:
    """Load a table, train, save the detector, register it and record the run."""
    result = train_detector(tables.load_table(spark, data, fmt), key, target, cache=False, **options)
    result.detector.save(spark, model)
    tables.save_report(result.report, f"{model}/reports/classes")
    tables.save_report(result.confusion, f"{model}/reports/confusion")
    tables.save_report(result.importance, f"{model}/reports/importance")
    if registry:
        register_model(spark, registry, strategy, model)
    if runs:
        result.record(spark, runs, strategy, model)
    return result


def compare_strategies(
    datasets: dict[str, DataFrame],
    key: str,
    runs: str,
    target: str = S.TARGET,
    learner: str = "forest",
    settings: TreeSettings | None = None,
    weighted: bool = True,
    registry: str | None = None,
    with_stage_one: bool = False,
) -> tuple[DataFrame, dict[str, str]]:
    """Train on each dataset's train rows, test on its test rows, and rank them.

    Each dataset is a stored table with numeric features and ``split``. With ``registry`` each strategy's detector is
    saved as a version under the strategy's name, so that the winner can be loaded. Returns the winners per metric and
    what became of each strategy; one that fails, for whatever reason, does not stop the others.
    """
    if not datasets:
        raise ValueError("no dataset to compare")
    outcome, spark = {}, next(iter(datasets.values())).sparkSession
    for strategy, dataset in datasets.items():
        features = S.numeric_columns(dataset, (key, target, "draw"))
        try:
            result = train_on_split(dataset, features, target, learner, settings, weighted, with_stage_one)
            model = None
            if registry:
                reports = {"classes": result.report, "confusion": result.confusion, "importance": result.importance}
                model = ModelRegistry(spark, registry).save(strategy, result.detector, reports, result.test)
            result.record(spark, runs, strategy, model)
            outcome[strategy] = "trained"
        except (ValueError, PySparkException, Py4JJavaError) as error:
            outcome[strategy] = f"failed: {(str(error).splitlines() or [type(error).__name__])[0]}"
    if "trained" not in outcome.values():
        raise ValueError(f"no strategy could be trained: {outcome}")
    return evaluate.compare_strategies(training_runs(spark, runs)), outcome
