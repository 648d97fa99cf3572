"""Tree learners for the two stages, with probabilities as plain arrays."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import stats
from ..session import work_path
from .quality import require_columns

VECTOR = "_features"
MAX_CLASSES = 1000
LEARNERS = ("forest", "boosted")
#: Rows that the learners which run at the same time hold together, a copy each; one learner runs whatever it holds.
ROWS_AT_ONCE = 20_000_000


@dataclass
class TreeSettings:
    """Size and randomness of the learners."""

    trees: int = 100
    depth: int = 6
    learning_rate: float = 0.1
    row_share: float = 0.8
    feature_share: float = 0.8
    seed: int = S.SEED
    max_bins: int = 32
    memory_mb: int = 512
    # set to a column from validation_indicator to stop boosting early
    validation_column: str | None = None
    validation_tolerance: float = 0.01

    def forest(self) -> RandomForestClassifier:
        return RandomForestClassifier(
            numTrees=self.trees,
            maxDepth=self.depth,
            subsamplingRate=self.row_share,
            featureSubsetStrategy=str(self.feature_share),
            seed=self.seed,
            maxBins=self.max_bins,
            maxMemoryInMB=self.memory_mb,
        )

    def boosted(self) -> GBTClassifier:
        learner = GBTClassifier(
            maxIter=self.trees,
            maxDepth=self.depth,
            stepSize=self.learning_rate,
            subsamplingRate=self.row_share,
            featureSubsetStrategy=str(self.feature_share),
            seed=self.seed,
            maxBins=self.max_bins,
            maxMemoryInMB=self.memory_mb,
            validationTol=self.validation_tolerance,
        )
        return learner.setValidationIndicatorCol(self.validation_column) if self.validation_column else learner


def class_list(df: DataFrame, target: str = S.TARGET, max_classes: int = MAX_CLASSES) -> list[str]:
    """Sorted distinct labels; their positions are the class codes.

    More than ``max_classes`` of them are an error, since every class is part of each row's probabilities.
    """
    rows = df.select(target).filter(F.col(target).isNotNull()).distinct().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} distinct labels in {target}")
    return sorted(r[0] for r in rows)


def class_code(target: str, classes: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)) - 1).cast("double")


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid="keep")


def training_columns(
    df: DataFrame, features: list[str], target: str = S.TARGET, weight: str | None = None, settings: TreeSettings | None = None
) -> DataFrame:
    """The labelled rows as the learners read them: features as one vector, target, weight and validation column.

    Both stages take such rows as they are, so they can be kept and shared.
    """
    extra = [c for c in (weight, (settings or TreeSettings()).validation_column) if c]
    if VECTOR in df.columns:
        return require_columns(df, [target, *extra]).select(VECTOR, target, *extra)
    require_columns(df, [*features, target, *extra])
    return _assembler(features).transform(df.filter(F.col(target).isNotNull())).select(VECTOR, target, *extra)


def fit_at_once(spark: SparkSession, fits: list[Callable], at_once: int) -> list:
    """Results of ``fits`` in their order, up to ``at_once`` running at a time.

    A learner is a long row of short jobs, which leave cores idle that another one's jobs can use.
    """
    with ThreadPoolExecutor(max(1, min(len(fits), at_once))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fit)) for fit in fits]]


@dataclass
class StageOne:
    """Benign or attack."""

    features: list[str]
    model: PipelineModel

    def score(self, df: DataFrame, prediction: str = "stage1_prediction") -> DataFrame:
        """Add 0 for benign and 1 for attack."""
        scored = self.model.transform(df)
        return scored.select(*df.columns, F.col("prediction").cast("int").alias(prediction))


def train_stage_one(
    df: DataFrame,
    features: list[str],
    target: str = S.TARGET,
    settings: TreeSettings | None = None,
    weight: str | None = None,
) -> StageOne:
    """Boosted trees on normal against everything else."""
    settings = settings or TreeSettings()
    data = training_columns(df, features, target, weight, settings).withColumn(
        "_code", F.when(F.col(target) == S.NORMAL, 0.0).otherwise(1.0)
    )
    learner = settings.boosted().setLabelCol("_code").setFeaturesCol(VECTOR)
    if weight:
        learner = learner.setWeightCol(weight)
    fitted = learner.fit(data)
    return StageOne(features, PipelineModel([_assembler(features), fitted]))


@dataclass
class StageTwo:
    """Class probabilities in the order of ``classes``."""

    features: list[str]
    classes: list[str]
    learner: str
    model: PipelineModel
    trained: bool = field(default=True)

    def score(self, df: DataFrame, probabilities: str = "probabilities", where: Column | None = None) -> DataFrame:
        """Add the probability array; it sums to one.

        Rows for which ``where`` does not hold get NULL. Nothing else uses the learner's output, so the optimizer
        moves it into the branch and the trees are not walked for those rows.
        """
        wanted = (lambda c: c) if where is None else (lambda c: F.when(where, c))
        if self.learner == "forest":
            scored = self.model.transform(df)
            return scored.select(*df.columns, wanted(vector_to_array("probability")).alias(probabilities))
        scored = self.model.transform(df)
        raw = F.array(*[vector_to_array(f"_probability{i}")[1] for i in range(len(self.classes))])
        scored = scored.select(*df.columns, wanted(raw).alias("_raw"))
        total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
        even = F.lit(1.0 / len(self.classes))
        normal = F.transform("_raw", lambda x: F.when(total > 0, x / total).otherwise(even))  # NULL stays NULL
        return scored.select(*df.columns, normal.alias(probabilities))

    def predict(self, df: DataFrame, label: str = "label") -> DataFrame:
        """Add the probabilities and the most probable class."""
        scored = self.score(df)
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return scored.withColumn(label, F.element_at(F.array(*[F.lit(c) for c in self.classes]), best))

    def tree_models(self):
        return [s for s in self.model.stages if not isinstance(s, VectorAssembler)]


def without_summary(model):
    """A fitted forest without the summary of its training.

    The summary holds the session and the training rows, and would travel with every task that scores; once the session
    has observed a write it cannot even be serialised.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def train_stage_two(
    df: DataFrame,
    features: list[str],
    target: str = S.TARGET,
    learner: str = "forest",
    settings: TreeSettings | None = None,
    weight: str | None = None,
    classes: list[str] | None = None,
) -> StageTwo:
    """A multiclass forest, or one boosted model per class against the rest."""
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner: {learner}")
    settings = settings or TreeSettings()
    classes = classes or class_list(df, target)
    data = training_columns(df, features, target, weight, settings)
    if learner == "forest":
        coded = data.withColumn("_code", class_code(target, classes))
        trainer = settings.forest().setLabelCol("_code").setFeaturesCol(VECTOR)
        fitted = [without_summary((trainer.setWeightCol(weight) if weight else trainer).fit(coded))]
    else:
        with stats.scratch(data) as kept:

            def against_the_rest(i: int, c: str):
                coded = kept.withColumn("_code", F.when(F.col(target) == c, 1.0).otherwise(0.0))
                trainer = settings.boosted().setLabelCol("_code").setFeaturesCol(VECTOR)
                model = (trainer.setWeightCol(weight) if weight else trainer).fit(coded)
                model = model.setProbabilityCol(f"_probability{i}").setPredictionCol(f"_prediction{i}")
                return model.setRawPredictionCol(f"_score{i}")

            at_once = ROWS_AT_ONCE // max(1, kept.count())
            fitted = fit_at_once(kept.sparkSession, [partial(against_the_rest, i, c) for i, c in enumerate(classes)], at_once)
    return StageTwo(features, classes, learner, PipelineModel([_assembler(features), *fitted]))


def feature_importance(stage: StageTwo, spark, kind: str = "split") -> DataFrame:
    """(``feature``, ``importance``), highest first; unused features have 0.

    ``split`` counts the splits on a feature over all trees, ``gain`` is the
    normalised impurity gain.
    """
    names = spark.createDataFrame(
        list(enumerate(stage.features)), "feature_index int, feature string"
    )
    if kind == "gain":
        totals = [0.0] * len(stage.features)
        for model in stage.tree_models():
            for i, v in enumerate(model.featureImportances.toArray()):
                totals[i] += float(v) / len(stage.tree_models())
        scores = spark.createDataFrame(list(enumerate(totals)), "feature_index int, score double")
    elif kind == "split":
        nodes = None
        for model in stage.tree_models():
            path = work_path(spark, "trees")
            model.save(path)
            table = spark.read.parquet(f"{path}/data").select("nodeData.*")
            used = table.filter("leftChild >= 0").select(F.col("split.featureIndex").alias("feature_index"))
            nodes = used if nodes is None else nodes.unionByName(used)
        scores = nodes.groupBy("feature_index").agg(F.count("*").cast("double").alias("score"))
    else:
        raise ValueError(f"unknown importance: {kind}")
    return (
        names.join(scores, "feature_index", "left")
        .select("feature", F.coalesce("score", F.lit(0.0)).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
