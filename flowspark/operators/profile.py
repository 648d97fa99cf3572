"""Profiles of a table: label distribution, imbalance, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars, stats

TOP_VALUES = 10


def label_counts(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Rows and percentage per label."""
    counts = df.groupBy(F.col(target).alias("label")).agg(F.count("*").alias("rows"))
    # one row per label, so the global window stays small
    return counts.withColumn("percentage", F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()))


def verdict(ratio: Column, moderate: bool = True) -> Column:
    """Balance verdict of a min/max ratio; ``moderate`` adds the fourth level."""
    out = F.when(ratio > 0.5, "balanced").when(ratio > 0.2, "mild")
    if moderate:
        out = out.when(ratio > 0.1, "moderate")
    return out.otherwise("severe")


def imbalance_report(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """One row: totals, extreme class sizes, their ratios and both verdicts."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    ratio = F.col("min_rows") / F.col("max_rows")
    return counts.agg(
        F.sum("n").alias("total_rows"),
        F.count("*").alias("class_count"),
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
    ).select(
        "*",
        ratio.alias("imbalance_ratio"),
        (F.col("max_rows") / F.col("min_rows")).alias("max_min_ratio"),
        verdict(ratio).alias("verdict"),
        verdict(ratio, moderate=False).alias("verdict_three_level"),
    )


def class_weights(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """(``label``, ``weight``) with weight = rows / (classes x class rows)."""
    counts = df.groupBy(F.col(target).alias("label")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    weight = F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))
    return counts.select("label", weight.alias("weight"))


def with_sample_weights(
    df: DataFrame, weights: DataFrame, target: str = S.TARGET, weight: str = "sample_weight", max_labels: int = 10_000
) -> DataFrame:
    """Each row with the weight of its label.

    A table of up to ``max_labels`` weights is broadcast; a longer one is joined by
    size, with AQE splitting hot labels.
    """
    side = weights.select(F.col("label").alias("_label"), F.col("weight").alias(weight))
    rows = side.limit(max_labels + 1).collect()
    if len(rows) <= max_labels:
        side = F.broadcast(df.sparkSession.createDataFrame(rows, side.schema))
    return df.join(side, F.col(target).eqNullSafe(F.col("_label")), "left").drop("_label")


def describe_numeric(df: DataFrame, columns=None, cache: bool = True, **limits) -> DataFrame:
    """Count, missing, mean, deviation, extremes and exact quartiles per column.

    Where an infinity makes the deviation undefined it is NULL.
    """
    columns = list(columns or S.numeric_columns(df))
    with stats.scratch(stats.clean_nan(df.select(*[F.col(f"`{c}`") for c in columns]), columns), cache) as values:
        measures = []
        for c in columns:
            v = F.col(f"`{c}`").cast("double")
            measures.append(
                F.struct(
                    F.count(v).alias("n"),
                    F.count_if(v.isNull()).alias("missing"),
                    F.avg(v).alias("mean"),
                    scalars.nan_to_null(F.stddev_samp(v)).alias("std"),
                    F.min(v).alias("min"),
                    F.max(v).alias("max"),
                ).alias(f"s{columns.index(c)}")
            )
        row = values.agg(F.count("*").alias("n"), *measures).first()
        q = stats.quantiles(values, {c: [0.25, 0.5, 0.75] for c in columns}, row["n"], **limits)
    rows = [
        (c, r["n"], r["missing"], r["mean"], r["std"], r["min"], *q[c], r["max"])
        for c, r in zip(columns, row[1:])
    ]
    schema = (
        "column_name string, non_missing bigint, missing bigint, mean double, std double, "
        "min double, p25 double, median double, p75 double, max double"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def categorical_summary(df: DataFrame, columns=None, top: int = TOP_VALUES) -> DataFrame:
    """Distinct count, most frequent value and the ``top`` values per text column."""
    columns = list(columns or S.string_columns(df))
    counts = stats.value_counts(df, columns)
    order = Window.partitionBy("column_name").orderBy(F.desc("rows"), "value")
    # the filter lets Spark keep only ``top`` rows per task before the shuffle
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    per_column = counts.groupBy("column_name").agg(
        F.count("*").alias("unique_count"),
        F.min_by("value", F.struct((-F.col("rows")).alias("n"), F.col("value"))).alias("most_frequent"),
    )
    return best.join(per_column, "column_name")


def target_distribution(df: DataFrame, candidates=S.TARGET_CANDIDATES) -> DataFrame:
    """Label counts of the first candidate column that is present."""
    for c in candidates:
        if c in df.columns:
            return label_counts(df.filter(F.col(c).isNotNull()), c).select(F.lit(c).alias("column_name"), "label", "rows")
    raise ValueError(f"none of the columns {list(candidates)} is present")


def column_types(df: DataFrame) -> DataFrame:
    """(``position``, ``column_name``, ``data_type``) of the schema."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def data_summary(df: DataFrame) -> dict[str, DataFrame]:
    """Schema, missing values, numeric summary and target distribution as tables."""
    from .quality import missing_counts

    out = {"columns": column_types(df), "missing": missing_counts(df)}
    if S.numeric_columns(df):
        out["numeric"] = describe_numeric(df)
    if any(c in df.columns for c in S.TARGET_CANDIDATES):
        out["target"] = target_distribution(df)
    return out


def feature_summary(df: DataFrame) -> dict[str, DataFrame]:
    """The data summary and the summary of the text columns."""
    out = data_summary(df)
    out.pop("target", None)
    if S.string_columns(df):
        out["categorical"] = categorical_summary(df)
    return out


def label_audit(df: DataFrame, target: str = S.TARGET, known=tuple(S.CLASS_BY_CODE.values())) -> DataFrame:
    """Rows per label and whether the label is in the vocabulary."""
    counts = df.groupBy(F.col(target).alias("label")).agg(F.count("*").alias("rows"))
    return counts.withColumn("is_known", F.coalesce(F.col("label").isin(*known), F.lit(False)))


def normalize_labels(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Unknown labels replaced by ``normal``."""
    return df.withColumn(target, scalars.known_label(target))


def split_statistics(df: DataFrame, split: str = "split", target: str = S.TARGET) -> DataFrame:
    """Rows and share per split and label."""
    counts = df.groupBy(split, F.col(target).alias("label")).agg(F.count("*").alias("rows"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy(split))
    return counts.withColumn("share", share)


def file_statistics(df: DataFrame, file: str, target: str = S.TARGET, caps=None, default: int = S.DEFAULT_CLASS_CAP) -> DataFrame:
    """Rows per source file against the cap of its class and the small-class limit."""
    from .sampling import class_cap

    counts = df.groupBy(file, target).agg(F.count("*").alias("original_count"))
    return counts.select(
        F.col(file).alias("file_name"),
        F.col(target).alias("label"),
        "original_count",
        class_cap(target, caps, default).alias("target_max"),
        F.lit(S.SMALL_CLASS_WARNING).cast("bigint").alias("target_min"),
    )
