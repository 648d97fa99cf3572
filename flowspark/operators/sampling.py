"""Exact, seeded sampling, rebalancing and splitting.

Every operator orders rows by a seeded digest of their ``key``, which must
identify a row. Sizes are exact and membership is the same after every retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ordering import MAX_STRATA, digest, draw_below, with_part, with_rank
from ..functions.scalars import lookup

PARTS_PER_UNIT = 1_000_000
COPIES_PER_CHUNK = 10_000


def share_of(total: Column, ratio: float) -> Column:
    """``ratio`` of ``total`` rounded half up, in whole-number arithmetic."""
    parts = round(ratio * PARTS_PER_UNIT)
    return F.call_function("div", total * F.lit(parts) + F.lit(PARTS_PER_UNIT // 2), F.lit(PARTS_PER_UNIT))


def first_rows(df: DataFrame, stratum: list[str], key: str, size, seed: int = S.SEED, **limits) -> DataFrame:
    """At most ``size`` rows of each stratum; ``size`` is a number or a column of it."""
    cut = size if isinstance(size, Column) else F.lit(int(size))
    return with_part(df, stratum, key, seed, [lambda total: cut], **limits).filter("part = 0").drop("part")


def class_cap(target: str = S.TARGET, caps=None, default: int = S.DEFAULT_CLASS_CAP) -> Column:
    return F.coalesce(lookup(target, caps or S.CLASS_CAPS), F.lit(default)).cast("bigint")


def cap_per_file(df: DataFrame, file: str, key: str, size, seed: int = S.SEED, **limits) -> DataFrame:
    """At most ``size`` rows of each source file."""
    return first_rows(df, [file], key, size, seed, **limits)


def cap_per_class(
    df: DataFrame,
    key: str,
    file: str | None = None,
    target: str = S.TARGET,
    caps=None,
    default: int = S.DEFAULT_CLASS_CAP,
    seed: int = S.SEED,
    **limits,
) -> DataFrame:
    """Class caps within each file, then again over all files of a class."""
    cap = class_cap(target, caps, default)
    if file is not None:
        df = first_rows(df, [file, target], key, cap, seed, **limits)
    return first_rows(df, [target], key, cap, seed, **limits)


def small_classes(df: DataFrame, target: str = S.TARGET, minimum: int = S.SMALL_CLASS_WARNING) -> DataFrame:
    """Classes below ``minimum`` rows, which are kept whole."""
    return df.groupBy(target).agg(F.count("*").alias("rows")).filter(F.col("rows") < minimum)


def undersample(df: DataFrame, key: str, target: str = S.TARGET, seed: int = S.SEED, **limits) -> DataFrame:
    """Every class cut to the size of the smallest."""
    smallest = df.groupBy(target).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    return first_rows(df, [target], key, smallest or 0, seed, **limits)


def balance_to_target(
    df: DataFrame, key: str, size: int = 50_000, target: str = S.TARGET, seed: int = S.SEED, **limits
) -> DataFrame:
    """Every class brought to exactly ``size`` rows; adds ``copy``.

    Larger classes are sampled without replacement. Smaller ones keep their rows
    (``copy`` 0) and get draws with replacement (``copy`` 1, 2, ... per row). The
    draws are counted per drawn row before they meet the data, so a class of one
    row costs one joined row however often it is repeated.
    """
    kept = first_rows(df, [target], key, size, seed, **limits)
    counts = df.groupBy(F.col(target).alias("_class")).agg(F.count("*").alias("_rows"))
    small = counts.filter(F.col("_rows") < size).withColumn("_needed", F.lit(size) - F.col("_rows"))
    rows = small.limit(MAX_STRATA + 1).collect()
    if len(rows) <= MAX_STRATA:
        # few classes: their rows are filtered, not joined, out of the table
        names = [r["_class"] for r in rows]
        grows = F.col(target).isin([n for n in names if n is not None])
        if None in names:
            grows = F.coalesce(grows, F.lit(False)) | F.col(target).isNull()
        growing = df.filter(grows)
        small = df.sparkSession.createDataFrame(rows, small.schema)
    else:
        growing = df.join(small.select("_class"), F.col(target).eqNullSafe(F.col("_class")), "left_semi")
    chunks = small.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_needed") - 1) / COPIES_PER_CHUNK)))
    ).repartition("_class", "_chunk")
    first = F.col("_chunk") * COPIES_PER_CHUNK + 1
    last = F.least(first + COPIES_PER_CHUNK - 1, F.col("_needed"))
    times = (
        chunks.withColumn("_i", F.explode(F.sequence(first, last)))
        .withColumn("_row", draw_below(F.col("_rows"), seed, "_class", "_i") + 1)
        .groupBy("_class", "_row")
        .agg(F.count("*").alias("_times"))
    )
    # only the classes that grow are ranked
    ranked = with_rank(growing, [target], key, seed)
    drawn = ranked.join(times, F.col(target).eqNullSafe(F.col("_class")) & (F.col("rank") == F.col("_row")))
    copies = repeat_rows(drawn.select(*df.columns, "_times"), F.col("_times"), key).drop("_times")
    return kept.withColumn("copy", F.lit(0).cast("bigint")).unionByName(copies)


def repeat_rows(df: DataFrame, times: Column, key: str) -> DataFrame:
    """Each row ``times`` times with ``copy`` 1, 2, ...

    A row of many copies is first cut into chunks that are spread over the tasks.
    """
    chunks = df.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((times - 1) / COPIES_PER_CHUNK)))
    ).repartition(key, "_chunk")
    first = F.col("_chunk") * COPIES_PER_CHUNK + 1
    last = F.least(first + COPIES_PER_CHUNK - 1, times)
    return chunks.withColumn("copy", F.explode(F.sequence(first, last))).drop("_chunk")


# --- splits -----------------------------------------------------------------------


def split_column(
    df: DataFrame,
    key: str,
    ratios: list[tuple[str, float]],
    stratum: str | None = S.TARGET,
    seed: int = S.SEED,
    **limits,
) -> DataFrame:
    """Add ``split``: names in rank order by their ratios; the last gets the rest."""
    names = [name for name, _ in ratios]
    ends, total_ratio = [], 0.0
    for _, ratio in ratios[:-1]:
        total_ratio += ratio
        ends.append(lambda total, r=total_ratio: share_of(total, r))
    parts = with_part(df, [stratum] if stratum else [], key, seed, ends, **limits)
    return parts.withColumn(
        "split", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("part") + 1)
    ).drop("part")


def split_train_test(
    df: DataFrame,
    key: str,
    test_ratio: float = 0.2,
    stratify: bool = True,
    target: str = S.TARGET,
    seed: int = S.SEED,
    **limits,
) -> DataFrame:
    """Add ``split`` = test or train; stratified sizes are exact per class."""
    ratios = [("test", test_ratio), ("train", 1 - test_ratio)]
    return split_column(df, key, ratios, target if stratify else None, seed, **limits)


def split_three_way(df: DataFrame, key: str, target: str | None = S.TARGET, seed: int = S.SEED, **limits) -> DataFrame:
    """Add ``split`` = train, validation or test, 70/15/15."""
    ratios = [("train", S.TRAIN_RATIO), ("validation", S.VALIDATION_RATIO), ("test", S.TEST_RATIO)]
    return split_column(df, key, ratios, target, seed, **limits)


def validation_indicator(df: DataFrame, key: str, share: float = 0.2, target: str = S.TARGET, seed: int = S.SEED) -> DataFrame:
    """Add the boolean ``is_validation`` that boosted learners take."""
    marked = split_train_test(df, key, share, True, target, seed)
    return marked.withColumn("is_validation", F.col("split") == "test").drop("split")


def shuffle_rows(df: DataFrame, key: str, seed: int = S.SEED) -> DataFrame:
    """All rows in seeded order, with their 1-based ``position``."""
    return with_rank(df, [], key, seed).withColumnRenamed("rank", "position").drop("stratum_rows")


def shuffled(df: DataFrame, key: str, seed: int = S.SEED) -> DataFrame:
    """All rows sorted in seeded order."""
    return df.orderBy(digest(seed, key), key)
