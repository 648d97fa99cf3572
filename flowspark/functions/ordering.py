"""Seeded, reproducible row order and draws.

The order of a row depends only on the seed and its key, so it is the same on
every engine and after every retry. The digest is uniform, which makes its prefix
an even bucket number: ranks over a whole class come from a small histogram plus
ranks inside one bucket, never from one sort of the class.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_path

BUCKET_DIGITS = 4
DRAW_DIGITS = 15
MAX_STRATA = 10_000
BEFORE_ALL, PAST_ALL = "", "g"  # sort before and after every digest


def digest(seed: int, *parts) -> Column:
    """md5 of ``seed:part:...`` as 32 hex digits."""
    texts = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def draw(seed: int, *parts) -> Column:
    """A 60-bit integer drawn from the seed and the parts."""
    return F.conv(F.substring(digest(seed, *parts), 1, DRAW_DIGITS), 16, 10).cast("bigint")


def draw_below(n, seed: int, *parts) -> Column:
    """An integer in ``0 .. n - 1``."""
    return F.pmod(draw(seed, *parts), n)


def unit_draw(seed: int, *parts) -> Column:
    """A double in [0, 1) with 32 random bits."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def with_order(df: DataFrame, stratum: list[str], key: str, seed: int, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Add ``_stratum``, ``_digest`` and its ``_bucket`` prefix.

    The stratum is one struct, in which NULL equals NULL.
    """
    return df.withColumns(
        {
            "_stratum": F.struct(*[F.col(f"`{c}`") for c in stratum]) if stratum else F.struct(F.lit(0)),
            "_digest": digest(seed, key),
            "_bucket": F.substring(digest(seed, key), 1, digits),
        }
    )


def bucket_starts(ordered: DataFrame) -> DataFrame:
    """Per stratum and bucket: rows in it, rows before it and the stratum's total.

    Bounded by strata x 16^digits rows, whatever the size of the table.
    """
    histogram = ordered.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy("_stratum")
    return histogram.withColumn(
        "_start",
        F.sum("_rows").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"),
    ).withColumn("_total", F.sum("_rows").over(whole))


def with_rank(
    df: DataFrame,
    stratum: list[str],
    key: str,
    seed: int,
    digits: int = BUCKET_DIGITS,
    with_repeats: bool = False,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Add ``rank`` (1-based, within the stratum) and ``stratum_rows``.

    ``with_repeats`` adds ``repeated``: whether the next row of the stratum has the same key. ``starts`` are the
    ``bucket_starts`` of these rows, if they are known already.

    ``key`` must identify a row. The window and the join share one partitioning by
    (stratum, bucket), so a stratum with most of the rows is spread over all tasks.
    """
    ordered = with_order(df, stratum, key, seed, digits)
    starts = (bucket_starts(ordered) if starts is None else starts).drop("_rows")
    inside = Window.partitionBy("_stratum", "_bucket").orderBy("_digest", key)
    repeated = F.coalesce(F.lead(key).over(inside) == F.col(key), F.lit(False))
    ranked = ordered.withColumn("_inside", F.row_number().over(inside)).withColumn("_repeated", repeated)
    flag = [F.col("_repeated").alias("repeated")] if with_repeats else []
    return ranked.join(starts, ["_stratum", "_bucket"]).select(
        *df.columns,
        (F.col("_start") + F.col("_inside")).alias("rank"),
        F.col("_total").alias("stratum_rows"),
        *flag,
    )


def stored(df: DataFrame, name: str = "order") -> DataFrame:
    """``df`` as a table in the shared folder: unlike a checkpoint, writing it evaluates it once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_part(
    df: DataFrame,
    stratum: list[str],
    key: str,
    seed: int,
    cuts: list[Callable[[Column], Column]],
    max_strata: int = MAX_STRATA,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``part``: how many of the cut ranks lie before the row in its stratum.

    Each cut maps the stratum's row count (and its columns) to a rank; part 0 holds
    the rows up to the first cut, and so on. Sizes are exact. ``key`` must identify
    a row.

    Up to ``max_strata`` strata, a histogram finds the bucket that each cut goes
    through and a second narrow pass the row at the cut in that bucket; the result
    then compares every row with its stratum's cut rows, without a shuffle. Beyond
    it every row is ranked by ``with_rank``. Strata, keys and digests are stored once, so ``df`` is evaluated for them and
    for the result, not once per pass.
    """
    slim = stored(with_order(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*stratum, key])]), stratum, key, seed, digits))
    starts = counted = bucket_starts(slim)
    if stratum:
        starts = starts.select("*", *[F.col(f"_stratum.`{c}`").alias(c) for c in stratum])
    total, end = F.col("_total"), F.col("_start") + F.col("_rows")
    crossed = [(F.col("_start") < cut(total)) & (cut(total) <= end) & (cut(total) < total) for cut in cuts]
    per_stratum = starts.groupBy("_stratum").agg(
        *[
            F.struct(
                F.max(F.when(on, F.col("_bucket"))).alias("bucket"),
                F.max(F.when(on, cut(total) - F.col("_start"))).alias("need"),
                F.max(cut(total) <= 0).alias("none"),
            ).alias(f"cut{i}")
            for i, (cut, on) in enumerate(zip(cuts, crossed))
        ]
    )
    found = per_stratum.limit(max_strata + 1).collect()
    if len(found) > max_strata:
        ranked = with_rank(df, stratum, key, seed, digits, True, counted)
        passed = [
            F.when(
                (F.col("rank") == cut(F.col("stratum_rows"))) & F.col("repeated"),
                F.raise_error(F.lit(f"{key} does not identify a row, so a sample of exact size is not defined")).cast("int"),
            )
            .when(F.col("rank") > cut(F.col("stratum_rows")), 1)
            .otherwise(0)
            for cut in cuts
        ]
        return ranked.select(*df.columns, reduce(lambda a, b: a + b, passed).alias("part"))
    if not found:
        return df.withColumn("part", F.lit(0))
    edges = _rows_at_cuts(slim, key, found, len(cuts))
    return _compare_with_edges(df, stratum, key, seed, edges, len(cuts))


def _rows_at_cuts(slim: DataFrame, key: str, found: list, cuts: int) -> DataFrame:
    """One row per stratum with the (digest, key) of the last row before each cut."""
    spark, types = slim.sparkSession, {f.name: f.dataType for f in slim.schema.fields}
    wanted: dict = {}
    for row in found:
        for i in range(cuts):
            cut = row[f"cut{i}"]
            if cut["bucket"] is not None:
                wanted.setdefault((row["_stratum"], cut["bucket"]), set()).add(cut["need"])
    at = {}
    if wanted:
        schema = T.StructType(
            [
                T.StructField("_stratum", types["_stratum"]),
                T.StructField("_bucket", T.StringType()),
                T.StructField("_needs", T.ArrayType(T.LongType())),
            ]
        )
        # at most one row per stratum and cut
        needs = spark.createDataFrame([(s, b, sorted(n)) for (s, b), n in wanted.items()], schema)
        inside = Window.partitionBy("_stratum", "_bucket").orderBy("_digest", key)
        edge = (
            slim.join(F.broadcast(needs), ["_stratum", "_bucket"])
            .withColumns(
                {
                    "_inside": F.row_number().over(inside).cast("bigint"),
                    "_repeated": F.coalesce(F.lead(key).over(inside) == F.col(key), F.lit(False)),
                }
            )
            .filter(F.array_contains("_needs", F.col("_inside")))
            .select("_stratum", "_bucket", "_inside", "_digest", "_repeated", F.col(key).alias("_key"))
        ).collect()
        if any(r["_repeated"] for r in edge):
            raise ValueError(f"{key} does not identify a row, so a sample of exact size is not defined")
        at = {(r["_stratum"], r["_bucket"], r["_inside"]): (r["_digest"], r["_key"]) for r in edge}
    rows = []
    for row in found:
        edges = []
        for i in range(cuts):
            cut = row[f"cut{i}"]
            beyond = BEFORE_ALL if cut["none"] else PAST_ALL
            edges.append(at.get((row["_stratum"], cut["bucket"], cut["need"]), (beyond, None)))
        rows.append((row["_stratum"], *edges))
    edge_type = T.StructType([T.StructField("digest", T.StringType()), T.StructField("key", types[key])])
    return spark.createDataFrame(
        rows,
        T.StructType(
            [T.StructField("_stratum", types["_stratum"])]
            + [T.StructField(f"_edge{i}", edge_type) for i in range(cuts)]
        ),
    )


def _compare_with_edges(df, stratum, key, seed, edges: DataFrame, cuts: int) -> DataFrame:
    ordered = with_order(df, stratum, key, seed)
    # at most ``max_strata`` rows
    placed = ordered.join(F.broadcast(edges), "_stratum")
    passed = []
    for i in range(cuts):
        edge_digest, edge_key = F.col(f"_edge{i}.digest"), F.col(f"_edge{i}.key")
        after = (F.col("_digest") > edge_digest) | ((F.col("_digest") == edge_digest) & (F.col(f"`{key}`") > edge_key))
        passed.append(F.when(after, 1).otherwise(0))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], reduce(lambda a, b: a + b, passed).alias("part"))
