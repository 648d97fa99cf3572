import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.functions import ordering, stats
from flowspark.operators import encoding


def table(spark, columns):
    n = max(len(v) for v in columns.values())
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(4)


def samples():
    rng = random.Random(5)
    return {
        "even": [float(i) for i in range(1000)],
        "hot": [7.0] * 600 + [rng.random() * 10 for _ in range(400)],
        "few": [3.0, 1.0, 2.0, 10.0],
        "skewed": [math.exp(rng.random() * 20) for _ in range(777)],
        "infinite": [float("inf")] * 300 + [float(i) for i in range(700)],
        "constant": [4.0] * 50,
        "one": [5.5],
    }


@pytest.mark.parametrize("limits", [{}, {"one_aggregate_cells": 0}, {"one_aggregate_cells": 0, "leaf_rows": 3}])
def test_quantiles_equal_numpy(spark, limits):
    columns = samples()
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = stats.quantiles(table(spark, columns), {c: shares for c in columns}, **limits)
    for c, v in columns.items():
        # numpy makes inf - inf of two equal infinities, so a huge number stands in
        expected = np.percentile(np.minimum(v, 1e300), [p * 100 for p in shares], method="linear")
        assert np.minimum(got[c], 1e300) == pytest.approx(expected, rel=1e-12), c


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"))] * 3, "a double, b double")
    for cells in (0, 1000):
        assert stats.quantiles(df, {"a": [0.5], "b": [0.25, 0.75]}, one_aggregate_cells=cells) == {
            "a": [None], "b": [None, None],
        }
    assert stats.quantiles(df, {}) == {}


def test_quantiles_of_first_quartile(spark):
    assert stats.quartiles(table(spark, {"few": [3.0, 1.0, 2.0, 10.0]}), ["few"]) == {"few": [1.75, 4.75]}


def test_modes(spark):
    df = spark.createDataFrame(
        [("b", 2, 1.5), ("a", 2, float("nan")), ("a", 1, float("nan")), ("b", 1, 2.5), (None, None, None)],
        "s string, n int, d double",
    ).withColumn("empty", F.lit(None).cast("string"))
    assert stats.modes(df, ["s", "n", "d", "empty"]) == {"s": "a", "n": 1, "d": 1.5, "empty": None}


def test_quantiles_stay_exact_beyond_sketches(spark, monkeypatch):
    """Many rows against small sketches: several passes, pivots that miss, integers, floats and the same bits."""
    monkeypatch.setattr(stats, "SKETCH_ITEMS", 16)
    df = spark.range(60_000).select(
        (F.xxhash64("id") % 1_000_000_007).alias("spread"),
        F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).cast("int").alias("hot"),
        (F.sqrt(F.col("id")) / 7).cast("float").alias("low"),
        F.when(F.col("id") % 11 == 0, F.lit(float("inf"))).otherwise(-F.col("id") / 3).alias("open"),
    )
    shares = [0.0, 0.25, 0.5, 0.75, 0.999]
    wanted = {c: shares for c in df.columns}
    assert stats.quantiles(df, wanted, one_aggregate_cells=0, leaf_rows=50) == stats.quantiles(df, wanted)


def test_order_statistics_take_few_passes(spark, monkeypatch):
    passes = []
    first = stats._pivots
    monkeypatch.setattr(stats, "_pivots", lambda df, wide: passes.append(len(wide)) or first(df, wide))
    df = spark.range(2_000_000).select(F.xxhash64("id").cast("double").alias("x"))
    stats.quartiles(df, ["x"], one_aggregate_cells=0)
    assert passes == [1]  # then one pass over short ranges


@pytest.mark.parametrize("cells", [0, 10**9])
def test_modes_of_frequent_and_unique_values(spark, cells):
    df = spark.range(20_000).select(
        F.concat(F.lit("u"), (F.lit(99_999) - F.col("id")).cast("string")).alias("unique"),
        F.when(F.col("id") % 4 == 0, "b").when(F.col("id") % 4 == 1, "a").alias("tie"),
        F.when(F.col("id") % 100 == 3, 7).otherwise(F.col("id")).cast("int").alias("rare"),
        F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, 2.5).otherwise(F.col("id") / 3).alias("d`x"),
        F.lit(None).cast("string").alias("empty"),
    ).withColumnRenamed("d`x", "dx")
    got = stats.modes(df, df.columns, count_all_cells=cells)
    assert got == {"unique": "u80000", "tie": "a", "rare": 7, "dx": 2.5, "empty": None}


def test_frequent_values_settle_modes_without_counting_all(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 3, 7).otherwise(F.col("id")).alias("hot"), F.col("id").alias("unique")
    )
    assert stats._frequent_modes(df, ["hot", "unique"]) == {"hot": 7}  # a column without a frequent value stays open
    assert stats._frequent_modes(df.limit(0), ["hot", "unique"]) == {"hot": None, "unique": None}


def test_scratch_frees(spark):
    df = spark.range(10)
    with stats.scratch(df) as kept:
        assert kept.storageLevel.useMemory
    assert not df.storageLevel.useMemory


def expected_part(labels, cuts, seed):
    import hashlib

    digest = {k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest() for k in labels}
    by_class = {}
    for k, c in labels.items():
        by_class.setdefault(c, []).append(k)
    out = {}
    for c, keys in by_class.items():
        for rank, k in enumerate(sorted(keys, key=lambda k: (digest[k], k)), 1):
            out[k] = sum(rank > cut(len(keys)) for cut in cuts)
    return out


@pytest.mark.parametrize("options", [{}, {"max_strata": 1}, {"digits": 1}, {"digits": 2}])
def test_parts_are_exact(spark, options):
    labels = {i: ("hot" if i % 3 else None if i % 2 else f"c{i % 7}") for i in range(3000)}
    df = spark.createDataFrame(list(labels.items()), "k bigint, c string")
    cuts = [lambda n: n * 3 // 10, lambda n: n * 3 // 10 + 1]
    spark_cuts = [lambda n: F.floor(n * 3 / 10), lambda n: F.floor(n * 3 / 10) + 1]
    got = ordering.with_part(df, ["c"], "k", 7, spark_cuts, **options)
    assert {r["k"]: r["part"] for r in got.collect()} == expected_part(labels, cuts, 7)


def test_parts_beyond_the_ends(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = ordering.with_part(df, [], "k", 1, [lambda n: F.lit(0), lambda n: n + 5])
    assert {r["part"] for r in got.collect()} == {1}
    assert ordering.with_part(df.limit(0), [], "k", 1, [lambda n: n]).count() == 0


def test_rank_is_a_permutation(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") < 1500, "big").otherwise("small").alias("c"))
    rows = ordering.with_rank(df, ["c"], "k", 3, digits=1).collect()
    for c, n in (("big", 1500), ("small", 500)):
        assert sorted(r["rank"] for r in rows if r["c"] == c) == list(range(1, n + 1))
        assert {r["stratum_rows"] for r in rows if r["c"] == c} == {n}


def test_repeated_keys_are_refused(spark):
    df = spark.createDataFrame([(1,)] * 10, "k bigint")
    with pytest.raises(ValueError, match="identify"):
        ordering.with_part(df, [], "k", 1, [lambda n: F.lit(4)])


def test_parts_need_no_shuffle(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit("a").alias("c"), F.lit(1.0).alias("wide"))
    got = ordering.with_part(df, ["c"], "k", 1, [lambda n: F.floor(n / 2)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "broadcast" in plan


def test_approximate_quantiles(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert stats.quartiles(df, ["x"], approximate=10_000)["x"] == pytest.approx([250, 750], abs=1)


@pytest.mark.parametrize("literal", [1000, 2])
def test_label_codes(spark, literal):
    words = [f"w{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words + ["w000"] * 500] + [(None,)], "s string")
    codes = encoding.fit_label_codes(df, ["s"], literal)
    assert bool(codes.long) == (literal == 2)
    order = sorted(words + ["nan"])
    rows = codes.transform(df, "_code").distinct().collect()
    assert {r["s"]: r["s_code"] for r in rows} == {None if w == "nan" else w: i for i, w in enumerate(order)}
    unseen = codes.transform(spark.createDataFrame([("zzz",)], "s string"), "_code").first()
    assert unseen["s_code"] == len(order)
