import collections

import pytest
from pyspark.sql import functions as F

from flowspark import schema as S
from flowspark.functions import ordering
from flowspark.operators import profile, sampling
from flowspark.operators.oversampling import rebalance

# class sizes of the published run: 270262 rows, 20 % of them for testing
TOTALS = {"normal": 183630, "spoofing": 73033, "database_attack": 6603, "brute_force": 3619, "upload_attack": 3377}
TEST = {"normal": 36726, "spoofing": 14607, "database_attack": 1321, "brute_force": 724, "upload_attack": 675}


@pytest.fixture(scope="module")
def published(spark):
    ends, start = [], 0
    for c, n in TOTALS.items():
        start += n
        ends.append((start, c))
    label = F.when(F.col("id") < ends[0][0], ends[0][1])
    for end, c in ends[1:]:
        label = label.when(F.col("id") < end, c)
    return spark.range(sum(TOTALS.values())).select(F.col("id").alias("k"), label.alias(S.TARGET))


def counts(df, *columns):
    rows = df.groupBy(*columns).agg(F.count("*").alias("n")).collect()
    return {tuple(r[:-1]) if len(columns) > 1 else r[0]: r["n"] for r in rows}


def test_published_split_sizes(published):
    got = counts(sampling.split_train_test(published, "k"), S.TARGET, "split")
    for c, n in TOTALS.items():
        assert got[c, "test"] == TEST[c] and got[c, "train"] == n - TEST[c]


def test_published_undersampling(published):
    train = sampling.split_train_test(published, "k").filter("split = 'train'").drop("split")
    assert counts(sampling.undersample(train, "k"), S.TARGET) == dict.fromkeys(TOTALS, 2702)


def test_published_weights(published):
    train = sampling.split_train_test(published, "k").filter("split = 'train'")
    weights = {r["label"]: r["weight"] for r in profile.class_weights(train).collect()}
    assert weights == pytest.approx(
        {
            "normal": 0.294354136034417,
            "spoofing": 0.7401122787799952,
            "database_attack": 8.186633850814086,
            "brute_force": 14.93671848013817,
            "upload_attack": 16.00362694300518,
        }
    )


def test_three_way_split(published):
    got = counts(sampling.split_three_way(published, "k"), S.TARGET, "split")
    for c, n in TOTALS.items():
        assert sum(got[c, s] for s in ("train", "validation", "test")) == n
        assert abs(got[c, "train"] - 0.7 * n) <= 0.5 and abs(got[c, "test"] - 0.15 * n) <= 1


def test_random_split_and_indicator(published):
    got = counts(sampling.split_train_test(published, "k", stratify=False), "split")
    assert got == {"test": 54052, "train": 216210}
    assert counts(sampling.validation_indicator(published, "k"), "is_validation")[True] == sum(TEST.values())


def test_same_rows_whatever_the_partitioning(published):
    one = sampling.split_train_test(published, "k").filter("split = 'test'").select("k")
    two = sampling.split_train_test(published.repartition(13), "k").filter("split = 'test'").select("k")
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()


def test_caps(spark):
    df = spark.range(1000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") < 700, "normal").when(F.col("id") < 960, "spoofing").otherwise("other").alias(S.TARGET),
        F.concat(F.lit("f"), F.col("id") % 2).alias("file"),
    )
    capped = sampling.cap_per_class(df, "k", "file", caps={"normal": 300, "spoofing": 500}, default=30)
    assert counts(capped, S.TARGET) == {"normal": 300, "spoofing": 260, "other": 30}
    assert counts(sampling.cap_per_file(df, "file", "k", 120), "file") == {"f0": 120, "f1": 120}
    assert counts(sampling.cap_per_file(df, "file", "k", 120, max_strata=1), "file") == {"f0": 120, "f1": 120}
    assert {r[S.TARGET] for r in sampling.small_classes(df, minimum=100).collect()} == {"other"}
    defaults = spark.createDataFrame([("normal",), ("spoofing",), ("upload_attack",), ("else",)], "anomaly_type string")
    assert [r[0] for r in defaults.select(sampling.class_cap()).collect()] == [80000, 50000, 15000, 10000]


def test_balance(spark):
    df = spark.range(600).select(
        F.col("id").alias("k"), F.when(F.col("id") < 500, "big").when(F.col("id") < 599, "small").otherwise("single").alias(S.TARGET)
    )
    balanced = sampling.balance_to_target(df, "k", 200)
    assert counts(balanced, S.TARGET) == {"big": 200, "small": 200, "single": 200}
    rows = balanced.collect()
    assert sorted(r["copy"] for r in rows if r[S.TARGET] == "single") == list(range(200))
    originals = [r["k"] for r in rows if r["copy"] == 0]
    assert len(set(originals)) == len(originals) == 200 + 99 + 1
    assert len({(r["k"], r["copy"]) for r in rows}) == 600
    drawn = collections.Counter(r["k"] for r in rows if r[S.TARGET] == "small" and r["copy"] > 0)
    assert sum(drawn.values()) == 101 and len(drawn) > 40


def test_one_row_repeated_beyond_a_chunk(spark):
    df = spark.createDataFrame([(1, "rare")], f"k bigint, {S.TARGET} string")
    balanced = sampling.balance_to_target(df, "k", 25_001)
    assert balanced.count() == 25_001 and balanced.select("copy").distinct().count() == 25_001


def test_exact_size_is_kept(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], f"k bigint, {S.TARGET} string")
    assert sampling.balance_to_target(df, "k", 2).select("copy").collect() == [(0,), (0,)]


def test_shuffles(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    rows = sampling.shuffle_rows(df, "k").collect()
    assert sorted(r["position"] for r in rows) == list(range(1, 501))
    order = [r["k"] for r in sampling.shuffled(df, "k").collect()]
    assert order == [r["k"] for r in sorted(rows, key=lambda r: r["position"])] != sorted(order)
    assert order != [r["k"] for r in sampling.shuffled(df, "k", seed=1).collect()]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        rebalance(spark.createDataFrame([(1, 1.0, "a")], f"k int, x double, {S.TARGET} string"), "other", "k", ["x"])


def test_imbalance_verdicts(spark):
    ratios = [0.6, 0.5, 0.3, 0.2, 0.15, 0.1, 0.01]
    df = spark.createDataFrame([(r,) for r in ratios], "r double")
    four = [r[0] for r in df.select(profile.verdict(F.col("r"))).collect()]
    assert four == ["balanced", "mild", "mild", "moderate", "moderate", "severe", "severe"]
    three = [r[0] for r in df.select(profile.verdict(F.col("r"), moderate=False)).collect()]
    assert three == ["balanced", "mild", "mild", "severe", "severe", "severe", "severe"]


def test_sample_weights_beyond_the_broadcast(spark, published):
    weights = profile.class_weights(published)
    small = published.filter("k % 1000 = 0")
    one = profile.with_sample_weights(small, weights)
    two = profile.with_sample_weights(small, weights, max_labels=1)
    assert one.exceptAll(two).count() == 0 and one.count() == two.count() == small.count()


def test_summaries(spark):
    df = spark.createDataFrame([(1.0, "a", "x"), (3.0, "a", None), (None, "b", None)], "v double, s string, label string")
    summary = profile.feature_summary(df)
    assert summary["columns"].count() == 3
    numeric = summary["numeric"].first()
    assert (numeric["non_missing"], numeric["missing"], numeric["mean"], numeric["median"]) == (2, 1, 2.0, 2.0)
    top = {(r["column_name"], r["value"]): (r["rows"], r["rank"], r["unique_count"], r["most_frequent"]) for r in summary["categorical"].collect()}
    assert top["s", "a"] == (2, 1, 2, "a") and top["s", "b"] == (1, 2, 2, "a")
    assert profile.data_summary(df)["target"].collect() == [("label", "x", 1)]
    with pytest.raises(ValueError):
        profile.target_distribution(df.select("v"))


@pytest.mark.parametrize("most_strata", [10_000, 0])
def test_input_is_evaluated_twice_at_most(spark, most_strata):
    """Once for the slim rows that the cuts are found in, once for the result."""
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    df = spark.range(500).selectExpr("id", "concat('c', id % 3) as c").mapInArrow(count, "id bigint, c string")
    parted = ordering.with_part(df, ["c"], "id", 7, [lambda n: F.floor(n / 2)], max_strata=most_strata)
    sizes = {tuple(r)[:2]: r[2] for r in parted.groupBy("c", "part").agg(F.count("*")).collect()}
    assert sizes == {("c0", 0): 83, ("c0", 1): 84, ("c1", 0): 83, ("c1", 1): 84, ("c2", 0): 83, ("c2", 1): 83}
    assert rows.value <= 1000
