import pytest
from pyspark.sql import functions as F

from flowspark import schema as S
from flowspark.operators import quality, scaling

NAN, INF = float("nan"), float("inf")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert quality.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="b"):
        quality.require_columns(df, ["a", "b"])


def test_validation(spark):
    good = spark.createDataFrame([("1.2.3.4", 80, 1.0), (None, None, 2.0)], "src_ip string, src_port int, flow_duration double")
    assert quality.validate_flows(good, ["src_ip", "src_port"]) == (True, [])
    bad = spark.createDataFrame([("1.2.3", -1, "x"), ("9.9.9.999", 65536, "y")], "src_ip string, src_port int, flow_duration string")
    valid, errors = quality.validate_flows(bad, ["src_ip", "protocol"])
    assert not valid
    assert errors == [
        "invalid_ip: src_ip (2)", "invalid_port: src_port (2)", "missing_feature: protocol (1)", "not_numeric: flow_duration (1)",
    ]


def test_contract(spark):
    fields = ", ".join(f"{c} {t.simpleString()}" for c, t in S.REQUIRED_FIELDS.items())
    good = ("1.1.1.1", "2.2.2.2", 1, 65535, "TCP", 1.0, 1, 1, 1.0)
    bad = (None, "2.2.2.2", 1, 65536, None, 1.0, 1, 1, 1.0)
    valid, broken = quality.split_by_contract(spark.createDataFrame([good, bad], fields))
    assert valid.count() == 1 and "reasons" not in valid.columns
    assert broken.first()["reasons"] == ["missing:src_ip", "missing:protocol", "range:dst_port"]


def test_missing_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, None), (None, "b")], "x double, s string")
    assert rows(quality.missing_counts(df)) == [("s", 1), ("x", 2)]


@pytest.mark.parametrize("method, expected", [("mean", 2.5), ("median", 2.0), ("mode", 1.0)])
def test_fill(spark, method, expected):
    data = [(1.0, 1, "a"), (1.0, 2, "b"), (3.0, 2, "b"), (5.0, None, None), (NAN, 9, "b")]
    df = spark.createDataFrame(data, "x double, n int, s string")
    filled = quality.handle_missing(df, method).collect()
    assert filled[4]["x"] == expected
    assert filled[3]["n"] == {"mean": 3.5, "median": 2.0, "mode": 2}[method]
    assert filled[3]["s"] == ("b" if method == "mode" else None)


def test_drop_and_unknown_method(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "b"), (2.0, None)], "x double, s string")
    assert quality.handle_missing(df, "drop").count() == 1
    with pytest.raises(ValueError):
        quality.handle_missing(df, "guess")


def test_infinity_repair(spark):
    df = spark.createDataFrame([(1.0, INF, None), (INF, -INF, 1.0), (-INF, INF, 2.0), (NAN, None, 3.0)], "a double, b double, c double")
    repaired = quality.fit_infinity_repair(df).transform(df).collect()
    assert [r["a"] for r in repaired[:3]] == [1.0, 1.0, 1.0]
    assert [r["b"] for r in repaired] == [0.0, 0.0, 0.0, None]
    assert [r["c"] for r in repaired] == [None, 1.0, 2.0, 3.0]
    left = quality.fit_infinity_repair(df, all_infinite=None).transform(df).collect()
    assert [r["b"] for r in left] == [INF, -INF, INF, None]


def test_winsorize_only_large_columns(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("small"), (F.col("id") * 1e8).alias("large"))
    fitted = quality.fit_winsorize(df)
    assert set(fitted.thresholds) == {"large"}
    assert fitted.transform(df).agg(F.max("large"), F.max("small")).first()[:] == (fitted.thresholds["large"], 1000.0)
    assert fitted.thresholds["large"] == pytest.approx(999e8)


def test_repair_uses_each_previous_step(spark):
    values = [float(i) for i in range(1, 1000)] + [INF, NAN]
    df = spark.createDataFrame([(v * 1e9 if v == v else v, "normal") for v in values], "x double, anomaly_type string")
    fixed = quality.repair_if_needed(df)
    got = [r["x"] for r in fixed.collect()]
    largest = 999e9
    assert max(got) <= largest and all(v == v for v in got)
    assert got[-1] == 500.5e9
    clean = spark.createDataFrame([(1.0,)], "x double")
    assert quality.repair_if_needed(clean) is clean


def test_quality_issues(spark):
    df = spark.createDataFrame([(INF, 1, 2e10), (NAN, None, 1.0)], "a double, b int, c double")
    assert rows(quality.quality_issues(df)) == [
        ("a", "infinite", 1.0), ("a", "large", INF), ("a", "missing", 1.0), ("b", "missing", 1.0), ("c", "large", 2e10),
    ]


def test_clean_features(spark):
    df = spark.createDataFrame(
        [("id1", "1.1.1.1", "5", 1.0, "normal"), ("id2", "1.1.1.1", "x", None, "normal"), ("id3", "1.1.1.1", "7", 3.0, "spoofing")],
        "`Flow ID` string, `Src IP` string, `Dst Port` string, `Flow Bytes/s` double, anomaly_type string",
    )
    cleaned = quality.clean_features(df)
    assert cleaned.columns == ["Dst Port", "Flow Bytes/s", "anomaly_type"]
    assert [r[:2] for r in cleaned.collect()] == [(5.0, 1.0), (6.0, 2.0), (7.0, 3.0)]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 2.0)], "x double, same double")
    standard = scaling.fit_scaler(df, ["x", "same"])
    mean, deviation = standard.parameters["x"]
    assert (mean, deviation) == pytest.approx((7 / 3, (14 / 9) ** 0.5))
    assert standard.parameters["same"] == (2.0, 1.0)
    assert scaling.fit_scaler(df, ["x"], "minmax").parameters["x"] == (1.0, 3.0)
    assert scaling.fit_scaler(df, ["x"], "robust").parameters["x"] == (2.0, 1.5)
    back = standard.inverse(standard.transform(df))
    assert [r["x"] for r in back.collect()] == pytest.approx([1.0, 2.0, 4.0])
    with pytest.raises(ValueError):
        scaling.fit_scaler(df, ["x"], "other")


def test_run_over_tables(spark, tmp_path):
    spark.createDataFrame([(1.0,), (None,)], "x double").write.parquet(str(tmp_path / "in"))
    jobs = {"good": (str(tmp_path / "in"), str(tmp_path / "out")), "gone": (str(tmp_path / "no"), str(tmp_path / "x"))}
    outcome = quality.run_over_tables(spark, jobs, quality.repair_if_needed)
    assert outcome["good"] == "written" and outcome["gone"].startswith("skipped")
    assert spark.read.parquet(str(tmp_path / "out")).filter("x IS NULL").count() == 0
