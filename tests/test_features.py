import pytest
from pyspark.sql import functions as F

from flowspark import schema as S
from flowspark.operators import features, models
from flowspark.operators.features import FlowPreprocessor, FlowPreprocessorModel, RawFlowAdapter, RawFlowAdapterModel

FLOWS = "src_ip string, protocol string, flow_duration double, total_bytes bigint, src_to_dst_bytes bigint, dst_to_src_bytes bigint, avg_packet_size double, app string, anomaly_type string"


def sample(spark):
    data = [
        ("10.0.0.1", "TCP", 0.5, 100, 30, 70, 50.0, "web", "normal"),
        ("10.0.0.2", "UDP", 5.0, 200, 0, 0, 600.0, None, "normal"),
        ("10.0.0.2", None, None, None, 10, 10, 2000.0, "dns", "spoofing"),
        ("bad", "GRE", 100.0, 400, None, 5, None, "dns", "brute_force"),
        ("10.0.0.9", "TCP", 1e6, 10**9, 1, 3, 64.0, "dns", "normal"),
    ]
    return spark.createDataFrame(data, FLOWS).coalesce(1).withColumn("flow_id", F.monotonically_increasing_id())


def test_preprocess(spark):
    df = sample(spark)
    model = FlowPreprocessor(S.TARGET, ("flow_id",)).fit(df)
    out = model.transform(df)
    assert out.count() == df.count()
    rows = out.orderBy("flow_id").collect()
    assert all(v is not None for r in rows for v in r)
    assert [r["anomaly_type"] for r in rows] == [r["anomaly_type"] for r in df.orderBy("flow_id").collect()]
    # fills: median duration of .5, 5, 100, 1e6 is 52.5 and the protocol mode is TCP
    assert model.fill.values["flow_duration"] == 52.5
    assert model.fill.values["protocol"] == "TCP" and model.fill.values["app"] == "dns"
    assert model.codes.short["flow_duration_category"] == ["long", "medium", "short", "very_long", "very_short"]
    assert rows[1]["src_dst_byte_ratio"] == 0.5
    assert set(model.features) == set(out.columns) - {"flow_id", "anomaly_type"}


def test_outliers_shrink(spark):
    df = sample(spark)
    before = df.agg(F.max("total_bytes")).first()[0]
    after = FlowPreprocessor(S.TARGET, ("flow_id",)).fit_transform(df).agg(F.max("total_bytes")).first()[0]
    assert after < before


def test_statistics_do_not_depend_on_the_batch(spark):
    df = sample(spark)
    model = FlowPreprocessor(S.TARGET, ("flow_id",)).fit(df)
    whole = {r["flow_id"]: r for r in model.transform(df).collect()}
    for part in ("flow_id = 0", "flow_id = 3"):
        row = model.transform(df.filter(part)).first()
        assert row == whole[row["flow_id"]]


def test_model_text_round_trip(spark, tmp_path):
    model = FlowPreprocessor(S.TARGET, ("flow_id",), True).fit(sample(spark))
    model.save(spark, str(tmp_path / "model"))
    assert FlowPreprocessorModel.load(spark, str(tmp_path / "model")) == model


def test_repair_before_clip(spark):
    data = [(float(i), "a") for i in range(8)] + [(float("inf"), "b")] * 4
    df = spark.createDataFrame(data, "bytes_per_second double, anomaly_type string")
    out = FlowPreprocessor(S.TARGET, (), repair_infinite=True).fit_transform(df)
    assert out.agg(F.max("bytes_per_second")).first()[0] == 7.0
    kept = FlowPreprocessor(S.TARGET, (), clip_exclude=("bytes_per_second",)).fit_transform(df)
    assert kept.agg(F.max("bytes_per_second")).first()[0] == float("inf")


def test_infinite_quartile_leaves_the_bound_open():
    bounds = features.iqr_bounds({"a": [1.0, float("inf")], "b": [float("inf"), float("inf")], "c": [None, None]}).bounds
    assert bounds == {"a": [float("-inf"), float("inf")], "b": [None, None]}


def test_same_result_beyond_one_aggregate(spark):
    df = sample(spark)
    plain = FlowPreprocessor(S.TARGET, ("flow_id",)).fit(df)
    searched = FlowPreprocessor(S.TARGET, ("flow_id",), limits={"one_aggregate_cells": 0, "leaf_rows": 1}).fit(df)
    assert plain == searched


def raw(spark):
    return spark.createDataFrame(
        [(1000000.0, 1, 2, 10.0, 20.0, "x", 0), (3000000.0, 3, None, 30.0, 40.0, "5", 4), (2000000.0, 5, 6, 50.0, 60.0, None, 7)],
        "`Flow Duration` double, `Total Fwd Packet` bigint, `Total Bwd packets` bigint, "
        "`Total Length of Fwd Packet` double, `Total Length of Bwd Packet` double, note string, label int",
    )


def test_adapter(spark):
    model = RawFlowAdapter().fit(raw(spark))
    rows = model.transform(raw(spark)).collect()
    assert [r["flow_duration"] for r in rows] == [1.0, 3.0, 2.0]
    assert [r["total_packets"] for r in rows] == [3.0, 7.0, 11.0]
    assert [r["anomaly_type"] for r in rows] == ["normal", "database_attack", None]
    assert [r["note"] for r in rows] == [0.0, 5.0, 0.0]
    assert {rows[0][c] for c in ("src_ip", "dst_ip")} == {3232235777}
    assert (rows[0]["src_port"], rows[0]["protocol"], rows[0]["icmp_type"]) == (80, 1, 0)
    assert "label" not in rows[0].asDict()
    assert RawFlowAdapterModel.from_json(model.to_json()) == model


def test_rename_keeps_the_rest(spark):
    out = features.rename_features(raw(spark))
    assert "flow_duration" in out.columns and "note" in out.columns
    assert len(S.FLOW_METER_NAMES) == 34
    assert features.feature_columns(out) == [c for c in out.columns if c != "label"]


def test_numeric_addresses_and_protocols(spark):
    df = spark.createDataFrame([(3232235777, 1, 5.0), (3232235778, 1, 6.0)], "src_ip bigint, protocol int, total_bytes double")
    rows = FlowPreprocessor().fit_transform(df).collect()
    assert [r["src_ip"] for r in rows] == [3232235777.0, 3232235778.0]
    assert {(r["protocol"], r["protocol_encoded"]) for r in rows} == {(1.0, 0.0)}


def test_align(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, b double")
    assert features.align_features(df, ["a", "b"], ("k",)).collect() == [(1, None, 2.0)]
    assert features.align_features(df, ["a", "b"], ("k",), only_available=True).columns == ["k", "b"]


def test_core_schema():
    assert len(S.NETWORK_FEATURES) == 26 and set(S.NETWORK_FEATURES) == set(S.FLOW_FIELDS)


def test_class_code(spark):
    df = spark.createDataFrame([("b",), ("a",)], "t string")
    assert models.class_list(df, "t") == ["a", "b"]
    assert [r[0] for r in df.select(models.class_code("t", ["a", "b"])).collect()] == [1.0, 0.0]
    with pytest.raises(ValueError):
        models.train_stage_two(df, ["x"], "t", learner="other")


def test_wide_rows_are_compiled_in_a_session_made_elsewhere(spark):
    from flowspark.session import METHOD_LIMIT

    before = spark.conf.get(METHOD_LIMIT)
    model = FlowPreprocessor("anomaly_type").fit(sample(spark))
    try:
        spark.conf.unset(METHOD_LIMIT)
        spark.conf.set(METHOD_LIMIT, "65535")
        model.transform(sample(spark))
        assert spark.conf.get(METHOD_LIMIT) == "8000"
        spark.conf.set(METHOD_LIMIT, "20000")
        model.transform(sample(spark))
        assert spark.conf.get(METHOD_LIMIT) == "20000"
    finally:
        spark.conf.set(METHOD_LIMIT, before)
