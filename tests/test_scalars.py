from pyspark.sql import functions as F

from flowspark import schema as S
from flowspark.functions import scalars


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(expression).collect()]


def test_ip_validity(spark):
    ips = ["192.168.1.1", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "001.02.3.4", "1.2.3.-4", "", "1..2.3", None]
    assert values(spark, ips, "string", scalars.is_valid_ip("x")) == [
        True, False, False, False, False, True, False, False, False, None,
    ]


def test_ip_to_int(spark):
    ips = ["192.168.1.1", "300.1.1.1", "1.2.3", "a.b.c.d", None, "0.0.0.255", "1.2.3.4."]
    assert values(spark, ips, "string", scalars.ip_to_int("x")) == [
        3232235777, 300 * 256**3 + 256**2 + 256 + 1, 0, 0, 0, 255, 0,
    ]


def test_protocol_codes(spark):
    names = ["TCP", "UDP", "ICMP", "GRE", "ESP", "tcp", "SCTP", None]
    assert values(spark, names, "string", scalars.protocol_code("x")) == [1, 2, 3, 4, 5, 0, 0, 0]


def test_buckets_are_right_closed(spark):
    xs = [-1.0, 0.0, 0.5, 1.0, 1.1, 10.0, 60.0, 3600.0, 3600.1, float("inf"), None]
    assert values(spark, xs, "double", scalars.duration_bucket("x")) == [
        None, None, "very_short", "very_short", "short", "short", "medium", "long", "very_long", "very_long", None,
    ]
    xs = [0.0, 64.0, 65.0, 512.0, 1024.0, 1500.0, 1501.0, None]
    assert values(spark, xs, "double", scalars.packet_size_bucket("x")) == [
        None, "tiny", "small", "small", "medium", "large", "jumbo", None,
    ]


def test_forward_share(spark):
    df = spark.createDataFrame([(3, 1), (0, 0), (None, 4), (5, None)], "f bigint, b bigint")
    assert [r[0] for r in df.select(scalars.forward_share("f", "b")).collect()] == [0.75, 0.5, 0.5, 0.5]


def test_clip_keeps_missing(spark):
    xs = [None, -5.0, 0.5, 9.0, float("inf")]
    nan = values(spark, [float("nan")], "double", scalars.clip("x", 0.0, 2.0))
    assert nan[0] != nan[0]
    assert values(spark, xs, "double", scalars.clip("x", 0.0, 2.0)) == [None, 0.0, 0.5, 2.0, 2.0]
    assert values(spark, xs, "double", scalars.clip("x", None, 2.0)) == [None, -5.0, 0.5, 2.0, 2.0]
    assert values(spark, xs, "double", scalars.clip("x", 0.0, None)) == [None, 0.0, 0.5, 9.0, float("inf")]
    assert values(spark, xs, "double", scalars.clip("x", None, None)) == xs


def test_to_number(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "1.", "abc", "", "1d", "2f", "0x1A", "inf", "-Infinity", "nan", None]
    assert values(spark, texts, "string", scalars.to_number("x")) == [
        1.0, 2.5, -300.0, 0.5, 1.0, None, None, None, None, None, float("inf"), float("-inf"), None, None,
    ]


def test_prediction_labels(spark):
    codes = [-1, -2, -3, 0, 2, 4, 5, -9]
    assert values(spark, codes, "int", scalars.prediction_label("x", S.CLASSES)) == [
        "unknown", "needs_review", "detection_failed", "brute_force", "normal", "upload_attack", "unknown", "unknown",
    ]


def test_filename_rules(spark):
    names = ["BENIGN day.parquet", "暴力破解.csv", "spoof_1", "上传危机.csv", "my_database", "other", "benign_brute"]
    expected = ["normal", "brute_force", "spoofing", "upload_attack", "database_attack", "normal", "normal"]
    assert values(spark, names, "string", scalars.label_from_filename("x")) == expected
    expected[5] = None
    assert values(spark, names, "string", scalars.label_from_filename("x", unmatched="skip")) == expected
    assert values(spark, names, "string", scalars.label_from_filename("x", (("other", "odd"),), "none"))[5] == "odd"
    both = ((("上传", "危机"), "upload_attack"),)
    assert values(spark, ["上传危机", "上传"], "string", scalars.label_from_filename("x", both, "skip")) == [
        "upload_attack", None,
    ]


def test_known_labels(spark):
    assert values(spark, ["normal", "ddos", None, "spoofing"], "string", scalars.known_label("x")) == [
        "normal", "normal", "normal", "spoofing",
    ]


def test_class_names(spark):
    assert values(spark, [0, 4, 9, None], "int", scalars.class_name("x")) == ["normal", "database_attack", None, None]
    assert values(spark, ["normal", "spoofing"], "string", scalars.binary_label("x")) == [0, 1]


def test_error_type(spark):
    df = spark.createDataFrame([("a", "b")], "t string, p string")
    assert df.select(scalars.error_type("t", F.col("p"))).first()[0] == "a->b"
