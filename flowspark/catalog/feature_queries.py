"""Scalar features, encodings, adapters and the whole preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from .. import schema as S
from ..functions import scalars, stats
from ..operators import encoding, features, profile, quality
from .registry import query, rounded
from .sql import (
    NUMERIC,
    clip_sql,
    duration_sql,
    each,
    flows_sql,
    ip_int,
    median_cte,
    mode_sql,
    packet_size_sql,
    protocol_sql,
    quartile_cte,
    share_sql,
)

KEYED = ("flow_id", S.TARGET)


@query(
    flows_sql(
        f"""SELECT anomaly_type, count(*) AS flows,
       count(*) FILTER (WHERE {duration_sql('flow_duration')} = 'long') AS long_flows,
       count(*) FILTER (WHERE {packet_size_sql('avg_packet_size')} = 'jumbo') AS jumbo_flows,
       count(*) FILTER (WHERE {protocol_sql('protocol')} = 0) AS unknown_protocol,
       round(avg({share_sql('src_to_dst_bytes', 'dst_to_src_bytes')}), 6) AS byte_ratio,
       round(avg({share_sql('src_to_dst_packets', 'dst_to_src_packets')}), 6) AS packet_ratio
FROM flows GROUP BY anomaly_type"""
    )
)
def flow_features_by_class(spark, sf_dir):
    derived = features.derive_features(fixtures.flows(spark, sf_dir))
    return rounded(
        derived.groupBy(S.TARGET).agg(
            F.count("*").alias("flows"),
            F.count_if(F.col("flow_duration_category") == "long").alias("long_flows"),
            F.count_if(F.col("packet_size_category") == "jumbo").alias("jumbo_flows"),
            F.count_if(F.col("protocol_encoded") == 0).alias("unknown_protocol"),
            F.avg("src_dst_byte_ratio").alias("byte_ratio"),
            F.avg("src_dst_packet_ratio").alias("packet_ratio"),
        )
    )


@query(flows_sql(f"SELECT flow_id, {ip_int('src_ip')} AS src_ip, {ip_int('dst_ip')} AS dst_ip FROM flows"))
def ip_to_int(spark, sf_dir):
    return fixtures.flows(spark, sf_dir).select(
        "flow_id", scalars.ip_to_int("src_ip").alias("src_ip"), scalars.ip_to_int("dst_ip").alias("dst_ip")
    )


@query(flows_sql(f"SELECT flow_id, protocol, {protocol_sql('protocol')} AS protocol_encoded FROM flows"))
def protocol_code(spark, sf_dir):
    return fixtures.flows(spark, sf_dir).select(
        "flow_id", "protocol", scalars.protocol_code("protocol").alias("protocol_encoded")
    )


@query(
    flows_sql(
        f"SELECT flow_id, {share_sql('src_to_dst_bytes', 'dst_to_src_bytes')} AS src_dst_byte_ratio, "
        f"{share_sql('src_to_dst_packets', 'dst_to_src_packets')} AS src_dst_packet_ratio FROM flows"
    )
)
def flow_ratios(spark, sf_dir):
    return features.derive_features(fixtures.flows(spark, sf_dir)).select(
        "flow_id", "src_dst_byte_ratio", "src_dst_packet_ratio"
    )


@query(flows_sql(f"SELECT flow_id, {duration_sql('flow_duration')} AS flow_duration_category FROM flows"))
def duration_bucket(spark, sf_dir):
    return features.derive_features(fixtures.flows(spark, sf_dir)).select("flow_id", "flow_duration_category")


@query(flows_sql(f"SELECT flow_id, {packet_size_sql('avg_packet_size')} AS packet_size_category FROM flows"))
def packet_bucket(spark, sf_dir):
    return features.derive_features(fixtures.flows(spark, sf_dir)).select("flow_id", "packet_size_category")


@query(
    flows_sql(
        "SELECT flow_id, protocol, "
        "CAST(dense_rank() OVER (ORDER BY coalesce(protocol, 'nan')) - 1 AS BIGINT) AS protocol_code, "
        "CAST(dense_rank() OVER (ORDER BY coalesce(anomaly_type, 'nan')) - 1 AS BIGINT) AS anomaly_type_code FROM flows"
    )
)
def label_encode(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", "protocol", S.TARGET)
    fitted = encoding.fit_label_codes(flows, ["protocol", S.TARGET])
    return fitted.transform(flows, suffix="_code").select(
        "flow_id", "protocol", "protocol_code", "anomaly_type_code"
    )


@query(
    flows_sql(
        "SELECT flow_id, src_ip, dense_rank() OVER (ORDER BY coalesce(src_ip, 'nan')) - 1 AS src_ip_code FROM flows"
    )
)
def label_encode_large(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", "src_ip")
    fitted = encoding.fit_label_codes(flows, ["src_ip"], literal_codes=100)
    return fitted.transform(flows, suffix="_code")


@query(
    flows_sql(
        "SELECT flow_id, anomaly_type, " + ", ".join(clip_sql(c, "flows", "q") for c in NUMERIC) + " FROM flows, q",
        quartile_cte("q", "flows", NUMERIC),
    )
)
def iqr_clip(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", S.TARGET, *NUMERIC)
    with stats.scratch(flows.select(*NUMERIC)) as kept:
        fitted = features.fit_iqr_bounds(kept)
    return rounded(fitted.transform(flows))


# --- preprocessing ------------------------------------------------------------------

_TEXT = ["src_ip", "dst_ip", "protocol"]
_RATIOS = ["src_dst_byte_ratio", "src_dst_packet_ratio"]
_BUCKETS = ["flow_duration_category", "packet_size_category"]
_ENCODED = [*_TEXT, *NUMERIC, *_RATIOS, *_BUCKETS, "protocol_encoded"]
PREPROCESS_CTES = (
    median_cte("med", "flows", NUMERIC),
    "filled AS (SELECT flow_id, anomaly_type, "
    + ", ".join(f"coalesce({c}, {mode_sql(c, 'flows')}) AS {c}" for c in _TEXT)
    + ", "
    + each(NUMERIC, "coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)) AS {c}")
    + " FROM flows)",
    f"""derived AS (SELECT *, {share_sql('src_to_dst_bytes', 'dst_to_src_bytes')} AS src_dst_byte_ratio,
       {share_sql('src_to_dst_packets', 'dst_to_src_packets')} AS src_dst_packet_ratio,
       {duration_sql('flow_duration')} AS flow_duration_category,
       {packet_size_sql('avg_packet_size')} AS packet_size_category,
       {protocol_sql('protocol')} AS protocol_encoded FROM filled)""",
    f"""encoded AS (SELECT * REPLACE ({ip_int('src_ip')} AS src_ip, {ip_int('dst_ip')} AS dst_ip,
       {protocol_sql('protocol')} AS protocol,
       dense_rank() OVER (ORDER BY coalesce(flow_duration_category, 'nan')) - 1 AS flow_duration_category,
       dense_rank() OVER (ORDER BY coalesce(packet_size_category, 'nan')) - 1 AS packet_size_category) FROM derived)""",
    quartile_cte("q", "encoded", _ENCODED),
)
PREPROCESSED = "SELECT flow_id, anomaly_type, " + ", ".join(clip_sql(c, "encoded", "q") for c in _ENCODED) + " FROM encoded, q"


@query(flows_sql(PREPROCESSED, *PREPROCESS_CTES))
def preprocess_flows(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir)
    return rounded(features.FlowPreprocessor(target=S.TARGET, keep=("flow_id",)).fit_transform(flows))


# --- raw captures -------------------------------------------------------------------

RAW = """raw AS (
SELECT flow_id, concat(src_ip, '-', dst_ip) AS "Flow ID", src_ip AS "Src IP", dst_ip AS "Dst IP",
       flow_duration * 1000000 AS "Flow Duration",
       src_to_dst_packets AS "Total Fwd Packet", dst_to_src_packets AS "Total Bwd packets",
       src_to_dst_bytes AS "Total Length of Fwd Packet", dst_to_src_bytes AS "Total Length of Bwd Packet",
       max_packet_size AS "Fwd Packet Length Max", min_packet_size AS "Fwd Packet Length Min",
       avg_packet_size AS "Fwd Packet Length Mean",
       CASE WHEN flow_id % 13 = 0 THEN 'n/a' ELSE CAST(tcp_flags AS VARCHAR) END AS "SYN Flag Count",
       dst_port AS "Dst Port",
       CASE anomaly_type WHEN 'normal' THEN 0 WHEN 'brute_force' THEN 1 WHEN 'spoofing' THEN 2
            WHEN 'upload_attack' THEN 3 ELSE 4 END AS label
FROM flows)"""
_RENAMED = {
    "Flow Duration": "flow_duration",
    "Total Fwd Packet": "src_to_dst_packets",
    "Total Bwd packets": "dst_to_src_packets",
    "Total Length of Fwd Packet": "src_to_dst_bytes",
    "Total Length of Bwd Packet": "dst_to_src_bytes",
    "Fwd Packet Length Max": "max_packet_size",
    "Fwd Packet Length Min": "min_packet_size",
    "Fwd Packet Length Mean": "avg_packet_size",
    "Dst Port": "raw_dst_port",
}


def _raw_columns() -> str:
    return ", ".join(f'"{old}" AS {new}' for old, new in _RENAMED.items())


@query(
    flows_sql(
        "SELECT flow_id, CAST(label AS INTEGER) AS label, src_to_dst_packets, dst_to_src_packets, flow_duration, raw_dst_port AS \"Dst Port\", "
        "flag AS syn_flag_count FROM named",
        RAW,
        f'named AS (SELECT flow_id, label, {_raw_columns()}, "SYN Flag Count" AS flag FROM raw)',
    )
)
def rename_map(spark, sf_dir):
    renamed = features.rename_features(features.drop_identifiers(fixtures.raw_flows(spark, sf_dir)))
    return renamed.select(
        "flow_id", "label", "src_to_dst_packets", "dst_to_src_packets", "flow_duration", "Dst Port", "syn_flag_count"
    )


@query(
    flows_sql(
        "SELECT flow_id, 3232235777::BIGINT AS src_ip, 80 AS src_port, 0.0::DOUBLE AS flow_start_time, 0 AS icmp_type, protocol FROM flows"
    )
)
def default_columns(spark, sf_dir):
    sparse = fixtures.flows(spark, sf_dir).select("flow_id", "protocol")
    return features.add_missing_columns(sparse).select(
        "flow_id", "src_ip", "src_port", "flow_start_time", "icmp_type", "protocol"
    )


@query(
    flows_sql(
        "SELECT flow_id, CAST(label AS INTEGER) AS label, CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'brute_force' WHEN 2 THEN 'spoofing' "
        "WHEN 3 THEN 'upload_attack' WHEN 4 THEN 'database_attack' END AS anomaly_type FROM "
        "(SELECT flow_id, CASE WHEN flow_id % 17 = 0 THEN 9 ELSE label END AS label FROM raw) t",
        RAW,
    )
)
def class_names(spark, sf_dir):
    raw = fixtures.raw_flows(spark, sf_dir).select(
        "flow_id", F.when(F.col("flow_id") % 17 == 0, 9).otherwise(F.col("label")).alias("label")
    )
    return raw.withColumn(S.TARGET, scalars.class_name("label"))


_ADAPTED = list(_RENAMED.values())
_KEPT = [c for c in _ADAPTED if c != "raw_dst_port"]


@query(
    flows_sql(
        "SELECT flow_id, anomaly_type, round(flow_duration / 1000000, 6) AS flow_duration, "
        + each([c for c in _KEPT if c != "flow_duration"], "round({c}, 6) AS {c}")
        + ', round(raw_dst_port, 6) AS "Dst Port", round(src_to_dst_packets + dst_to_src_packets, 6) AS total_packets, '
        "round(src_to_dst_bytes + dst_to_src_bytes, 6) AS total_bytes, syn_flag_count, 3232235777::BIGINT AS src_ip, "
        "3232235777::BIGINT AS dst_ip, 80 AS src_port, 80 AS dst_port, 1 AS protocol, 0.0::DOUBLE AS flow_start_time, "
        "0.0::DOUBLE AS flow_end_time, 0 AS tcp_flags, 0 AS udp_length, 0 AS icmp_type, 0 AS icmp_code FROM clipped",
        RAW,
        f"""named AS (SELECT flow_id, label, {_raw_columns()},
         coalesce(TRY_CAST("SYN Flag Count" AS DOUBLE), 0) AS syn_flag_count FROM raw)""",
        median_cte("med", "named", _ADAPTED),
        "filled AS (SELECT flow_id, label, syn_flag_count, "
        + each(_ADAPTED, "coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)) AS {c}")
        + " FROM named)",
        quartile_cte("q", "filled", _ADAPTED),
        "clipped AS (SELECT flow_id, syn_flag_count, CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'brute_force' "
        "WHEN 2 THEN 'spoofing' WHEN 3 THEN 'upload_attack' ELSE 'database_attack' END AS anomaly_type, "
        + ", ".join(clip_sql(c, "filled", "q").replace("round(", "(").replace(", 6) END", ") END") for c in _ADAPTED)
        + " FROM filled, q)",
    )
)
def raw_adapter(spark, sf_dir):
    raw = features.drop_identifiers(fixtures.raw_flows(spark, sf_dir))
    return rounded(features.RawFlowAdapter(keep=("flow_id",)).fit_transform(raw))


_CLEANED = ["Flow Duration", "Total Fwd Packet", "Fwd Packet Length Mean", "SYN Flag Count"]


@query(
    flows_sql(
        "SELECT flow_id, "
        + each(_CLEANED, 'round(coalesce(CAST("{c}" AS DOUBLE), (SELECT quantile_cont(CAST("{c}" AS DOUBLE), 0.5) FROM num)), 6) AS "{c}"')
        + " FROM num",
        RAW,
        'num AS (SELECT * REPLACE (TRY_CAST("SYN Flag Count" AS DOUBLE) AS "SYN Flag Count") FROM raw)',
    )
)
def clean_features(spark, sf_dir):
    raw = fixtures.raw_flows(spark, sf_dir)
    cleaned = quality.clean_features(raw, ("flow_id", S.TARGET))
    return rounded(cleaned.select("flow_id", *_CLEANED))


@query(
    flows_sql(
        "SELECT flow_id, CAST(NULL AS DOUBLE) AS udp_length, total_bytes, CAST(NULL AS DOUBLE) AS std_packet_size, flow_duration FROM flows"
    )
)
def align_features(spark, sf_dir):
    return features.align_features(
        fixtures.flows(spark, sf_dir), ["udp_length", "total_bytes", "std_packet_size", "flow_duration"], ("flow_id",)
    )


@query(flows_sql("SELECT anomaly_type AS label, count(*) AS rows, round(count(*) * 100.0 / (SELECT count(*) FROM flows), 6) AS percentage FROM flows GROUP BY 1"))
def label_counts(spark, sf_dir):
    return rounded(profile.label_counts(fixtures.flows(spark, sf_dir)))
