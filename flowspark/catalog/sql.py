"""SQL text of the flow tables, and pieces to build the twins from."""

from __future__ import annotations

NUMERIC = (
    "src_port dst_port flow_duration total_packets total_bytes avg_packet_size packets_per_second "
    "bytes_per_second min_packet_size max_packet_size flow_start_time flow_end_time "
    "src_to_dst_packets dst_to_src_packets src_to_dst_bytes dst_to_src_bytes tcp_flags"
).split()
FINITE = [c for c in NUMERIC if c not in ("packets_per_second", "bytes_per_second")]

FLOWS = """flows AS (
SELECT o.o_orderkey AS flow_id,
       concat('192.168.', CAST(o.o_custkey % 4 AS STRING), '.', CAST(o.o_custkey % 251 AS STRING)) AS src_ip,
       CASE WHEN o.o_orderkey % 211 = 0 THEN '300.1.1'
            ELSE concat('10.0.0.', CAST(o.o_orderkey % 254 AS STRING)) END AS dst_ip,
       CAST(1024 + o.o_custkey % 64000 AS BIGINT) AS src_port,
       CAST(CASE o.o_orderkey % 5 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 3306 ELSE 70000 END AS BIGINT) AS dst_port,
       CASE o.o_orderkey % 11 WHEN 0 THEN 'UDP' WHEN 1 THEN 'ICMP' WHEN 2 THEN 'SCTP' WHEN 3 THEN NULL ELSE 'TCP' END AS protocol,
       CAST(a.t1 - a.t0 AS DOUBLE) AS flow_duration,
       a.n AS total_packets, a.b AS total_bytes,
       CAST(a.b AS DOUBLE) / a.n AS avg_packet_size,
       CASE WHEN a.t1 = a.t0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(a.n AS DOUBLE) / nullif(a.t1 - a.t0, 0) END AS packets_per_second,
       CASE WHEN a.t1 = a.t0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(a.b AS DOUBLE) / nullif(a.t1 - a.t0, 0) END AS bytes_per_second,
       a.mn AS min_packet_size, a.mx AS max_packet_size,
       a.t0 AS flow_start_time, a.t1 AS flow_end_time,
       a.fp AS src_to_dst_packets, a.n - a.fp AS dst_to_src_packets,
       a.fb AS src_to_dst_bytes, a.b - a.fb AS dst_to_src_bytes,
       CAST(o.o_orderkey % 256 AS BIGINT) AS tcp_flags,
       CASE WHEN o.o_orderkey % 100 < 68 THEN 'normal' WHEN o.o_orderkey % 100 < 95 THEN 'spoofing'
            WHEN o.o_orderkey % 100 < 97 THEN 'database_attack' WHEN o.o_orderkey % 100 < 99 THEN 'brute_force'
            ELSE 'upload_attack' END AS anomaly_type
FROM orders o LEFT JOIN (
  SELECT k, COUNT(*) AS n, CAST(SUM(sz) AS BIGINT) AS b, MIN(sz) AS mn, MAX(sz) AS mx, MIN(t) AS t0, MAX(t) AS t1,
         CAST(SUM(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(SUM(CASE WHEN f THEN sz ELSE 0 END) AS BIGINT) AS fb
  FROM (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) * 32 AS sz, l_returnflag = 'N' AS f,
               CAST(extract(year FROM l_shipdate) * 366 + extract(doy FROM l_shipdate) AS BIGINT) AS t FROM lineitem) p
  GROUP BY k) a ON a.k = o.o_orderkey)"""

SCORED = """scored AS (
SELECT flow_id, true_label, stage1_prediction,
       CAST(CASE WHEN g % 10 < 7 THEN c ELSE (c + 1 + g % 4) % 5 END AS INTEGER) AS top_class,
       CAST(30 + (flow_id * 37 + g) % 70 AS DOUBLE) / 100 AS top_prob
FROM (SELECT flow_id, anomaly_type AS true_label, g, c,
             CASE WHEN c = 2 AND g % 8 <> 0 THEN 0 WHEN c <> 2 AND g % 9 = 0 THEN 0 ELSE 1 END AS stage1_prediction
      FROM (SELECT flow_id, anomaly_type, CAST(floor(flow_id / 100.0) AS BIGINT) AS g,
                   CASE anomaly_type WHEN 'brute_force' THEN 0 WHEN 'database_attack' THEN 1 WHEN 'normal' THEN 2
                        WHEN 'spoofing' THEN 3 ELSE 4 END AS c FROM flows) x) y)"""

DETECTED = """detected AS (
SELECT flow_id, true_label, prediction, confidence, detection_path,
       CASE prediction WHEN -2 THEN 'needs_review' WHEN 0 THEN 'brute_force' WHEN 1 THEN 'database_attack'
            WHEN 2 THEN 'normal' WHEN 3 THEN 'spoofing' WHEN 4 THEN 'upload_attack' ELSE 'unknown' END AS label
FROM (SELECT flow_id, true_label,
             CAST(CASE WHEN stage1_prediction = 0 THEN 2 WHEN top_prob < 0.5 THEN -2 ELSE top_class END AS INTEGER) AS prediction,
             CASE WHEN stage1_prediction = 0 THEN 1.0::DOUBLE ELSE top_prob END AS confidence,
             CASE WHEN stage1_prediction = 0 THEN 'lightgbm_benign' WHEN top_prob < 0.5 THEN 'xgboost_low_confidence'
                  ELSE 'xgboost_anomaly' END AS detection_path
      FROM scored))"""


def flows_sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([FLOWS, *ctes]) + "\n" + select


def scored_sql(select: str, *ctes: str) -> str:
    return flows_sql(select, SCORED, DETECTED, *ctes)


def each(columns, template: str, separator: str = ",\n       ") -> str:
    """``template`` with {c} replaced by each column."""
    return separator.join(template.format(c=c) for c in columns)


def ip_int(c: str) -> str:
    p = f"string_split({c}, '.')"
    octets = " + ".join(f"TRY_CAST({p}[{i}] AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5))
    return f"CASE WHEN len({p}) = 4 THEN coalesce({octets}, 0) ELSE 0 END"


def ip_ok(c: str) -> str:
    octets = " AND ".join(
        f"coalesce(TRY_CAST(string_split({c}, '.')[{i}] AS BIGINT), 999) <= 255" for i in range(1, 5)
    )
    return f"(regexp_full_match({c}, '[0-9]+([.][0-9]+){{3}}') AND {octets})"


def duration_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} > 0 AND {c} <= 1 THEN 'very_short' WHEN {c} > 1 AND {c} <= 10 THEN 'short' "
        f"WHEN {c} > 10 AND {c} <= 60 THEN 'medium' WHEN {c} > 60 AND {c} <= 3600 THEN 'long' "
        f"WHEN {c} > 3600 THEN 'very_long' END"
    )


def packet_size_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} > 0 AND {c} <= 64 THEN 'tiny' WHEN {c} > 64 AND {c} <= 512 THEN 'small' "
        f"WHEN {c} > 512 AND {c} <= 1024 THEN 'medium' WHEN {c} > 1024 AND {c} <= 1500 THEN 'large' "
        f"WHEN {c} > 1500 THEN 'jumbo' END"
    )


def protocol_sql(c: str) -> str:
    return f"CASE {c} WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 WHEN 'ICMP' THEN 3 WHEN 'GRE' THEN 4 WHEN 'ESP' THEN 5 ELSE 0 END"


def share_sql(forward: str, backward: str) -> str:
    return f"CASE WHEN {forward} + {backward} > 0 THEN CAST({forward} AS DOUBLE) / ({forward} + {backward}) ELSE 0.5 END"


def median_cte(name: str, source: str, columns) -> str:
    return f"{name} AS (SELECT " + each(columns, "quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}") + f" FROM {source})"


def quartile_cte(name: str, source: str, columns) -> str:
    return (
        f"{name} AS (SELECT "
        + each(columns, "quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_3")
        + f" FROM {source})"
    )


def clip_sql(c: str, source: str, q: str) -> str:
    low = f"({q}.{c}_1 - 1.5 * ({q}.{c}_3 - {q}.{c}_1))"
    high = f"({q}.{c}_3 + 1.5 * ({q}.{c}_3 - {q}.{c}_1))"
    x = f"CAST({source}.{c} AS DOUBLE)"
    return f"CASE WHEN {x} IS NOT NULL THEN round(least(greatest({x}, {low}), {high}), 6) END AS {c}"


def mode_sql(c: str, source: str) -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def order_key(seed: int = 42, key: str = "flow_id") -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR)), {key}"


def draw_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
