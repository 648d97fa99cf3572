"""Validation, coercion, missing values, infinities and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from .. import schema as S
from ..functions import scalars, stats
from ..operators import profile, quality, scaling
from ..session import work_path
from ..sources import tables
from .registry import query, rounded
from .sql import FINITE, NUMERIC, each, flows_sql, ip_ok, median_cte, mode_sql

KEYED = ("flow_id", S.TARGET)
LARGE = 10_000_000
ABSENT = [c for c in S.NETWORK_FEATURES if c not in (*NUMERIC, "src_ip", "dst_ip", "protocol")]


_BROKEN = " UNION ALL ".join(
    [f"SELECT 'missing_feature' AS rule, '{c}' AS column_name, 1::BIGINT AS violations" for c in ABSENT]
    + [f"SELECT 'invalid_ip', '{c}', count(*) FROM flows WHERE NOT ({ip_ok(c)})" for c in S.IP_COLUMNS]
    + [f"SELECT 'invalid_port', '{c}', count(*) FROM flows WHERE {c} NOT BETWEEN 0 AND 65535" for c in S.PORT_COLUMNS]
)


@query(flows_sql(f"SELECT * FROM ({_BROKEN}) x WHERE violations > 0"))
def flow_validation(spark, sf_dir):
    return quality.flow_violations(fixtures.flows(spark, sf_dir))


_REQUIRED = list(S.REQUIRED_FIELDS)
REASONS = ", ".join(
    [f"CASE WHEN {c} IS NULL THEN 'missing:{c}' END" for c in _REQUIRED]
    + [f"CASE WHEN {c} NOT BETWEEN 0 AND 65535 THEN 'range:{c}' END" for c in S.PORT_COLUMNS]
)


@query(
    flows_sql(
        f"SELECT flow_id, concat_ws(',', {REASONS}) AS reasons FROM flows "
        f"WHERE concat_ws(',', {REASONS}) <> ''"
    )
)
def flow_quarantine(spark, sf_dir):
    _, broken = quality.split_by_contract(fixtures.flows(spark, sf_dir))
    return broken.select("flow_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    flows_sql(
        f"SELECT anomaly_type, count(*) AS rows, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM flows "
        f"WHERE concat_ws(',', {REASONS}) = '' GROUP BY anomaly_type"
    )
)
def flow_contract_valid(spark, sf_dir):
    valid, _ = quality.split_by_contract(fixtures.flows(spark, sf_dir))
    return valid.groupBy(S.TARGET).agg(F.count("*").alias("rows"), F.sum("total_bytes").alias("total_bytes"))


def _text_measures(spark, sf_dir):
    key = F.col("flow_id")
    return fixtures.flows(spark, sf_dir).select(
        "flow_id",
        F.when(key % 7 == 0, "n/a")
        .when(key % 7 == 1, F.concat(F.lit(" "), F.col("total_bytes").cast("string"), F.lit(" ")))
        .when(key % 7 == 2, "1e3")
        .when(key % 7 == 3, "12abc")
        .otherwise(F.col("total_bytes").cast("string"))
        .alias("total_bytes"),
        F.when(key % 5 == 0, "").otherwise(F.col("src_port").cast("string")).alias("src_port"),
    )


@query(
    flows_sql(
        """SELECT flow_id,
       TRY_CAST(trim(CASE flow_id % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' || CAST(total_bytes AS VARCHAR) || ' '
                 WHEN 2 THEN '1e3' WHEN 3 THEN '12abc' ELSE CAST(total_bytes AS VARCHAR) END) AS DOUBLE) AS total_bytes,
       TRY_CAST(CASE WHEN flow_id % 5 = 0 THEN '' ELSE CAST(src_port AS VARCHAR) END AS DOUBLE) AS src_port,
       coalesce(TRY_CAST(CASE WHEN flow_id % 5 = 0 THEN '' ELSE CAST(src_port AS VARCHAR) END AS DOUBLE), 0) AS src_port_or_zero
FROM flows"""
    )
)
def numeric_coerce(spark, sf_dir):
    text = _text_measures(spark, sf_dir).withColumn("src_port_or_zero", F.col("src_port"))
    numbers = quality.coerce_numeric(text, ["total_bytes", "src_port", "absent"])
    return quality.coerce_numeric(numbers, ["src_port_or_zero"], bad_as=0)


@query(
    flows_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM flows"
            for c in ["flow_id", "src_ip", "dst_ip", "protocol", *NUMERIC, S.TARGET]
        )
    )
)
def missing_counts(spark, sf_dir):
    return quality.missing_counts(fixtures.flows(spark, sf_dir))


_DESCRIBED = flows_sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_missing, count(*) - count({c}) AS missing, "
        f"round(avg({c}), 4) AS mean, "
        + (
            f"round(stddev_samp({c}), 4)"
            if c in FINITE
            else f"CASE WHEN count(*) FILTER (WHERE isinf({c})) = 0 THEN round(stddev_samp(CASE WHEN isinf({c}) THEN NULL ELSE {c} END), 4) END"
        )
        + f" AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM flows"
        for c in NUMERIC
    )
)


@query(_DESCRIBED)
def describe_numeric(spark, sf_dir):
    return rounded(profile.describe_numeric(fixtures.flows(spark, sf_dir).select(*NUMERIC)), digits=4)


@query(_DESCRIBED)
def describe_numeric_searched(spark, sf_dir):
    """The same quartiles by the search that larger tables take."""
    flows = fixtures.flows(spark, sf_dir).select(*NUMERIC)
    return rounded(profile.describe_numeric(flows, one_aggregate_cells=0, leaf_rows=1000), digits=4)


_TEXT = ("src_ip", "dst_ip", "protocol", "anomaly_type")


@query(
    flows_sql(
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS rows,
  CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank,
  (SELECT count(DISTINCT {c}) FROM flows) AS unique_count, {mode_sql(c, 'flows')} AS most_frequent
  FROM flows WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
            for c in _TEXT
        )
    )
)
def categorical_summary(spark, sf_dir):
    return profile.categorical_summary(fixtures.flows(spark, sf_dir), _TEXT)


_SCALED = f"(SELECT *, total_bytes * {LARGE} AS scaled_bytes FROM flows) t"
_QUALITY = ["flow_id", *NUMERIC, "scaled_bytes"]


@query(
    flows_sql(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, 'infinite' AS issue, CAST(count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS DOUBLE) AS value FROM {_SCALED} "
            f"UNION ALL SELECT '{c}', 'large', CASE WHEN max({c}) > 1e10 THEN CAST(max({c}) AS DOUBLE) ELSE 0 END FROM {_SCALED} "
            f"UNION ALL SELECT '{c}', 'missing', CAST(count(*) - count({c}) AS DOUBLE) FROM {_SCALED}"
            for c in _QUALITY
        )
        + ") q WHERE value > 0"
    )
)
def quality_report(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir)
    return quality.quality_issues(flows.withColumn("scaled_bytes", F.col("total_bytes") * LARGE))


@query(
    flows_sql(
        "SELECT flow_id, protocol, anomaly_type, "
        + each(NUMERIC, "round(coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)), 6) AS {c}")
        + " FROM flows",
        median_cte("med", "flows", NUMERIC),
    )
)
def fill_median(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).drop(*S.IP_COLUMNS)
    return rounded(quality.handle_missing(flows, "median", KEYED))


_MEANT = [c for c in FINITE if c.endswith(("packets", "bytes", "size"))]


@query(
    flows_sql(
        "SELECT flow_id, "
        + each(_MEANT, "round(coalesce(CAST({c} AS DOUBLE), (SELECT avg({c}) FROM flows)), 4) AS {c}")
        + " FROM flows"
    )
)
def fill_mean(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", *_MEANT)
    return rounded(quality.handle_missing(flows, "mean", KEYED), digits=4)


_MODED = ["src_ip", "protocol", "flow_duration", "total_packets", "total_bytes"]


@query(flows_sql("SELECT flow_id, " + ", ".join(f"coalesce({c}, {mode_sql(c, 'flows')}) AS {c}" for c in _MODED) + " FROM flows"))
def fill_mode(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", *_MODED)
    return quality.handle_missing(flows, "mode", KEYED)


@query(flows_sql("SELECT flow_id, protocol, total_packets FROM flows WHERE " + each(["protocol", *NUMERIC], "{c} IS NOT NULL", " AND ")))
def drop_missing(spark, sf_dir):
    kept = quality.handle_missing(fixtures.flows(spark, sf_dir), "drop")
    return kept.select("flow_id", "protocol", "total_packets")


@query(
    flows_sql(
        "SELECT flow_id, "
        + each(
            ["packets_per_second", "bytes_per_second"],
            "round(CASE WHEN isinf({c}) THEN (SELECT max({c}) FROM flows WHERE NOT isinf({c})) ELSE {c} END, 6) AS {c}",
        )
        + " FROM flows"
    )
)
def inf_repair(spark, sf_dir):
    rates = fixtures.flows(spark, sf_dir).select("flow_id", "packets_per_second", "bytes_per_second")
    with stats.scratch(rates) as kept:
        fitted = quality.fit_infinity_repair(kept, KEYED)
    return rounded(fitted.transform(rates))


@query(
    flows_sql(
        "SELECT flow_id, total_packets, round(CASE WHEN scaled_bytes > q THEN q ELSE scaled_bytes END, 4) AS scaled_bytes "
        "FROM big, (SELECT quantile_cont(scaled_bytes, 0.999) AS q FROM big) t",
        f"big AS (SELECT flow_id, total_packets, CAST(total_bytes * {LARGE} AS DOUBLE) AS scaled_bytes FROM flows)",
    )
)
def winsorize_999(spark, sf_dir):
    big = fixtures.flows(spark, sf_dir).select(
        "flow_id", "total_packets", (F.col("total_bytes") * LARGE).cast("double").alias("scaled_bytes")
    )
    with stats.scratch(big) as kept:
        fitted = quality.fit_winsorize(kept, KEYED)
    return rounded(fitted.transform(big), digits=4)


_FIXED = ["flow_duration", "packets_per_second", "bytes_per_second", "total_packets"]


@query(
    flows_sql(
        "SELECT flow_id, anomaly_type, "
        + each(_FIXED, "round(coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)), 6) AS {c}")
        + ", round(coalesce(scaled_bytes, (SELECT scaled_bytes FROM med)), 4) AS scaled_bytes FROM capped",
        f"finite AS (SELECT flow_id, anomaly_type, flow_duration, total_packets, CAST(total_bytes * {LARGE} AS DOUBLE) AS scaled_bytes, "
        + each(
            ["packets_per_second", "bytes_per_second"],
            "CASE WHEN isinf({c}) THEN (SELECT max({c}) FROM flows WHERE NOT isinf({c})) ELSE {c} END AS {c}",
        )
        + " FROM flows)",
        "capped AS (SELECT * REPLACE (CASE WHEN scaled_bytes > (SELECT quantile_cont(scaled_bytes, 0.999) FROM finite) "
        "THEN (SELECT quantile_cont(scaled_bytes, 0.999) FROM finite) ELSE scaled_bytes END AS scaled_bytes) FROM finite)",
        median_cte("med", "capped", [*_FIXED, "scaled_bytes"]),
    )
)
def fix_data_issues(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select(
        "flow_id",
        S.TARGET,
        "flow_duration",
        "total_packets",
        "packets_per_second",
        "bytes_per_second",
        (F.col("total_bytes") * LARGE).cast("double").alias("scaled_bytes"),
    )
    repaired = quality.repair_if_needed(flows, KEYED)
    return repaired.select(
        "flow_id",
        S.TARGET,
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _FIXED],
        F.round("scaled_bytes", 4).alias("scaled_bytes"),
    )


_FILLED = ["src_port", "flow_duration", "total_packets", "total_bytes", "avg_packet_size"]
_SCALE_CTES = (
    median_cte("med", "flows", _FILLED),
    "filled AS (SELECT flow_id, " + each(_FILLED, "coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)) AS {c}") + " FROM flows)",
)


def _filled(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", *_FILLED)
    return quality.handle_missing(flows, "median", KEYED)


def _scaled(spark, sf_dir, method):
    filled = _filled(spark, sf_dir)
    with stats.scratch(filled) as kept:
        fitted = scaling.fit_scaler(kept, _FILLED, method)
    return rounded(fitted.transform(filled))


@query(
    flows_sql(
        "SELECT flow_id, "
        + each(_FILLED, "round(({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled), 6) AS {c}")
        + " FROM filled",
        *_SCALE_CTES,
    )
)
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query(
    flows_sql(
        "SELECT flow_id, "
        + each(_FILLED, "round(({c} - (SELECT min({c}) FROM filled)) / (SELECT max({c}) - min({c}) FROM filled), 6) AS {c}")
        + " FROM filled",
        *_SCALE_CTES,
    )
)
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query(
    flows_sql(
        "SELECT flow_id, "
        + each(
            _FILLED,
            "round(({c} - (SELECT quantile_cont({c}, 0.5) FROM filled)) / "
            "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM filled), 6) AS {c}",
        )
        + " FROM filled",
        *_SCALE_CTES,
    )
)
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@query(
    flows_sql(
        f"SELECT flow_id, {ip_ok('src_ip')} AS src_ok, {ip_ok('dst_ip')} AS dst_ok FROM flows"
    )
)
def ip_valid(spark, sf_dir):
    return fixtures.flows(spark, sf_dir).select(
        "flow_id", scalars.is_valid_ip("src_ip").alias("src_ok"), scalars.is_valid_ip("dst_ip").alias("dst_ok")
    )


_REPAIRED = ("orders", "lineitem", "customer", "absent")


@query(
    " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, 'written' AS outcome, count(*) AS rows FROM {t}" for t in _REPAIRED[:-1]]
        + ["SELECT 'absent', 'skipped: AnalysisException', 0::BIGINT"]
    )
)
def repair_tables(spark, sf_dir):
    """Stored tables repaired one by one; one that is not there is skipped."""
    jobs = {t: (f"{sf_dir}/{t}.parquet", work_path(spark, t)) for t in _REPAIRED}
    outcome = quality.run_over_tables(spark, jobs, quality.repair_if_needed)
    parts = []
    for name, (_, target) in jobs.items():
        rows = F.count("*") if outcome[name] == "written" else F.lit(0).cast("bigint")
        table = spark.read.parquet(target) if outcome[name] == "written" else spark.range(1)
        parts.append(
            table.agg(rows.alias("rows")).select(
                F.lit(name).alias("table_name"), F.lit(outcome[name]).alias("outcome"), "rows"
            )
        )
    return tables.union_by_name(parts)
