"""Label distributions, weights, labelling by file name, unions and file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from .. import schema as S
from ..operators import profile, sampling
from ..session import work_path
from ..sources import tables
from .registry import query, rounded
from .sql import flows_sql, order_key

_RATIO = "CAST(min(n) AS DOUBLE) / max(n)"


@query(
    flows_sql(
        f"""SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS class_count, min(n) AS min_rows, max(n) AS max_rows,
       round({_RATIO}, 6) AS imbalance_ratio, round(CAST(max(n) AS DOUBLE) / min(n), 6) AS max_min_ratio,
       CASE WHEN {_RATIO} > 0.5 THEN 'balanced' WHEN {_RATIO} > 0.2 THEN 'mild' WHEN {_RATIO} > 0.1 THEN 'moderate' ELSE 'severe' END AS verdict,
       CASE WHEN {_RATIO} > 0.5 THEN 'balanced' WHEN {_RATIO} > 0.2 THEN 'mild' ELSE 'severe' END AS verdict_three_level
FROM (SELECT anomaly_type, count(*) AS n FROM flows GROUP BY 1) t"""
    )
)
def imbalance_report(spark, sf_dir):
    return rounded(profile.imbalance_report(fixtures.flows(spark, sf_dir)))


_WEIGHTS = (
    "weights AS (SELECT anomaly_type AS label, (SELECT count(*) FROM flows) * 1.0::DOUBLE / "
    "((SELECT count(DISTINCT anomaly_type) FROM flows) * count(*)) AS weight FROM flows GROUP BY 1)"
)


@query(flows_sql("SELECT label, round(weight, 6) AS weight FROM weights", _WEIGHTS))
def class_weights(spark, sf_dir):
    return rounded(profile.class_weights(fixtures.flows(spark, sf_dir)))


@query(
    flows_sql(
        "SELECT flow_id, anomaly_type, round(weight, 6) AS sample_weight FROM flows JOIN weights ON label = anomaly_type",
        _WEIGHTS,
    )
)
def sample_weights(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", S.TARGET)
    return rounded(profile.with_sample_weights(flows, profile.class_weights(flows)))


@query(flows_sql("SELECT 'anomaly_type' AS column_name, anomaly_type AS label, count(*) AS rows FROM flows GROUP BY 2"))
def target_distribution(spark, sf_dir):
    return profile.target_distribution(fixtures.flows(spark, sf_dir))


_ODD = "CASE WHEN flow_id % 29 = 0 THEN 'ddos' WHEN flow_id % 31 = 0 THEN NULL ELSE anomaly_type END"


def _with_odd_labels(spark, sf_dir):
    odd = F.when(F.col("flow_id") % 29 == 0, "ddos").when(F.col("flow_id") % 31 != 0, F.col(S.TARGET))
    return fixtures.flows(spark, sf_dir).select("flow_id", odd.alias(S.TARGET))


@query(
    flows_sql(
        f"SELECT {_ODD} AS label, count(*) AS rows, coalesce({_ODD} IN ('normal', 'brute_force', 'spoofing', "
        "'upload_attack', 'database_attack'), FALSE) AS is_known FROM flows GROUP BY 1"
    )
)
def label_audit(spark, sf_dir):
    return profile.label_audit(_with_odd_labels(spark, sf_dir))


@query(
    flows_sql(
        f"SELECT flow_id, CASE WHEN {_ODD} IN ('normal', 'brute_force', 'spoofing', 'upload_attack', 'database_attack') "
        f"THEN {_ODD} ELSE 'normal' END AS anomaly_type FROM flows"
    )
)
def label_normalize(spark, sf_dir):
    return profile.normalize_labels(_with_odd_labels(spark, sf_dir))


@query(flows_sql("SELECT flow_id, total_bytes FROM flows WHERE anomaly_type = 'spoofing'"))
def class_subset(spark, sf_dir):
    return fixtures.flows(spark, sf_dir).filter(F.col(S.TARGET) == "spoofing").select("flow_id", "total_bytes")


# --- labelling by file name ------------------------------------------------------------

FILE_NAMES = (
    "Benign_Monday.parquet",
    "良性流量.parquet",
    "brute_force_ssh.parquet",
    "密码爆破.parquet",
    "IP欺骗.parquet",
    "Upload-web.parquet",
    "数据库.parquet",
    "capture.parquet",
)
_FILE = "CASE flow_id % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FILE_NAMES)) + " END"
_FILE_LABEL = (
    "CASE WHEN f LIKE 'Benign%' OR f LIKE '良性%' THEN 'normal' WHEN f LIKE 'brute%' OR f LIKE '密码%' THEN 'brute_force' "
    "WHEN f LIKE '%欺骗%' THEN 'spoofing' WHEN f LIKE 'Upload%' THEN 'upload_attack' "
    "WHEN f LIKE '数据库%' THEN 'database_attack'"
)


def _with_files(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in FILE_NAMES])
    return fixtures.flows(spark, sf_dir).select(
        "flow_id", F.element_at(names, (F.col("flow_id") % 8 + 1).cast("int")).alias("file_name"), "total_bytes"
    )


@query(
    flows_sql(
        f"""SELECT f AS file_name, {_FILE_LABEL} ELSE 'normal' END AS anomaly_type,
       CAST(CASE WHEN {_FILE_LABEL} ELSE 'normal' END = 'normal' THEN 0 ELSE 1 END AS INTEGER) AS "Label",
       count(*) AS rows FROM (SELECT *, {_FILE} AS f FROM flows) t GROUP BY 1, 2, 3"""
    )
)
def filename_label(spark, sf_dir):
    labelled = tables.with_labels(_with_files(spark, sf_dir), "file_name")
    return labelled.groupBy("file_name", S.TARGET, "Label").agg(F.count("*").alias("rows"))


@query(
    flows_sql(
        f"""SELECT * FROM (SELECT flow_id, f AS file_name, total_bytes, {_FILE_LABEL} END AS anomaly_type,
       CAST(CASE WHEN {_FILE_LABEL} END = 'normal' THEN 0 ELSE 1 END AS INTEGER) AS "Label"
       FROM (SELECT *, {_FILE} AS f FROM flows) t) u WHERE anomaly_type IS NOT NULL"""
    )
)
def filename_label_skip(spark, sf_dir):
    return tables.with_labels(_with_files(spark, sf_dir), "file_name", unmatched="skip")


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_TABLE_RULES = (("item", "spoofing"), ("orders", "brute_force"), ("doc", "upload_attack"), ("event", "database_attack"))


@query(
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file_name, '"
        + next((label for word, label in _TABLE_RULES if word in t), "normal")
        + f"' AS anomaly_type, count(*) AS rows FROM {t}"
        for t in _TABLES
    )
)
def labelled_files(spark, sf_dir):
    labelled = tables.load_labelled(spark, sf_dir, "*.parquet", rules=_TABLE_RULES)
    return labelled.groupBy("file_name", S.TARGET).agg(F.count("*").alias("rows"))


_MIXED_SQL = """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders"""


def _mixed_folder(spark, sf_dir, fmt):
    """A folder whose files differ in the order and type of columns, and one of which has a column more."""
    folder = work_path(spark, f"mixed-{fmt}")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    odd = orders.where("o_orderkey % 2 <> 0").select("o_orderkey", "o_custkey")
    even = orders.where("o_orderkey % 2 = 0").select(
        F.col("o_orderstatus"), (F.col("o_custkey") + F.lit(0.0)).alias("o_custkey"), "o_orderkey"
    )
    for part in (odd, even):
        writer = part.write.mode("append").option("header", True)
        writer.format(fmt).save(folder)
    found = tables.load_directory(spark, folder, f"*.{fmt}")
    return found.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_custkey", "o_orderstatus")


@query(_MIXED_SQL)
def mixed_parquet_folder(spark, sf_dir):
    return _mixed_folder(spark, sf_dir, "parquet")


@query(_MIXED_SQL)
def mixed_csv_folder(spark, sf_dir):
    return _mixed_folder(spark, sf_dir, "csv")


def _renamed(spark, folder, names):
    """Give a folder's part files other names, in the order of their present ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f.getPath().getName() for f in store.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    for file, name in zip(files, names, strict=True):
        store.rename(path(f"{folder}/{file}"), path(f"{folder}/{name}"))


def _part(spark, folder, rows, fmt, name):
    """``rows`` as one more file of a folder."""
    rows.coalesce(1).write.mode("append").option("header", fmt == "csv").format(fmt).save(folder)
    _renamed(spark, folder, [name])


_CODE = "lpad(CAST(o_orderkey AS STRING), 9, '0')"


@query(
    f"""SELECT 'row' AS kind, {_CODE} AS code, o_orderkey % 7 AS small, CASE WHEN o_orderkey % 3 = 0 THEN '+' || CAST(o_custkey AS STRING)
  ELSE CAST(o_custkey AS STRING) END AS phone, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 END AS flag,
  CASE WHEN o_orderkey % 2 = 0 THEN 'even.csv' ELSE 'odd.csv' END AS file_name FROM orders
UNION ALL SELECT 'skipped', NULL, NULL, NULL, NULL, NULL, unnest(['a0.csv.gz', 'z9.csv.gz'])"""
)
def coded_csv_folder(spark, sf_dir):
    """Text codes of CSV files, by value; a file that cannot be unpacked before and after them is named."""
    folder = work_path(spark, "coded-csv")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    code = F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("code")
    phone = F.when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit("+"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    slim = orders.select("o_orderkey", code, F.expr("o_orderkey % 7 AS small"), phone.alias("phone"), F.col("o_totalprice").alias("price"))
    odd = slim.where("o_orderkey % 2 <> 0").select("code", "small", "phone")
    even = slim.where("o_orderkey % 2 = 0").select("phone", F.expr("o_orderkey % 4 = 0 AS flag"), "price", "small", "code")
    broken = orders.select(F.col("o_orderstatus").alias("value")).limit(3)
    _part(spark, folder, odd, "csv", "odd.csv")
    _part(spark, folder, even, "csv", "even.csv")
    for name in ("a0.csv.gz", "z9.csv.gz"):
        _part(spark, folder, broken, "text", name)
    found = tables.read_directory(spark, folder, "*.csv*", fmt="csv")
    rows = found.rows.select(
        F.lit("row").alias("kind"), "code", F.col("small").cast("bigint").alias("small"), "phone", "price", "flag",
        F.col(tables.FILE_COLUMN).alias("file_name"),
    )
    skipped = [(p.rsplit("/", 1)[-1],) for p, _ in found.skipped]
    names = spark.createDataFrame(skipped, "file_name string").select(F.lit("skipped").alias("kind"), "file_name")
    return rows.unionByName(names, allowMissingColumns=True)


@query(
    """SELECT 'row' AS kind, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'spoofing' ELSE 'normal' END AS anomaly_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'spoof.parquet' ELSE 'benign.parquet' END AS file_name FROM orders
UNION ALL SELECT 'skipped', NULL, NULL, NULL, NULL, unnest(['a0.parquet', 'z9.parquet'])"""
)
def damaged_parquet_folder(spark, sf_dir):
    """Labelled rows of Parquet files of other types, by value; the first and the last file are no Parquet files."""
    folder = work_path(spark, "damaged-parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    odd = orders.where("o_orderkey % 2 <> 0").select("o_orderkey", "o_custkey")
    even = orders.where("o_orderkey % 2 = 0").select("o_orderstatus", (F.col("o_custkey") + F.lit(0.0)).alias("o_custkey"), "o_orderkey")
    _part(spark, folder, odd, "parquet", "benign.parquet")
    _part(spark, folder, even, "parquet", "spoof.parquet")
    broken = orders.select(F.col("o_orderstatus").alias("value")).limit(3)
    for name in ("a0.parquet", "z9.parquet"):
        _part(spark, folder, broken, "text", name)
    found = tables.read_directory(spark, folder, "*.parquet")
    rows = tables.with_labels(found.rows.withColumnRenamed(tables.FILE_COLUMN, "file_name"), "file_name").select(
        F.lit("row").alias("kind"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_custkey", "o_orderstatus", S.TARGET, "file_name"
    )
    skipped = [(p.rsplit("/", 1)[-1],) for p, _ in found.skipped]
    names = spark.createDataFrame(skipped, "file_name string").select(F.lit("skipped").alias("kind"), "file_name")
    return rows.unionByName(names, allowMissingColumns=True)


@query(
    flows_sql(
        f"""SELECT f AS file_name, anomaly_type AS label, count(*) AS original_count,
       CAST(CASE anomaly_type WHEN 'normal' THEN 80000 WHEN 'spoofing' THEN 50000 ELSE 15000 END AS BIGINT) AS target_max,
       1000::BIGINT AS target_min FROM (SELECT *, {_FILE} AS f FROM flows) t GROUP BY 1, 2"""
    )
)
def file_statistics(spark, sf_dir):
    files = _with_files(spark, sf_dir).select("file_name", "flow_id")
    labels = fixtures.flows(spark, sf_dir).select("flow_id", S.TARGET)
    return profile.file_statistics(files.join(labels, "flow_id"), "file_name")


@query(
    flows_sql(
        """SELECT flow_id, protocol, total_bytes, CAST(NULL AS BIGINT) AS total_packets FROM flows WHERE anomaly_type = 'normal'
UNION ALL BY NAME SELECT total_packets, flow_id, CAST(NULL AS VARCHAR) AS protocol, total_bytes FROM flows WHERE anomaly_type <> 'normal'"""
    )
)
def union_by_name(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir)
    normal = flows.filter(F.col(S.TARGET) == S.NORMAL).select("flow_id", "protocol", "total_bytes")
    attacks = flows.filter(F.col(S.TARGET) != S.NORMAL).select("total_packets", "flow_id", "total_bytes")
    return tables.union_by_name([normal, attacks])


# --- file formats -------------------------------------------------------------------------

_STORED = ["flow_id", "src_ip", "protocol", "flow_duration", "bytes_per_second", "total_bytes", S.TARGET]
_STORED_SQL = flows_sql(f"SELECT {', '.join(_STORED)} FROM flows")


@query(_STORED_SQL)
def csv_table(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select(*_STORED)
    path = work_path(spark, "flows") + ".csv"
    tables.save_table(flows, path, "csv")
    return tables.load_table(spark, path, schema=flows.schema)


@query(_STORED_SQL)
def parquet_table(spark, sf_dir):
    path = work_path(spark, "flows") + ".parquet"
    tables.save_table(fixtures.flows(spark, sf_dir).select(*_STORED), path)
    return tables.load_table(spark, path)


@query(flows_sql("SELECT flow_id, src_ip, protocol, total_bytes, anomaly_type FROM flows"))
def json_table(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", "src_ip", "protocol", "total_bytes", S.TARGET)
    path = work_path(spark, "flows-json")
    flows.write.json(path)
    return tables.load_json_lines(spark, path, flows.schema)


@query(
    flows_sql(
        f"""SELECT split, anomaly_type AS label, count(*) AS rows, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS share
FROM (SELECT anomaly_type, CASE WHEN row_number() OVER (PARTITION BY anomaly_type ORDER BY {order_key()}) * 1000000
        <= (count(*) OVER (PARTITION BY anomaly_type) * 200000 + 500000) // 1000000 * 1000000 THEN 'test' ELSE 'train' END AS split FROM flows) t
GROUP BY 1, 2"""
    )
)
def split_statistics(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir).select("flow_id", "total_bytes", S.TARGET)
    path = work_path(spark, "dataset")
    tables.save_split_dataset(sampling.split_train_test(flows, "flow_id"), path)
    statistics = spark.read.json(f"{path}/statistics")
    return rounded(statistics.select("split", "label", "rows", "share"))


@query(flows_sql("SELECT label, round(weight, 6) AS weight FROM weights", _WEIGHTS))
def class_weight_file(spark, sf_dir):
    path = work_path(spark, "class-weights")
    tables.save_class_weights(fixtures.flows(spark, sf_dir), path)
    return rounded(spark.read.json(path).select("label", "weight"))
