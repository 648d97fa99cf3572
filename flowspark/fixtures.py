"""Flow tables derived from the star-schema test tables.

An order is a flow and its line items are the packets; ``l_returnflag = 'N'``
marks the forward direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def packets_per_flow(lineitem: DataFrame) -> DataFrame:
    """One row per order key: counts, sizes and times of its packets."""
    day = (F.year("l_shipdate") * 366 + F.dayofyear("l_shipdate")).cast("bigint")
    packets = lineitem.select(
        F.col("l_orderkey").alias("k"),
        (F.col("l_quantity").cast("bigint") * 32).alias("sz"),
        (F.col("l_returnflag") == "N").alias("f"),
        day.alias("t"),
    )
    return packets.groupBy("k").agg(
        F.count("*").alias("n"),
        F.sum("sz").alias("b"),
        F.min("sz").alias("mn"),
        F.max("sz").alias("mx"),
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.sum(F.when(F.col("f"), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("f"), F.col("sz")).otherwise(0)).alias("fb"),
    )


def flows_from(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The ``flows`` table from its two source tables."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    n, size = F.col("n"), F.col("b")
    span = F.col("t1") - F.col("t0")

    def rate(amount):
        return F.when(span == 0, F.lit(float("inf"))).otherwise(
            F.try_divide(amount.cast("double"), span.cast("double"))
        )

    share = key % 100
    # both sides grow with the data: no broadcast, and a join that can spill
    packets = packets_per_flow(lineitem).hint("merge")
    return orders.join(packets, key == F.col("k"), "left").select(
        key.alias("flow_id"),
        F.concat(F.lit("192.168."), customer % 4, F.lit("."), customer % 251).alias("src_ip"),
        F.when(key % 211 == 0, "300.1.1")
        .otherwise(F.concat(F.lit("10.0.0."), key % 254))
        .alias("dst_ip"),
        (1024 + customer % 64000).alias("src_port"),
        F.element_at(F.array(*[F.lit(p) for p in (22, 80, 443, 3306, 70000)]), (key % 5 + 1).cast("int"))
        .cast("bigint")
        .alias("dst_port"),
        F.when(key % 11 == 0, "UDP")
        .when(key % 11 == 1, "ICMP")
        .when(key % 11 == 2, "SCTP")
        .when(key % 11 == 3, F.lit(None).cast("string"))
        .otherwise("TCP")
        .alias("protocol"),
        span.cast("double").alias("flow_duration"),
        n.alias("total_packets"),
        size.alias("total_bytes"),
        (size.cast("double") / n).alias("avg_packet_size"),
        rate(n).alias("packets_per_second"),
        rate(size).alias("bytes_per_second"),
        F.col("mn").alias("min_packet_size"),
        F.col("mx").alias("max_packet_size"),
        F.col("t0").alias("flow_start_time"),
        F.col("t1").alias("flow_end_time"),
        F.col("fp").alias("src_to_dst_packets"),
        (n - F.col("fp")).alias("dst_to_src_packets"),
        F.col("fb").alias("src_to_dst_bytes"),
        (size - F.col("fb")).alias("dst_to_src_bytes"),
        (key % 256).alias("tcp_flags"),
        F.when(share < 68, "normal")
        .when(share < 95, "spoofing")
        .when(share < 97, "database_attack")
        .when(share < 99, "brute_force")
        .otherwise("upload_attack")
        .alias("anomaly_type"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``flows`` table of a test-data folder."""
    return flows_from(
        spark.read.parquet(f"{sf_dir}/orders.parquet"),
        spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
    )


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows under flow-meter column names, with integer labels and identifiers."""
    code = (
        F.when(F.col("anomaly_type") == "normal", 0)
        .when(F.col("anomaly_type") == "brute_force", 1)
        .when(F.col("anomaly_type") == "spoofing", 2)
        .when(F.col("anomaly_type") == "upload_attack", 3)
        .otherwise(4)
    )
    return flows(spark, sf_dir).select(
        F.col("flow_id"),
        F.concat(F.col("src_ip"), F.lit("-"), F.col("dst_ip")).alias("Flow ID"),
        F.col("src_ip").alias("Src IP"),
        F.col("dst_ip").alias("Dst IP"),
        (F.col("flow_duration") * 1000000).alias("Flow Duration"),
        F.col("src_to_dst_packets").alias("Total Fwd Packet"),
        F.col("dst_to_src_packets").alias("Total Bwd packets"),
        F.col("src_to_dst_bytes").alias("Total Length of Fwd Packet"),
        F.col("dst_to_src_bytes").alias("Total Length of Bwd Packet"),
        F.col("max_packet_size").alias("Fwd Packet Length Max"),
        F.col("min_packet_size").alias("Fwd Packet Length Min"),
        F.col("avg_packet_size").alias("Fwd Packet Length Mean"),
        F.when(F.col("flow_id") % 13 == 0, "n/a")
        .otherwise(F.col("tcp_flags").cast("string"))
        .alias("SYN Flag Count"),
        F.col("dst_port").alias("Dst Port"),
        code.alias("label"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``scored`` table of a test-data folder."""
    return scored_from(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def scored_from(orders: DataFrame) -> DataFrame:
    """Flows with a first-stage verdict and a second-stage class and probability.

    Only the key and the label of a flow matter here, so the packets are not read.
    """
    base = (
        orders.select(F.col("o_orderkey").alias("flow_id"))
        .withColumn("share", F.col("flow_id") % 100)
        .withColumn("g", F.floor(F.col("flow_id") / 100).cast("bigint"))
    )
    share, g, c = F.col("share"), F.col("g"), F.col("c")
    classed = base.withColumn(
        "c",
        F.when(share < 68, 2).when(share < 95, 3).when(share < 97, 1).when(share < 99, 0).otherwise(4),
    )
    names = F.array(
        *[F.lit(x) for x in ("brute_force", "database_attack", "normal", "spoofing", "upload_attack")]
    )
    return classed.select(
        "flow_id",
        F.element_at(names, c + 1).alias("true_label"),
        F.when((c == 2) & (g % 8 != 0), 0)
        .when((c != 2) & (g % 9 == 0), 0)
        .otherwise(1)
        .alias("stage1_prediction"),
        F.when(g % 10 < 7, c).otherwise((c + 1 + g % 4) % 5).cast("int").alias("top_class"),
        ((30 + (F.col("flow_id") * 37 + g) % 70).cast("double") / 100).alias("top_prob"),
    )


def scored_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities_of(scored(spark, sf_dir))


def probabilities_of(scores: DataFrame) -> DataFrame:
    """``scored`` with the probability array a classifier would give."""
    rest = (1 - F.col("top_prob")) / 4
    return scores.withColumn(
        "probabilities",
        F.array(*[F.when(F.col("top_class") == i, F.col("top_prob")).otherwise(rest) for i in range(5)]),
    )
