"""Session construction and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Bytes of a generated method that the JIT still compiles, and the setting that limits them, with Spark's default.
COMPILED_BYTES, METHOD_LIMIT, ANY_METHOD = "8000", "spark.sql.codegen.hugeMethodLimit", "65535"
#: Whether the shuffle files of a query go when it ends; else they wait until the driver collects its plan.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app_name: str = "flowspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tuned for.

    Shuffle width is left to AQE: it starts from ``spark.sql.shuffle.partitions``
    and coalesces or splits partitions by their measured size. The JIT skips methods
    over 8000 bytes of bytecode, so wide projections beyond it are better split up.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        METHOD_LIMIT: COMPILED_BYTES,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compile_wide_rows(spark: SparkSession) -> None:
    """The method limit of ``get_spark`` in a session that was made elsewhere, unless that session has set its own.

    Without it a wide projection is one method, which the JIT leaves to the interpreter.
    """
    if spark.conf.get(METHOD_LIMIT, ANY_METHOD) == ANY_METHOD:
        spark.conf.set(METHOD_LIMIT, COMPILED_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of this machine; on a cluster
    a missing setting is an error, since executors could not see such a folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowspark-"))
    return context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/flowspark/{name}-{uuid.uuid4().hex}"


def checkpoint(df):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the queries that run inside are deleted when each of them ends."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


@dataclass
class WorkTable:
    """Rows of a step as a table in the shared folder."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the table, once nothing reads it any more."""
        context = self.rows.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def work_table(df: DataFrame, name: str) -> WorkTable:
    """``df`` written to the shared folder: evaluated once, unlike a checkpoint, and its shuffle files are gone afterwards."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return WorkTable(spark.read.schema(df.schema).parquet(path), path)
