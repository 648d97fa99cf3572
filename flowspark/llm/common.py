"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import work_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, read by Spark only."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_id(key: str, text: str) -> Column:
    """A hash of a row's key and text: rows that share it are copies of each other; null texts count as empty."""
    name = F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("n"))
    return F.md5(F.concat(name, F.lit("\0"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("binary"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[str], tuple]], schema: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``df``: its key, and what a function makes of its text (null as empty).

    ``make`` runs once per task and returns the function, so tables are loaded there.
    """
    slim = df.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    out = slim.select(key).schema
    full = f"{key} {out[key].dataType.simpleString()}, {schema}"
    names = [part.split()[0] for part in full.split(", ")]
    target = arrow_schema(df.sparkSession, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            made = [function(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*made)) if made else [[]] * (len(names) - 1)
            arrays = [batch.column(0).cast(target.field(0).type)]
            arrays += [pa.array(list(c), target.field(i + 1).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return slim.mapInArrow(run, full)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema that Spark expects for a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def sha256_hex(data) -> str:
    return hashlib.sha256(data).hexdigest()


def hash_rows(values: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value of a uint64 array."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans united where they touch or overlap, in ascending order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)
    return starts[first], ends[last]
