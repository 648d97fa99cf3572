"""Which files of a folder are alike: footers and header lines are read by tasks, and only distinct ones reach the driver."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that one task looks into, about.
FILES_PER_TASK = 64
#: Files whose schema Spark itself reads at once where tasks cannot reach the store.
READERS = 16


def open_store(path: str):
    """The file system that holds ``path``, and the path within it."""
    from pyarrow import fs

    scheme, _, rest = path.rpartition(":") if "://" not in path else path.partition(":")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@=,+"))


def reachable(path: str) -> bool:
    """Whether Python can open the store of ``path``; if not, only Spark's own readers can."""
    try:
        store, inside = open_store(path)
        return store.get_file_info(inside).is_file
    except Exception:  # no client for the scheme, or no right to use it
        return False


def parquet_kind(path: str) -> str:
    """The footer's column tree, and the types that Spark has noted there."""
    import pyarrow.parquet as pq

    store, inside = open_store(path)
    with store.open_input_file(inside) as stream:
        file = pq.ParquetFile(stream)
        noted = (file.metadata.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"")
        tree = str(file.schema)
    # the first line names the Python object
    return tree.split("\n", 1)[-1] + "\n" + noted.decode("utf-8", "replace")


def csv_kind(path: str) -> str:
    """The first record of a file, unpacked if need be; a file without one has no columns."""
    store, inside = open_store(path)
    with store.open_input_stream(inside, compression="detect") as stream:
        text = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")
        names = next(csv.reader(text), None)
    if not names:
        raise ValueError("the file has no header")
    return "\x1f".join(names)


KINDS = {"parquet": parquet_kind, "csv": csv_kind}


def kind_table(spark: SparkSession, fmt: str, files: list[str]) -> DataFrame:
    """(path, kind, reason) of each file, read in tasks; the kind is null where a reason says why."""
    look = KINDS[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, reasons = [], []
            for path in batch.column(0).to_pylist():
                try:
                    kinds.append(look(path))
                    reasons.append(None)
                except Exception as error:  # any fault of one file is that file's
                    kinds.append(None)
                    reasons.append((str(error).splitlines() or [type(error).__name__])[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.string()), pa.array(reasons, pa.string())], names=["path", "kind", "reason"]
            )

    tasks = max(1, -(-len(files) // FILES_PER_TASK))
    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks, "path")
    return paths.mapInArrow(run, "path string, kind string, reason string")


def alike(spark: SparkSession, fmt: str, files: list[str], spark_schema) -> tuple[list[list[str]], list[tuple[str, str]]]:
    """Groups of files of one schema or header, in the order of their first files, and (path, reason) of the others.

    ``spark_schema(path)`` is Spark's own view of a file, (schema, "") or (None, reason); it is asked for every file
    only where tasks cannot open the store, or the format has neither footer nor header.
    """
    if fmt in KINDS and reachable(files[0]):
        found = kind_table(spark, fmt, files)
        grouped = (
            found.groupBy("kind", "reason").agg(F.sort_array(F.collect_list("path")).alias("paths")).select("kind", "reason", "paths")
        )
        rows = grouped.collect()
        groups = [r["paths"] for r in rows if r["kind"] is not None]
        skipped = [(p, r["reason"]) for r in rows if r["kind"] is None for p in r["paths"]]
    else:
        with ThreadPoolExecutor(READERS) as pool:
            seen = list(pool.map(spark_schema, files))
        by_schema: dict[str, list[str]] = {}
        for file, (schema, _) in zip(files, seen):
            if schema is not None:
                by_schema.setdefault(schema.json(), []).append(file)
        groups = list(by_schema.values())
        skipped = [(f, reason) for f, (schema, reason) in zip(files, seen) if schema is None]
    return sorted(groups), sorted(skipped)


# tasks get these helpers with their closure, whether or not the package is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
