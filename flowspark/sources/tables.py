"""Flow tables in Parquet, CSV and JSON, and the files written beside them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from .. import schema as S
from ..functions import scalars
from ..operators import detect, evaluate, profile
from . import discovery, typed_csv

FORMAT_BY_EXTENSION = {"parquet": "parquet", "csv": "csv", "json": "json"}
WRITABLE = ("parquet", "csv")
FILE_COLUMN = "_source_file"


def detect_format(path: str) -> str:
    """Format by extension; an unknown one is read as CSV."""
    extension = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    return FORMAT_BY_EXTENSION.get(extension, "csv")


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | None):
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        # the header is checked against a given schema instead of trusting positions
        reader = reader.option("header", True).option("enforceSchema", False)
    if fmt == "json":
        reader = reader.option("multiLine", True)
    return reader


def load_table(spark: SparkSession, path: str, fmt: str = "auto", schema: T.StructType | None = None) -> DataFrame:
    """One file or table. JSON may be an array document or one object per file line.

    Without a schema the columns of a CSV file are typed by their values; codes such as 007 stay text.
    """
    fmt = detect_format(path) if fmt == "auto" else fmt
    if fmt not in FORMAT_BY_EXTENSION.values():
        raise ValueError(f"unsupported format: {fmt}")
    if fmt == "csv" and schema is None:
        return typed_csv.read_csv(spark, path)
    return _reader(spark, fmt, schema).load(path)


def load_with_position(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A Parquet table with each row's place in it, from 0: files in the order of their names, rows in that of the file.

    Places do not depend on how the table is split over tasks. Spark names the files of a write in the order of its
    partitions, so a table that was written sorted is read in that order.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # one row per file
    sizes = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", before.alias("_start"))
    return rows.join(starts, "_file").withColumn(position, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def load_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON with one object per line, which splits over tasks."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


@dataclass
class Folder:
    """Rows of a folder's readable files, and (path, reason) of the files that were skipped."""

    rows: DataFrame
    skipped: list[tuple[str, str]]


def list_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Paths of a folder's files that match ``pattern``, sorted; contents are not read."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path").collect()
    except AnalysisException as error:
        raise ValueError(f"cannot list {path}: {error}") from error
    return sorted(r["path"] for r in found)


def _file_schema(spark: SparkSession, fmt: str, file: str) -> tuple[T.StructType | None, str]:
    """A file's own schema (of a CSV file, its header), or why it cannot be read."""
    try:
        if fmt == "csv":
            return spark.read.option("header", True).csv(file).schema, ""
        return _reader(spark, fmt, None).load(file).schema, ""
    except Exception as error:  # any fault of one file is that file's
        return None, str(error).splitlines()[0]


def _common_type(kinds: list[T.DataType]) -> T.DataType:
    """The narrowest of bigint, double and string that holds all kinds; one kind stays as it is."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    return T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds) else T.StringType()


def _typed(spark: SparkSession, fmt: str, groups: list[list[str]], schema: T.StructType | None) -> list[tuple[DataFrame, dict]]:
    """A frame for each group, and the types that its columns shall have over all groups.

    CSV columns are read as text and typed by the values of all files, or by the given schema.
    """
    if fmt != "csv":
        frames = [_reader(spark, fmt, None).load(members) for members in groups]
    else:
        frames = [typed_csv.as_text(spark, members) for members in groups]
    if schema is not None:
        wanted = {f.name: f.dataType for f in schema.fields}
    else:
        names = list(dict.fromkeys(c for f in frames for c in f.columns))
        if fmt == "csv":
            kinds = dict.fromkeys(names, 0)
            for frame in frames:
                for name, kind in typed_csv.kinds(frame, frame.columns).items():
                    kinds[name] |= kind
            wanted = {n: typed_csv.type_of(k) for n, k in kinds.items()}
        else:
            wanted = {n: _common_type([f.schema[n].dataType for f in frames if n in f.columns]) for n in names}
    return [(frame, wanted) for frame in frames]


def read_directory(
    spark: SparkSession, path: str, pattern: str = "*.parquet", schema: T.StructType | None = None, fmt: str = "auto"
) -> Folder:
    """All files of a folder that match ``pattern``, whatever their columns and types.

    Footers and headers are looked at by tasks. Files of one schema or header share a reader, and the readers' rows are
    united by name: an absent column is NULL, columns of different numeric types become bigint or double, others text.
    CSV columns are typed by their values in all files, so text codes keep their zeros. A file that cannot be opened is
    skipped and named; one of no bytes is passed over. An error if nothing matches or nothing can be read.
    """
    fmt = detect_format(pattern) if fmt == "auto" else fmt
    files = list_files(spark, path, pattern)
    if not files:
        raise ValueError(f"no file matches {pattern} in {path}")
    groups, skipped = discovery.alike(spark, fmt, files, lambda file: _file_schema(spark, fmt, file))
    if not groups:
        raise ValueError(f"no readable file matches {pattern} in {path}: {skipped[0][1]}")
    # the name in the metadata is percent-encoded; a plus sign stands for itself
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias(FILE_COLUMN)
    convert = typed_csv.converted if fmt == "csv" else lambda column, kind: column.cast(kind)
    rows = [
        frame.select(
            *[convert(F.col(f"`{n}`"), t).alias(n) if n in frame.columns else F.lit(None).cast(t).alias(n) for n, t in wanted.items()],
            name,
        )
        for frame, wanted in _typed(spark, fmt, groups, schema)
    ]
    return Folder(union_by_name(rows), skipped)


def load_directory(
    spark: SparkSession, path: str, pattern: str = "*.parquet", schema: T.StructType | None = None
) -> DataFrame:
    """The rows of ``read_directory``; files that cannot be opened are left out."""
    return read_directory(spark, path, pattern, schema).rows.drop(FILE_COLUMN)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, absent ones NULL."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_labels(df: DataFrame, file: str, rules=S.FILENAME_KEYWORDS, unmatched: str = "normal") -> DataFrame:
    """Add ``anomaly_type`` and the binary ``Label`` by file name.

    ``unmatched='skip'`` drops the rows of unrecognised files.
    """
    labelled = df.withColumn(S.TARGET, scalars.label_from_filename(file, rules, unmatched))
    if unmatched == "skip":
        labelled = labelled.filter(F.col(S.TARGET).isNotNull())
    return labelled.withColumn("Label", scalars.binary_label(S.TARGET))


def load_labelled(
    spark: SparkSession,
    path: str,
    pattern: str = "*.parquet",
    schema: T.StructType | None = None,
    rules=S.FILENAME_KEYWORDS,
    unmatched: str = "normal",
) -> DataFrame:
    """A folder of captures with ``file_name``, ``anomaly_type`` and ``Label``."""
    df = read_directory(spark, path, pattern, schema).rows
    return with_labels(df.withColumnRenamed(FILE_COLUMN, "file_name"), "file_name", rules, unmatched)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt not in WRITABLE:
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def save_report(df: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_split_dataset(df: DataFrame, path: str, split: str = "split", target: str = S.TARGET) -> DataFrame:
    """Rows partitioned by split, and their statistics beside them.

    The statistics are taken from the written table, so the split runs once.
    """
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    save_report(profile.split_statistics(written, split, target), f"{path}/statistics")
    save_report(profile.column_types(written.drop(split, target)), f"{path}/features")
    return written


def save_class_weights(df: DataFrame, path: str, target: str = S.TARGET) -> None:
    save_report(profile.class_weights(df, target), path)


def observed(df: DataFrame, columns: list[Column], write: Callable[[DataFrame], None]) -> DataFrame:
    """One row of aggregates over ``df``, taken while ``write`` writes it: the rows are evaluated and scanned once."""
    seen = Observation()
    write(df.observe(seen, *columns))
    found = seen.get
    names = df.limit(0).agg(*columns).schema
    return df.sparkSession.createDataFrame([tuple(found[f.name] for f in names)], T.StructType([T.StructField(f.name, f.dataType) for f in names]))


def save_predictions(df: DataFrame, path: str) -> DataFrame:
    """Write processed rows with label, confidence and path of the detection; returns their detection summary."""
    kept = df.withColumnRenamed("label", "predicted_label").drop("prediction", "probabilities")
    summary = detect.summary_columns("predicted_label")
    return observed(kept, summary, lambda rows: rows.write.mode("overwrite").parquet(path))


def save_evaluation(df: DataFrame, path: str, truth: str = S.TARGET, predicted: str = "label") -> None:
    """Rows with ``is_correct``, the report, the error types and the class metrics.

    The report is observed while the rows are written; the two others come from one table of confusion counts.
    """
    marked = evaluate.with_correctness(df, truth, predicted)
    columns = evaluate.report_columns(truth, predicted)
    report = observed(marked, columns, lambda rows: rows.write.mode("overwrite").parquet(f"{path}/rows"))
    save_report(report, f"{path}/report")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    counted = evaluate.confusion_counts(written, truth, predicted)
    # a row per pair of classes
    confusion = df.sparkSession.createDataFrame(counted.collect(), counted.schema)
    save_report(evaluate.error_types_of(confusion), f"{path}/error_types")
    save_report(evaluate.report_of(confusion), f"{path}/classes")
