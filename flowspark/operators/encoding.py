"""Label encoding: codes by the sorted order of the distinct values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, stats
from ..session import checkpoint, work_path

MISSING_TEXT = "nan"
LITERAL_CODES = 1000


@dataclass
class LabelCodes:
    """Fitted codes; a value unseen at fit time gets the next free code.

    Short vocabularies are literals of the plan. Long ones are (``value``,
    ``code``) tables on shared storage, joined however their size suggests.
    """

    short: dict[str, list[str]] = field(default_factory=dict)
    long: dict[str, str] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        short = {c: v for c, v in self.short.items() if c in df.columns}
        out = df.withColumns(
            {
                c + suffix: F.coalesce(
                    scalars.lookup(_text(c), {v: i for i, v in enumerate(values)}), F.lit(len(values))
                ).cast("bigint")
                for c, values in short.items()
                if values
            }
        )
        for c, path in self.long.items():
            if c not in out.columns:
                continue
            table = df.sparkSession.read.parquet(path)
            joined = out.join(
                table.select(F.col("value").alias("_value"), F.col("code").alias("_code")),
                _text(c) == F.col("_value"),
                "left",
            )
            code = F.coalesce(F.col("_code"), F.lit(self.sizes[c])).cast("bigint")
            out = joined.withColumn(c + suffix, code).drop("_value", "_code")
        return out


    def stored_under(self, spark: SparkSession, path: str) -> "LabelCodes":
        """The same codes with the long tables copied below ``path``."""
        long = {}
        for i, (c, source) in enumerate(self.long.items()):
            long[c] = f"{path}/codes_{i}"
            spark.read.parquet(source).write.mode("overwrite").parquet(long[c])
        return LabelCodes(self.short, long, self.sizes)


def _text(c: str):
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING_TEXT))


def rank_values(values: DataFrame) -> DataFrame:
    """(``value``, ``code``) with codes 0, 1, ... over distinct sorted values.

    Values are range-partitioned and ranked inside their range; the checkpoint
    fixes the ranges before their sizes are added up.
    """
    ranged = checkpoint(values.repartitionByRange("value").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy("value")
    # one row per range partition, so the broadcast side is bounded by the partition count
    return (
        ranged.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_range")
        .select("value", (F.col("_start") + F.col("_inside")).cast("bigint").alias("code"))
    )


def fit_label_codes(df: DataFrame, columns, literal_codes: int = LITERAL_CODES) -> LabelCodes:
    """Codes of the text ``columns``; missing values count as the text ``nan``."""
    columns = list(columns)
    if not columns:
        return LabelCodes()
    texts = df.select(*[_text(c).alias(c) for c in columns])
    counts = stats.value_counts(texts, columns).select("column_name", "value")
    with stats.scratch(counts) as values:
        sizes = {r["column_name"]: r["n"] for r in values.groupBy("column_name").agg(F.count("*").alias("n")).collect()}
        small = [c for c in columns if sizes.get(c, 0) <= literal_codes]
        rows = values.filter(F.col("column_name").isin(small)).collect() if small else []
        short = {c: sorted(r["value"] for r in rows if r["column_name"] == c) for c in small}
        long = {}
        for c in columns:
            if c in small:
                continue
            long[c] = work_path(df.sparkSession, f"codes-{columns.index(c)}")
            rank_values(values.filter(F.col("column_name") == c).select("value")).write.parquet(long[c])
    return LabelCodes(short, long, sizes)
