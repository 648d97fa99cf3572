"""Validation, coercion and repair of flow tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalars, stats

LARGE_VALUE = 1e10
WINSOR_SHARE = 0.999
INFINITY = float("inf")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# --- contracts ----------------------------------------------------------------


def missing_columns(df: DataFrame, required) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required) -> DataFrame:
    """``df`` itself, or an error that names the absent columns."""
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df


def _bad_port(column: str, kind: T.DataType) -> Column:
    """Whether a port is out of range, or text that is no number; NULL passes."""
    if isinstance(kind, T.NumericType):
        return ~F.col(column).between(0, S.MAX_PORT)
    number = F.col(column).cast("string").try_cast("double")
    return F.col(column).isNotNull() & ~F.coalesce(number.between(0, S.MAX_PORT), F.lit(False))


def flow_violations(df: DataFrame, required=S.NETWORK_FEATURES) -> DataFrame:
    """Broken rules as (``rule``, ``column_name``, ``violations``), from one scan.

    Schema rules count 1, value rules count rows. NULL addresses and ports pass.
    """
    schema_faults = [("missing_feature", c, 1) for c in missing_columns(df, required)]
    types = {f.name: f.dataType for f in df.schema.fields}
    schema_faults += [
        ("not_numeric", c, 1)
        for c in S.MUST_BE_NUMERIC
        if c in types and not isinstance(types[c], T.NumericType)
    ]
    checks = {
        ("invalid_ip", c): F.count_if(~scalars.is_valid_ip(F.col(c).cast("string")))
        for c in S.IP_COLUMNS
        if c in types
    }
    checks |= {("invalid_port", c): F.count_if(_bad_port(c, types[c])) for c in S.PORT_COLUMNS if c in types}
    schema = "rule string, column_name string, violations bigint"
    faults = df.sparkSession.createDataFrame(schema_faults, schema)
    if not checks:
        return faults
    counted = df.agg(
        F.array(
            *[
                F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column_name"), n.alias("violations"))
                for (rule, c), n in checks.items()
            ]
        ).alias("checks")
    ).select(F.inline("checks"))
    return faults.unionByName(counted.filter(F.col("violations") > 0))


def validate_flows(df: DataFrame, required=S.NETWORK_FEATURES) -> tuple[bool, list[str]]:
    """Whether ``df`` keeps every rule, and a line per broken one."""
    broken = flow_violations(df, required).orderBy("rule", "column_name").collect()
    errors = [f"{r['rule']}: {r['column_name']} ({r['violations']})" for r in broken]
    return not errors, errors


def contract_reasons(df: DataFrame) -> Column:
    """Array of the reasons why a row breaks the typed flow contract."""
    present = set(df.columns)
    checks = [
        (F.col(c).isNull() if c in present else F.lit(True), f"missing:{c}") for c in S.REQUIRED_FIELDS
    ]
    checks += [(_bad_port(c, df.schema[c].dataType), f"range:{c}") for c in S.PORT_COLUMNS if c in present]
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in checks]))


def split_by_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their ``reasons``)."""
    marked = df.withColumn("reasons", contract_reasons(df))
    broken = F.size("reasons") > 0
    return marked.filter(~broken).drop("reasons"), marked.filter(broken)


# --- coercion and missing values ------------------------------------------------


def coerce_numeric(df: DataFrame, columns, bad_as: float | None = None) -> DataFrame:
    """Existing ``columns`` as double; what is no number becomes NULL or ``bad_as``."""
    numeric = set(S.numeric_columns(df))
    out = {}
    for c in columns:
        if c not in df.columns:
            continue
        if c in numeric:
            value = _q(c).cast("double")
            value = scalars.nan_to_null(value) if c in S.floating_columns(df, [c]) else value
        else:
            value = scalars.to_number(_q(c))
        out[c] = value if bad_as is None else F.coalesce(value, F.lit(float(bad_as)))
    return df.withColumns(out) if out else df


def missing_counts(df: DataFrame, columns=None) -> DataFrame:
    """(``column_name``, ``missing``) for every column, NaN counted as missing."""
    columns = list(columns or df.columns)
    floating = S.floating_columns(df, columns)
    counts = [
        F.count_if(_q(c).isNull() | F.isnan(_q(c))) if c in floating else F.count_if(_q(c).isNull())
        for c in columns
    ]
    return df.agg(
        F.array(
            *[F.struct(F.lit(c).alias("column_name"), n.alias("missing")) for c, n in zip(columns, counts)]
        ).alias("rows")
    ).select(F.inline("rows"))


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


@dataclass
class FillValues:
    """Fitted replacements for missing values; a float makes its column double."""

    values: dict[str, object] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        known = {c: v for c, v in self.values.items() if v is not None and c in df.columns}
        if not known:
            return df
        floating = S.floating_columns(df, known)
        types = {f.name: f.dataType for f in df.schema.fields}
        filled = {}
        for c, v in known.items():
            value = scalars.nan_to_null(_q(c)) if c in floating else _q(c)
            kind = "double" if isinstance(v, float) else types[c]
            filled[c] = F.coalesce(value.cast(kind), F.lit(v).cast(kind))
        return df.withColumns(filled)


def fit_fill(df: DataFrame, method: str = "median", exclude=(), rows: int | None = None, **limits) -> FillValues:
    """Median or mean of the numeric columns, or mode of all columns."""
    numeric = S.numeric_columns(df, exclude)
    if method == "median":
        return FillValues(stats.medians(df, numeric, rows, **limits))
    if method == "mean":
        return FillValues(stats.means(df, numeric))
    if method == "mode":
        return FillValues(stats.modes(df, numeric + S.string_columns(df, exclude)))
    raise ValueError(f"unknown fill method: {method}")


def handle_missing(df: DataFrame, method: str = "median", exclude=(), cache: bool = True) -> DataFrame:
    """Drop rows with missing values, or fill them by mean, median or mode."""
    if method == "drop":
        return drop_missing(df)
    if method not in ("mean", "median", "mode"):
        raise ValueError(f"unknown fill method: {method}")
    numeric = S.numeric_columns(df, exclude)
    needed = numeric + (S.string_columns(df, exclude) if method == "mode" else [])
    with stats.scratch(df.select(*[_q(c) for c in needed]), cache and method == "median") as values:
        fill = fit_fill(values, method)
    return fill.transform(df)


# --- infinities and large values ------------------------------------------------


def quality_issues(df: DataFrame, exclude=(S.TARGET,)) -> DataFrame:
    """(``column_name``, ``issue``, ``value``) of each problem in the numeric columns.

    ``infinite`` and ``missing`` count rows, ``large`` is the maximum beyond 1e10.
    """
    columns = S.numeric_columns(df, exclude)
    floating = S.floating_columns(df, columns)
    found = []
    for c in columns:
        value = scalars.nan_to_null(_q(c)) if c in floating else _q(c)
        largest = F.max(value).cast("double")
        issues = {
            "infinite": F.count_if(F.abs(value) == INFINITY) if c in floating else F.lit(0),
            "large": F.when(largest > LARGE_VALUE, largest).otherwise(0.0),
            "missing": F.count_if(value.isNull()),
        }
        found += [
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("issue"), v.cast("double").alias("value"))
            for k, v in issues.items()
        ]
    return df.agg(F.array(*found).alias("issues")).select(F.inline("issues")).filter(F.col("value") > 0)


@dataclass
class InfinityRepair:
    """Replace both infinities of a column by its largest finite value."""

    largest: dict[str, float | None]
    all_infinite: float | None = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, v in self.largest.items():
            replacement = self.all_infinite if v is None else v
            if c in df.columns and replacement is not None:
                out[c] = F.when(F.abs(_q(c)) == INFINITY, F.lit(replacement)).otherwise(_q(c))
        return df.withColumns(out) if out else df


def fit_infinity_repair(df: DataFrame, exclude=(S.TARGET,), all_infinite: float | None = 0.0) -> InfinityRepair:
    """``all_infinite`` is what a column without finite values gets; None leaves it."""
    columns = [c for c in S.numeric_columns(df, exclude) if c in S.floating_columns(df, df.columns)]
    if not columns:
        return InfinityRepair({}, all_infinite)
    values = [scalars.nan_to_null(_q(c)) for c in columns]
    largest = [F.max(F.when(F.abs(v) < INFINITY, v)).alias(f"m{i}") for i, v in enumerate(values)]
    return InfinityRepair(dict(zip(columns, df.agg(*largest).first())), all_infinite)


@dataclass
class UpperCap:
    """Cut values above a fitted threshold."""

    thresholds: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {c: scalars.clip(_q(c), None, t) for c, t in self.thresholds.items() if c in df.columns}
        return df.withColumns(out) if out else df


def fit_winsorize(df: DataFrame, exclude=(S.TARGET,), rows: int | None = None, **limits) -> UpperCap:
    """99.9 % quantile of each column whose maximum is beyond 1e10."""
    columns = S.numeric_columns(df, exclude)
    if not columns:
        return UpperCap({})
    clean = stats.clean_nan(df, columns)
    row = clean.agg(*[F.max(_q(c)).cast("double").alias(f"m{i}") for i, c in enumerate(columns)]).first()
    large = [c for c, v in zip(columns, row) if v is not None and v > LARGE_VALUE]
    return UpperCap({c: q[0] for c, q in stats.quantiles(clean, {c: [WINSOR_SHARE] for c in large}, rows, **limits).items()})


@dataclass
class DataRepair:
    """Infinity repair, then winsorizing, then median fill, as fitted."""

    infinity: InfinityRepair
    cap: UpperCap
    fill: FillValues

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fill.transform(self.cap.transform(self.infinity.transform(df)))


def fit_data_repair(df: DataFrame, exclude=(S.TARGET,), cache: bool = True, **limits) -> DataRepair:
    """Fit each repair on the output of the one before it."""
    numeric = S.numeric_columns(df, exclude)
    with stats.scratch(df.select(*[_q(c) for c in numeric]), cache) as values:
        rows = values.count()
        infinity = fit_infinity_repair(values)
        finite = infinity.transform(values)
        cap = fit_winsorize(finite, rows=rows, **limits)
        capped = cap.transform(finite)
        row = missing_counts(capped, numeric).filter(F.col("missing") > 0).collect()
        fill = FillValues(stats.medians(capped, [r["column_name"] for r in row], rows, **limits))
    return DataRepair(infinity, cap, fill)


def repair_if_needed(df: DataFrame, exclude=(S.TARGET,), cache: bool = True) -> DataFrame:
    """``df`` repaired if the quality report names anything, else unchanged."""
    if not quality_issues(df, exclude).limit(1).count():
        return df
    return fit_data_repair(df, exclude, cache).transform(df)


def clean_features(df: DataFrame, exclude=(S.TARGET,), cache: bool = True) -> DataFrame:
    """Drop identifiers, coerce text to numbers, fill missing values by the median."""
    kept = df.drop(*S.IDENTIFIER_COLUMNS, "Label")
    numbers = coerce_numeric(kept, S.string_columns(kept, exclude))
    return handle_missing(numbers, "median", exclude, cache)


def run_over_tables(spark, jobs: dict[str, tuple[str, str]], step) -> dict[str, str]:
    """Apply ``step`` to each (input, output) Parquet table; failures are skipped.

    Returns what became of each named table.
    """
    outcome = {}
    for name, (source, target) in jobs.items():
        try:
            step(spark.read.parquet(source)).write.mode("overwrite").parquet(target)
            outcome[name] = "written"
        except Exception as error:  # a missing or unreadable table must not stop the others
            outcome[name] = f"skipped: {type(error).__name__}"
    return outcome
