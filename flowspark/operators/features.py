"""Feature engineering: fit once on a batch, transform any table or stream."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars, stats
from ..session import compile_wide_rows
from .encoding import LabelCodes, fit_label_codes
from .quality import FillValues, InfinityRepair, coerce_numeric, fit_infinity_repair

COERCED = S.COERCED_COLUMNS + S.PORT_COLUMNS
IQR_REACH = 1.5
MICROSECONDS = 1_000_000


def derive_features(df: DataFrame) -> DataFrame:
    """Ratios, buckets and the protocol code, each where its inputs exist."""
    have = set(df.columns)
    new = {}
    for name, forward, backward in (
        ("src_dst_byte_ratio", "src_to_dst_bytes", "dst_to_src_bytes"),
        ("src_dst_packet_ratio", "src_to_dst_packets", "dst_to_src_packets"),
    ):
        if {forward, backward} <= have:
            new[name] = scalars.forward_share(forward, backward)
    if "flow_duration" in have:
        new["flow_duration_category"] = scalars.duration_bucket("flow_duration")
    if "avg_packet_size" in have:
        new["packet_size_category"] = scalars.packet_size_bucket("avg_packet_size")
    if "protocol" in have:
        new["protocol_encoded"] = scalars.protocol_code("protocol").cast("double")
    return df.withColumns(new) if new else df


def encode_known(df: DataFrame) -> DataFrame:
    """Addresses as integers and protocols as codes, in place."""
    new = {c: scalars.ip_to_int(c) for c in S.IP_COLUMNS if c in S.string_columns(df)}
    if "protocol" in S.string_columns(df):
        new["protocol"] = scalars.protocol_code("protocol").cast("double")
    return df.withColumns(new) if new else df


@dataclass
class IqrBounds:
    """Fitted clip bounds; missing values stay missing."""

    bounds: dict[str, list[float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        new = {
            c: scalars.clip(F.col(f"`{c}`").cast("double"), low, high)
            for c, (low, high) in self.bounds.items()
            if c in df.columns
        }
        return df.withColumns(new) if new else df


def iqr_bounds(quartiles: dict[str, list[float | None]]) -> IqrBounds:
    """Quartiles widened by 1.5 interquartile ranges.

    A bound that an infinite quartile makes undefined is left open.
    """
    out = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is None:
            continue
        reach = IQR_REACH * (q3 - q1)
        low, high = q1 - reach, q3 + reach
        out[c] = [None if low != low else low, None if high != high else high]
    return IqrBounds(out)


def fit_iqr_bounds(df: DataFrame, exclude=(), rows: int | None = None, **limits) -> IqrBounds:
    return iqr_bounds(stats.quartiles(df, S.numeric_columns(df, exclude), rows, **limits))


@dataclass
class FlowPreprocessorModel:
    """Coerce, fill, derive, encode and clip with the fitted statistics."""

    target: str | None
    keep: list[str]
    fill: FillValues
    codes: LabelCodes
    bounds: IqrBounds
    features: list[str] = field(default_factory=list)
    infinity: InfinityRepair | None = None

    def _filled(self, df: DataFrame) -> DataFrame:
        compile_wide_rows(df.sparkSession)
        typed = coerce_numeric(df, COERCED)
        if self.infinity is not None:
            typed = self.infinity.transform(typed)
        return self.fill.transform(typed)

    def _derived(self, df: DataFrame) -> DataFrame:
        return encode_known(derive_features(df))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.bounds.transform(self.codes.transform(self._derived(self._filled(df))))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=False)

    @classmethod
    def from_json(cls, text: str) -> "FlowPreprocessorModel":
        state = json.loads(text)
        return cls(
            target=state["target"],
            keep=state["keep"],
            fill=FillValues(**state["fill"]),
            codes=LabelCodes(**state["codes"]),
            bounds=IqrBounds(**state["bounds"]),
            features=state["features"],
            infinity=InfinityRepair(**state["infinity"]) if state["infinity"] else None,
        )

    def stored_under(self, spark: SparkSession, path: str) -> "FlowPreprocessorModel":
        """The same model without references to the work folder."""
        return replace(self, codes=self.codes.stored_under(spark, path))

    def save(self, spark: SparkSession, path: str) -> None:
        text = self.stored_under(spark, path).to_json()
        spark.createDataFrame([(text,)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FlowPreprocessorModel":
        return cls.from_json(spark.read.text(f"{path}/state").first()["value"])


@dataclass
class FlowPreprocessor:
    """Estimator of the whole preprocessing.

    ``keep`` columns (row keys) pass through untouched, as does ``target``.
    ``repair_infinite`` replaces infinities before statistics are taken;
    ``clip_exclude`` names numeric columns that are not clipped.
    """

    target: str | None = None
    keep: tuple[str, ...] = ()
    repair_infinite: bool = False
    clip_exclude: tuple[str, ...] = ()
    limits: dict[str, int] = field(default_factory=dict)

    def fit(self, df: DataFrame, cache: bool = True) -> FlowPreprocessorModel:
        aside = set(self.keep) | ({self.target} if self.target else set())
        model = FlowPreprocessorModel(self.target, list(self.keep), FillValues(), LabelCodes(), IqrBounds())
        features = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in aside])
        with stats.scratch(features, cache) as values:
            rows = values.count()
            typed = coerce_numeric(values, COERCED)
            if self.repair_infinite:
                model.infinity = fit_infinity_repair(typed, ())
                typed = model.infinity.transform(typed)
            fill = stats.medians(typed, S.numeric_columns(typed), rows, **self.limits)
            fill |= stats.modes(typed, S.string_columns(typed))
            model.fill = FillValues(fill)
            derived = model._derived(model._filled(values))
            model.codes = fit_label_codes(derived, S.string_columns(derived))
            encoded = model.codes.transform(derived)
            model.features = S.numeric_columns(encoded)
            model.bounds = fit_iqr_bounds(encoded, self.clip_exclude, rows, **self.limits)
        return model

    def fit_transform(self, df: DataFrame, cache: bool = True) -> DataFrame:
        """Statistics of ``df`` applied to ``df`` itself."""
        return self.fit(df, cache).transform(df)


# --- raw flow-meter tables --------------------------------------------------------


def drop_identifiers(df: DataFrame, also=()) -> DataFrame:
    return df.drop(*S.IDENTIFIER_COLUMNS, *also)


def rename_features(df: DataFrame, names=None) -> DataFrame:
    """Rename by the map, keep every other column."""
    return df.withColumnsRenamed(names or S.FLOW_METER_NAMES)


def add_missing_columns(df: DataFrame, defaults=None) -> DataFrame:
    """Constant columns for the absent ones among ``defaults``."""
    new = {c: F.lit(v) for c, v in (defaults or S.MISSING_COLUMN_DEFAULTS).items() if c not in df.columns}
    return df.withColumns(new) if new else df


def add_totals(df: DataFrame) -> DataFrame:
    """Packet and byte totals of both directions; durations from micro- to seconds."""
    have, new = set(df.columns), {}
    if {"src_to_dst_packets", "dst_to_src_packets"} <= have:
        new["total_packets"] = F.col("src_to_dst_packets") + F.col("dst_to_src_packets")
    if {"src_to_dst_bytes", "dst_to_src_bytes"} <= have:
        new["total_bytes"] = F.col("src_to_dst_bytes") + F.col("dst_to_src_bytes")
    if "flow_duration" in have:
        new["flow_duration"] = F.col("flow_duration") / MICROSECONDS
    return df.withColumns(new) if new else df


def name_labels(df: DataFrame) -> DataFrame:
    """Integer ``label`` replaced by the class name."""
    if "label" not in df.columns:
        return df
    return df.withColumn(S.TARGET, scalars.class_name("label")).drop("label")


def feature_columns(df: DataFrame, exclude=()) -> list[str]:
    """Every column that is neither target nor label nor excluded."""
    return [c for c in df.columns if c not in (S.TARGET, "label", *exclude)]


def align_features(df: DataFrame, columns, keep=(), only_available: bool = False) -> DataFrame:
    """``keep`` columns, then the model's columns in order.

    An absent column is a NULL double for the fitted fill, or left out.
    """
    have = set(df.columns)
    wanted = [c for c in columns if c in have] if only_available else list(columns)
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[F.col(f"`{c}`") if c in have else F.lit(None).cast("double").alias(c) for c in wanted],
    )


@dataclass
class RawFlowAdapterModel:
    """Raw flow-meter rows to core columns with the fitted statistics."""

    keep: list[str]
    fill: FillValues
    bounds: IqrBounds

    def transform(self, df: DataFrame) -> DataFrame:
        compile_wide_rows(df.sparkSession)
        renamed = rename_features(self.fill.transform(df))
        totals = add_totals(self.bounds.transform(renamed))
        complete = add_missing_columns(name_labels(totals))
        return coerce_numeric(complete, S.string_columns(complete, (*self.keep, S.TARGET)), bad_as=0)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "RawFlowAdapterModel":
        state = json.loads(text)
        return cls(state["keep"], FillValues(**state["fill"]), IqrBounds(**state["bounds"]))


@dataclass
class RawFlowAdapter:
    """Estimator for raw flow-meter tables."""

    keep: tuple[str, ...] = ()
    limits: dict[str, int] = field(default_factory=dict)

    def fit(self, df: DataFrame, cache: bool = True) -> RawFlowAdapterModel:
        numeric = S.numeric_columns(df, self.keep)
        with stats.scratch(df.select(*[F.col(f"`{c}`") for c in numeric]), cache) as values:
            rows = values.count()
            fill = FillValues(stats.medians(values, numeric, rows, **self.limits))
            renamed = rename_features(fill.transform(values))
            bounds = fit_iqr_bounds(renamed, ("label",), rows, **self.limits)
        return RawFlowAdapterModel(list(self.keep), fill, bounds)

    def fit_transform(self, df: DataFrame, cache: bool = True) -> DataFrame:
        return self.fit(df, cache).transform(df)
