"""Fitted linear scaling of columns."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats


@dataclass
class Scaler:
    """``(value - shift) / scale`` per column; a constant column keeps scale 1."""

    parameters: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in self.parameters.items() if c in df.columns}
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.col(f"`{c}`") * F.lit(s) + F.lit(m) for c, (m, s) in self.parameters.items() if c in df.columns}
        )

    def to_json(self) -> str:
        return json.dumps(self.parameters)

    @classmethod
    def from_json(cls, text: str) -> "Scaler":
        return cls({c: tuple(p) for c, p in json.loads(text).items()})


def _scale(value: float | None) -> float:
    return float(value) if value else 1.0


def fit_scaler(df: DataFrame, columns, method: str = "standard", rows: int | None = None, **limits) -> Scaler:
    """``standard`` (population deviation), ``minmax`` or ``robust`` (median, IQR)."""
    columns = list(columns)
    if method not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown scaling method: {method}")
    values = stats.clean_nan(df, columns)
    if method == "robust":
        q = stats.quantiles(values, {c: [0.25, 0.5, 0.75] for c in columns}, rows, **limits)
        return Scaler({c: (v[1] or 0.0, _scale(v[2] - v[0] if v[1] is not None else None)) for c, v in q.items()})
    if method == "standard":
        pairs = [(F.avg(F.col(f"`{c}`")), F.stddev_pop(F.col(f"`{c}`"))) for c in columns]
    else:
        pairs = [
            (F.min(F.col(f"`{c}`")), F.max(F.col(f"`{c}`")) - F.min(F.col(f"`{c}`"))) for c in columns
        ]
    row = values.agg(
        *[F.struct(m.cast("double").alias("m"), s.cast("double").alias("s")).alias(f"p{i}") for i, (m, s) in enumerate(pairs)]
    ).first()
    return Scaler({c: (r["m"] or 0.0, _scale(r["s"])) for c, r in zip(columns, row)})
