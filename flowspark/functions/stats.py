"""Statistics that stay exact and bounded in memory at any table size.

``percentile`` keeps every distinct value of a column in one task, so it is used only behind a check of the number of
rows. Beyond it, order statistics are searched with pivots from mergeable sketches and exact counts. Modes come from a
table of all values' counts, or beyond a size from exact counts of the values that summaries name.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .scalars import nan_to_null

ONE_AGGREGATE_CELLS = 10_000_000
LEAF_ROWS = 20_000
#: Items of a quantile sketch (about 200 KB), and the share of rows that its ranks are trusted to: 1.5 times its error.
SKETCH_ITEMS, SKETCH_MARGIN = 8192, 0.001
#: Values that a summary of frequent ones tracks, the share of rows that a value it leaves out may have (twice its error),
#: and the candidates that are counted.
TRACKED, TRACKED_ERROR, CANDIDATES = 3072, 2 * 3.5 / 4096, 16
#: Rows times columns up to which all values are counted at once.
COUNT_ALL_CELLS = 10_000_000


@contextmanager
def scratch(df: DataFrame, cache: bool = True):
    """Keep ``df`` for several passes over it and free it afterwards.

    Lost blocks are recomputed from the lineage. Pass ``cache=False`` when ``df``
    is a plain scan of a stored table, which is cheaper to read again.
    """
    if not cache:
        yield df
        return
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def clean_nan(df: DataFrame, columns) -> DataFrame:
    """NaN as NULL in the floating columns among ``columns``."""
    floating = [c for c in columns if c in S.floating_columns(df, columns)]
    return df.withColumns({c: nan_to_null(c) for c in floating}) if floating else df


def interpolate(low, high, fraction: float):
    if low is None or fraction == 0 or low == high:
        return low
    return (1 - fraction) * low + fraction * high


@dataclass(frozen=True)
class _Interval:
    """An open value range of a column that holds the wanted ranks, with a sketch of its values once there is one."""

    column: str
    low: float | None
    high: float | None
    offset: int
    rows: int
    ranks: tuple[int, ...]
    sketch: bytes | None = None

    def value(self) -> Column:
        return _inside(F.col(f"`{self.column}`"), self.low, self.high)

    def leaf_values(self) -> Column:
        """Values at the ranks, from the sorted rows of a short range."""
        ordered = F.sort_array(F.collect_list(self.value()))
        return F.array(*[F.element_at(ordered, r - self.offset + 1) for r in self.ranks])

    def pivot_shares(self) -> list[float]:
        """The ends of stretches that hold the ranks as far as a sketch can be trusted; stretches that meet are one."""
        stretches: list[list[float]] = []
        for share in ((r - self.offset) / self.rows for r in self.ranks):
            low, high = max(0.0, share - SKETCH_MARGIN), min(1.0, share + SKETCH_MARGIN)
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = high
            else:
                stretches.append([low, high])
        return [end for stretch in stretches for end in stretch]

    def gaps(self, pivots: list[float]) -> list[tuple[float | None, float | None]]:
        ends = [self.low, *pivots, self.high]
        return list(zip(ends, ends[1:]))

    def counters(self, pivots: list[float]) -> list[Column]:
        v = self.value()
        return [c for p in pivots for c in (F.count_if(v < p), F.count_if(v == p))]

    def split(self, pivots: list[float], counted: list[int], sketches: list, found: dict) -> list["_Interval"]:
        """The gaps between the pivots that hold ranks, with their sketches; ranks on a pivot are done."""
        out, start = [], 0
        below, on = counted[::2] + [self.rows], counted[1::2] + [0]
        for i, (low, high) in enumerate(self.gaps(pivots)):
            n = below[i] - start
            ranks = tuple(r for r in self.ranks if start <= r - self.offset < below[i])
            if ranks:
                out.append(_Interval(self.column, low, high, self.offset + start, n, ranks, sketches[i]))
            if on[i]:
                here = (r for r in self.ranks if below[i] <= r - self.offset < below[i] + on[i])
                found.update({(self.column, r): pivots[i] for r in here})
            start = below[i] + on[i]
        return out


def _inside(v: Column, low: float | None, high: float | None) -> Column:
    inside = v.isNotNull()
    if low is not None:
        inside = inside & (v > F.lit(low))
    if high is not None:
        inside = inside & (v < F.lit(high))
    return F.when(inside, v)


def _sketch(v: Column) -> Column:
    return F.kll_sketch_agg_double(v, F.lit(SKETCH_ITEMS))


def _pivots(df: DataFrame, wide: list[_Interval]) -> list[list[float]]:
    """Values of the table near the ranks of each range, read off its sketch."""
    names = [f"s{i}" for i in range(len(wide))]
    states = df.sparkSession.createDataFrame([tuple(bytearray(s.sketch) for s in wide)], ", ".join(f"{n} binary" for n in names))
    shares = [F.array(*map(F.lit, s.pivot_shares())) for s in wide]
    row = states.select(*[F.kll_sketch_get_quantile_double(n, q).alias(n) for n, q in zip(names, shares)]).first()
    return [sorted(set(values)) for values in row]


def order_statistics(
    df: DataFrame,
    ranks: dict[str, set[int]],
    counts: dict[str, int],
    leaf_rows: int = LEAF_ROWS,
    sketches: dict[str, bytes] | None = None,
) -> dict[tuple[str, int], float]:
    """Values at 0-based ``ranks`` of the non-missing values of each double column.

    Each pass is one aggregate for all columns, without a shuffle or an unpivot of rows: it counts the values below and
    on the pivots that the sketches name, sketches the gaps between the pivots for the next pass, and sorts ranges of at
    most ``leaf_rows``. A pass narrows a range about 500 times, so beside the one that ``sketches`` come from ten million
    rows need two passes and a trillion needs four. Sketches only name pivots; what they get wrong costs a pass.
    """
    found: dict[tuple[str, int], float] = {}
    given = sketches or {}
    todo = [
        _Interval(c, None, None, 0, counts[c], tuple(sorted(r)), given.get(c)) for c, r in ranks.items() if r and counts[c]
    ]
    while todo:
        leaves = [s for s in todo if s.rows <= leaf_rows]
        wide = [s for s in todo if s.rows > leaf_rows and s.sketch is not None]
        bare = [s for s in todo if s.rows > leaf_rows and s.sketch is None]
        pivots = _pivots(df, wide) if wide else []
        measures = [s.leaf_values() for s in leaves] + [_sketch(s.value()) for s in bare]
        for s, cuts in zip(wide, pivots):
            v = F.col(f"`{s.column}`")
            # the outer gaps rarely hold a rank; where one does, it is sketched in a pass of its own
            measures += s.counters(cuts) + [_sketch(_inside(v, low, high)) for low, high in s.gaps(cuts)[1:-1]]
        row = iter(df.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)]).first())
        for s in leaves:
            found.update({(s.column, r): v for r, v in zip(s.ranks, next(row))})
        todo = [replace(s, sketch=next(row)) for s in bare]
        for s, cuts in zip(wide, pivots):
            counted = [next(row) for _ in range(2 * len(cuts))]
            inner = [next(row) for _ in cuts[1:]]
            todo += s.split(cuts, counted, [None, *inner, None], found)
    return found


def quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    rows: int | None = None,
    one_aggregate_cells: int = ONE_AGGREGATE_CELLS,
    leaf_rows: int = LEAF_ROWS,
    approximate: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation; missing values are skipped.

    Small tables take one ``percentile`` aggregate, larger ones a pass that counts and sketches, then the pivot search.
    ``approximate`` is an accuracy for those who prefer a single pass with existing
    values within ``rows / accuracy`` ranks of the exact ones.
    """
    wanted = {c: list(p) for c, p in wanted.items() if p}
    if not wanted:
        return {}
    # doubles on every path, as percentile takes them
    values = clean_nan(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in wanted]), wanted)
    if approximate:
        row = values.agg(
            *[
                F.percentile_approx(F.col(f"`{c}`").cast("double"), p, approximate).alias(f"q{i}")
                for i, (c, p) in enumerate(wanted.items())
            ]
        ).first()
        return {c: list(q) if q is not None else [None] * len(wanted[c]) for c, q in zip(wanted, row)}
    rows = values.count() if rows is None else rows
    if rows * len(wanted) <= one_aggregate_cells:
        row = values.agg(
            *[F.percentile(F.col(f"`{c}`"), p).alias(f"q{i}") for i, (c, p) in enumerate(wanted.items())]
        ).first()
        return {c: list(q) if q is not None else [None] * len(wanted[c]) for c, q in zip(wanted, row)}
    seen = [(F.count(v).alias(f"n{i}"), _sketch(v).alias(f"s{i}")) for i, v in enumerate(F.col(f"`{c}`") for c in wanted)]
    row = values.agg(*[m for pair in seen for m in pair]).first()
    counts, sketches = dict(zip(wanted, row[::2])), dict(zip(wanted, row[1::2]))
    ranks: dict[str, set[int]] = {}
    for c, shares in wanted.items():
        positions = [p * (counts[c] - 1) for p in shares] if counts[c] else []
        ranks[c] = {r for x in positions for r in (math.floor(x), math.ceil(x))}
    found = order_statistics(values, ranks, counts, leaf_rows, sketches)
    out = {}
    for c, shares in wanted.items():
        if not counts[c]:
            out[c] = [None] * len(shares)
            continue
        out[c] = []
        for p in shares:
            x = p * (counts[c] - 1)
            low, high = found[c, math.floor(x)], found[c, math.ceil(x)]
            out[c].append(float(interpolate(low, high, x - math.floor(x))))
    return out


def medians(df: DataFrame, columns, rows: int | None = None, **limits) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, {c: [0.5] for c in columns}, rows, **limits).items()}


def quartiles(df: DataFrame, columns, rows: int | None = None, **limits) -> dict[str, list[float | None]]:
    return quantiles(df, {c: [0.25, 0.75] for c in columns}, rows, **limits)


def value_counts(df: DataFrame, columns) -> DataFrame:
    """(``column_name``, ``value``, ``rows``) of the non-missing values, value as text.

    Counts combine before the shuffle, so a hot value costs one row per task.
    """
    columns = list(columns)
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = texts.unpivot([], columns, "column_name", "value")
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("rows"))
    )


def modes(
    df: DataFrame, columns, rows: int | None = None, count_all_cells: int = COUNT_ALL_CELLS
) -> dict[str, object]:
    """Most frequent value per column, the smallest on a tie, None if all missing.

    All values are counted while rows x columns stay below a limit. Beyond it summaries of the frequent values, kept per
    task and merged, name candidates, and only these are counted, so that a column of unique values is never shuffled.
    Where the summary's error leaves the mode open, the column's values are counted after all: the result is the same.
    """
    columns = list(columns)
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}

    def kind(dtype) -> str:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return "double"
        return "bigint" if isinstance(dtype, T.IntegralType) else dtype.simpleString()

    kinds = {c: kind(types[c]) for c in columns}
    typed = clean_nan(df.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()]), columns)
    out: dict[str, object] = dict.fromkeys(columns)
    rows = typed.count() if rows is None else rows
    left = columns
    if rows * len(columns) > count_all_cells:
        settled = _frequent_modes(typed, columns)
        out.update(settled)
        left = [c for c in columns if c not in settled]
    for k in sorted({kinds[c] for c in left}):
        names = [c for c in left if kinds[c] == k]
        long = typed.select(*[F.col(f"`{c}`") for c in names]).unpivot([], names, "column_name", "value")
        counts = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n"))
        best = counts.groupBy("column_name").agg(
            F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("value")
        )
        out.update({r["column_name"]: r["value"] for r in best.collect()})
    return out


def _frequent_modes(typed: DataFrame, columns: list[str]) -> dict[str, object]:
    """The modes that summaries of frequent values settle, in two passes without a shuffle of values.

    A summary's counts are upper bounds. A value outside the candidates occurs at most as often as the least candidate's
    bound, or, if the summary left it out, in twice its error; a candidate seen more often than both is the mode.
    """
    tracked = []
    for i, c in enumerate(columns):
        name = c.replace("`", "``")
        tracked += [F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.expr(f"approx_top_k(`{name}`, {CANDIDATES}, {TRACKED})").alias(f"t{i}")]
    row = typed.agg(F.count("*").alias("rows"), *tracked).first()
    total, settled = row["rows"], {}
    listed = {c: [r for r in row[f"t{i}"] if r["item"] is not None] for i, c in enumerate(columns) if row[f"n{i}"]}
    settled.update({c: None for i, c in enumerate(columns) if not row[f"n{i}"]})
    asked = [(c, r["item"]) for c, some in listed.items() for r in some]
    if not asked:
        return settled
    exact = typed.agg(*[F.count_if(F.col(f"`{c}`") == F.lit(v)).alias(f"n{i}") for i, (c, v) in enumerate(asked)]).first()
    counted: dict[str, list] = {}
    for (c, v), n in zip(asked, exact):
        counted.setdefault(c, []).append((-n, v))
    for i, c in enumerate(columns):
        if c not in counted:
            continue
        whole = len(row[f"t{i}"]) < CANDIDATES
        others = max(TRACKED_ERROR * total, 0 if whole else min(r["count"] for r in row[f"t{i}"]))
        # ties go to the smaller value, so a mode must lie above what others may have
        minus, value = min(counted[c])
        if -minus > others:
            settled[c] = value
    return settled


def means(df: DataFrame, columns) -> dict[str, float | None]:
    columns = list(columns)
    if not columns:
        return {}
    values = clean_nan(df, columns)
    row = values.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))
