"""Scalar column expressions over flow fields."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

OCTET_SCALE = 256
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text or number as double; anything that is not a number becomes NULL."""
    c = _col(c)
    text = c.cast("string")
    return F.when(text.rlike(NUMBER) | text.rlike(INFINITE), F.trim(text).try_cast("double"))


def nan_to_null(c) -> Column:
    """NULL in place of NaN, so that aggregates skip it."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def _octets(c) -> tuple[Column, list[Column]]:
    """(number of dot-separated parts, the first four as int, NULL where no int)."""
    parts = F.split(_col(c), r"\.")
    return F.size(parts), [F.get(parts, i).try_cast("int") for i in range(4)]


def is_valid_ip(c) -> Column:
    """Four decimal parts in 0..255; NULL is NULL."""
    c = _col(c)
    count, octets = _octets(c)
    in_range = count == 4
    for octet in octets:
        in_range = in_range & F.coalesce(octet.between(0, 255), F.lit(False))
    return F.when(c.isNotNull(), c.rlike(r"^[0-9]+(\.[0-9]+){3}$") & in_range)


def ip_to_int(c) -> Column:
    """Dotted quad as one integer without a range check; anything else is 0."""
    count, octets = _octets(c)
    value = octets[0].cast("bigint")
    for octet in octets[1:]:
        value = value * OCTET_SCALE + octet
    return F.coalesce(F.when(count == 4, value), F.lit(0).cast("bigint"))


def protocol_code(c) -> Column:
    """Number of a known protocol name, 0 for others and NULL."""
    return F.coalesce(lookup(_col(c).cast("string"), S.PROTOCOL_CODES), F.lit(0))


def lookup(c, mapping: dict) -> Column:
    """Value of a small literal mapping, NULL where the key is absent."""
    pairs = [F.lit(x) for x in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def forward_share(forward, backward) -> Column:
    """``forward / (forward + backward)``, 0.5 where there is no traffic."""
    forward, backward = _col(forward), _col(backward)
    total = forward + backward
    return F.when(total > 0, forward.cast("double") / total).otherwise(F.lit(0.5))


def bucket(c, bounds) -> Column:
    """Name of the right-closed bucket; zero, negative and missing give NULL."""
    c = _col(c)
    (upper, name), *rest = bounds
    names = F.when(c <= upper, name)
    for upper, name in rest:
        names = names.when(c <= upper, name)
    return F.when(c > 0, names)


def duration_bucket(c) -> Column:
    return bucket(c, S.DURATION_BUCKETS)


def packet_size_bucket(c) -> Column:
    return bucket(c, S.PACKET_SIZE_BUCKETS)


def class_name(c) -> Column:
    """Class of an integer label 0..4, NULL where unmapped."""
    return lookup(_col(c).cast("int"), S.CLASS_BY_CODE)


def known_label(c, known=tuple(S.CLASS_BY_CODE.values()), fallback=S.NORMAL) -> Column:
    """The label if it is known, else ``fallback``."""
    c = _col(c)
    return F.when(c.isin(*known), c).otherwise(F.lit(fallback))


def prediction_label(code, classes) -> Column:
    """Label of a prediction code, with the special codes and out-of-range handled.

    One map lookup, so that the code's expression is not repeated when Catalyst
    moves a filter on the label below it.
    """
    names = {**S.CODE_LABELS, **dict(enumerate(classes))}
    return F.coalesce(lookup(_col(code).cast("int"), names), F.lit(S.CODE_LABELS[S.UNKNOWN]))


def label_from_filename(c, rules=S.FILENAME_KEYWORDS, unmatched="normal") -> Column:
    """Label by the first rule whose keyword, or all of whose keywords, a name holds.

    ``unmatched`` is the label of other names; ``'skip'`` leaves them NULL for the
    caller to drop.
    """
    name = F.lower(_col(c))

    def holds(keywords) -> Column:
        words = (keywords,) if isinstance(keywords, str) else keywords
        return reduce(lambda a, b: a & b, [name.contains(w.lower()) for w in words])

    (first, label), *rest = rules
    expr = F.when(holds(first), label)
    for keywords, label in rest:
        expr = expr.when(holds(keywords), label)
    return expr if unmatched == "skip" else expr.otherwise(unmatched)


def binary_label(c) -> Column:
    """1 for an attack, 0 for normal traffic."""
    return F.when(_col(c) == S.NORMAL, 0).otherwise(1)


def clip(c, low: float | None, high: float | None) -> Column:
    """``c`` within the bounds; missing stays missing and a bound of None is open."""
    c = _col(c)
    cases = []
    if low is not None:
        cases.append((c < low, low))
    if high is not None:
        # NaN sorts above infinity
        cases.append(((c > high) & (c <= float("inf")), high))
    if not cases:
        return c
    (first, bound), *rest = cases
    out = F.when(first, F.lit(bound))
    for beyond, bound in rest:
        out = out.when(beyond, F.lit(bound))
    return out.otherwise(c)


def error_type(truth, predicted) -> Column:
    return F.concat(_col(truth), F.lit("->"), _col(predicted))
