"""Runs of periodic words, from the Lyndon arrays that the grouping phase of a suffix sorter yields.

Phase one of sorting suffixes by grouping refines groups from the highest to the lowest; a group's suffixes share their
longest Lyndon prefix, and its length is known whenever a group is split: the pointed-to suffixes append the finished
group's Lyndon word as often as they are pointed to. So the Lyndon array is read off the groups, and no suffix is ever
placed. This is done for an order of the words and for the reverse one. Every run contains the longest Lyndon word of
one of its places under one of the two orders; that root is extended by longest common extensions to both sides, found
by binary search over prefix hashes, and every run that is long enough is verified word by word.

A word that occurs fewer times than the least exponent is in no run, so texts are first split at such words, again and
again within the stretches, until nothing more goes. Words are compared as words of one text; all texts of a batch are
worked on at once, with borders that equal nothing. The pass is narrow: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, hash_rows, table
from .registry import query

#: A run has at least so many words, and at least so many times its period.
LEAST, EXPONENT = 6, 4
#: Words that are worked on at once; a longer text is worked on alone.
BATCH_WORDS = 1 << 18
FACTOR = 0x9E3779B97F4A7C15 | 1


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, by grouping alone.

    A text's end is less than every symbol.
    """
    n = len(symbols) + 1
    text = np.append(symbols.astype(np.int64) - (symbols.min() if n > 1 else 0) + 1, 0)
    array = np.argsort(text, kind="stable")
    first = np.ones(n, bool)
    first[1:] = text[array[1:]] != text[array[:-1]]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    group_of, place = np.empty(n, np.int64), np.empty(n, np.int64)
    group_of[array] = np.repeat(starts, sizes)
    place[array] = np.arange(n)
    array, place, group = array.tolist(), place.tolist(), group_of.tolist()
    size, length = dict(zip(starts.tolist(), sizes.tolist())), dict.fromkeys(starts.tolist(), 1)
    previous = [-1] * n
    end = n
    while end > 0:
        start = group[array[end - 1]]
        long = length[start]
        pointed: dict[int, int] = {}
        for s in sorted(array[start:end]) if end - start > 1 else (array[start],):
            p = s - 1
            # the previous suffix of a lower group
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            moves.setdefault(times, {}).setdefault(group[p], []).append(p)
        for times in sorted(moves, reverse=True):
            for old, some in moves[times].items():
                left = size[old] - len(some)
                if not left:
                    length[old] += times * long  # all that is left of the group grows alike
                    continue
                new = old + left
                size[old], size[new] = left, len(some)
                length[new] = length[old] + times * long
                # the members move to the group's end and change places with whoever stood there
                inside = {p for p in some if place[p] >= new}
                at = new
                for p in some:
                    group[p] = new
                    if p not in inside:
                        while array[at] in inside:
                            at += 1
                        other, hole = array[at], place[p]
                        array[hole], place[other] = other, hole
                        array[at], place[p] = p, at
                        at += 1
        end = start
    return np.fromiter((length[g] for g in group), np.int64, n)[:-1]


class Extensions:
    """Longest common extensions of pairs of places, by binary search over hashes of substrings."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        steps = np.full(n + 1, FACTOR, np.uint64)
        back = np.full(n + 1, pow(FACTOR, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        self.back = np.multiply.accumulate(back)
        mixed = hash_rows(symbols.astype(np.uint64) + np.uint64(1))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * np.multiply.accumulate(steps)[:n], out=self.sums[1:])
        self.n = n

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        left = (self.sums[a + length] - self.sums[a]) * self.back[a]
        return left == (self.sums[b + length] - self.sums[b]) * self.back[b]

    def _longest(self, most: np.ndarray, fits: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = fits(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols from ``a`` on that equal those from ``b`` on; ``a`` lies before ``b``."""
        return self._longest(self.n - b, lambda m: self.equal(a, b, m))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols before ``a`` that equal those before ``b``."""
        return self._longest(a.copy(), lambda m: self.equal(a - m, b - m, m))


def runs(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) rows, by start, then period, of all runs of a text of integers.

    A run is a maximal stretch of smallest period ``q`` and of at least ``max(least, exponent * q)`` symbols;
    ``exponent`` is 2 or more.
    """
    n = len(symbols)
    if n < max(least, exponent):
        return np.zeros((0, 3), np.int64)
    symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    extend, found = Extensions(symbols), []
    for order in (symbols, symbols.max() - symbols):
        period = lyndon_array(order)
        start = np.flatnonzero(np.arange(n) + period < n)
        period = period[start]
        right = extend.right(start, start + period)
        left = extend.left(start, start + period)
        length = left + right + period
        long = length >= np.maximum(least, exponent * period)
        found.append(np.stack([start - left, length, period], axis=1)[long])
    return checked(symbols, np.unique(np.concatenate(found), axis=0), least, exponent)


def checked(symbols: np.ndarray, found: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """``found`` with every run compared symbol by symbol; where hashes were wrong, the extents are found anew."""
    out = []
    for start, length, period in found.tolist():
        if not np.array_equal(symbols[start : start + length - period], symbols[start + period : start + length]):
            same = symbols[:-period] == symbols[period:]
            # the root is right wherever it lies: all stretches of this period within what was claimed
            edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            for a, b in edges.reshape(-1, 2).tolist():
                if b + period - a >= max(least, exponent * period) and a < start + length and b + period > start:
                    if smallest_period(symbols[a : b + period]) == period:
                        out.append((a, b + period - a, period))
            continue
        out.append((start, length, period))
    return np.array(sorted({(s, q, k) for s, k, q in out}), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def smallest_period(x: np.ndarray) -> int:
    return next(q for q in range(1, len(x) + 1) if np.array_equal(x[:-q], x[q:]) or q == len(x))


def stretches(text: np.ndarray, word: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch) of the words that may lie in a run: stretches without a rare word, until none is left."""
    place, stretch = np.arange(len(word)), text.astype(np.int64)
    while len(place):
        key = stretch * (int(word.max()) + 1) + word[place]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[which] >= exponent
        gap = np.ones(len(place), bool)
        gap[1:] = (stretch[1:] != stretch[:-1]) | (place[1:] != place[:-1] + 1)
        # a new stretch begins after each rare word, gap or border of texts
        begins = gap | np.append(True, ~often[:-1])
        name = np.cumsum(begins)
        sizes = np.bincount(name[often], minlength=name[-1] + 1)
        keep = often & (sizes[name] >= least)
        if keep.all():
            break
        place, stretch = place[keep], name[keep]
    return place, stretch


def batch_runs(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """Runs of each of several texts of integers; equal numbers of different texts need not be equal words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    word = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    place, stretch = stretches(np.repeat(np.arange(len(texts)), sizes), word, least, exponent)
    if not len(place):
        return [np.zeros((0, 3), np.int64)] * len(texts)
    border = np.flatnonzero(np.append(False, stretch[1:] != stretch[:-1]))
    # borders are numbers that occur once, so no run holds one
    high = int(word.max()) + 1
    joined = np.insert(word[place], border, high + np.arange(len(border)))
    origin = np.insert(place, border, -1)
    found = runs(joined, least, exponent)
    found[:, 0] = origin[found[:, 0]]
    owner = np.searchsorted(ends, found[:, 0], side="right")
    found[:, 0] -= begins[owner]
    order = np.lexsort((found[:, 2], found[:, 0], owner))
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [found[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: words after a run's first period go."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def numbered(words: list[bytes]) -> np.ndarray:
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))


DIGEST = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
    "collapsed_sha256 string, collapsed string"
)


def digest(words: list[bytes], found: np.ndarray, text: bool) -> tuple:
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found.tolist())
    best = (None,) * 4
    if len(found):
        start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        best = (start, length, period, 1000 * length // period)
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
    left = b" ".join(words)
    shas = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
    return (len(found), *best, *shas, left.decode("utf-8", "surrogatepass") if text else None)


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
    collapsed: bool = True,
    least: int = LEAST,
    exponent: int = EXPONENT,
) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed) for each row.

    Words are separated by ASCII white space; null and empty texts have none, and then no runs. The four numbers are
    those of the longest run (ties: first start, then period), null without one; ``collapsed`` is the text with each run cut to its
    first period, words joined by one space. Rows are judged each on its own, whatever their keys. ``change`` may
    replace the words of a row by others, given its key.
    """
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType.simpleString()
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    full = f"key {kind}, {DIGEST}"
    schema = arrow_schema(docs.sparkSession, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: list, texts: list[list[bytes]]):
            found = batch_runs([numbered(t) for t in texts], least, exponent)
            made = [digest(t, f, collapsed) for t, f in zip(texts, found)]
            arrays = [pa.array(keys, schema.field(0).type)]
            arrays += [pa.array(list(c), schema.field(1 + i).type) for i, c in enumerate(zip(*made))]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            keys, texts, held = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = t.as_py().encode("utf-8", "surrogatepass").split()
                if change:
                    words = change(k, words)
                if keys and held + len(words) > BATCH_WORDS:
                    yield flush(keys, texts)
                    keys, texts, held = [], [], 0
                keys.append(k)
                texts.append(words)
                held += len(words)
            if keys:
                yield flush(keys, texts)

    out = slim.mapInArrow(run, full).withColumnRenamed("key", key)
    return out if collapsed else out.drop("collapsed")


def made_periodic(key: object, words: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats its beginning, for a tenth of the keys; a null key's stay as they are."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query()
def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), change=made_periodic, collapsed=False)
