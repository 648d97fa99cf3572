"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits. Correlated bits are grouped into ``PARTS`` partitions. If two fingerprints differ in at most
``t`` bits and the partitions' thresholds add up to ``t - PARTS + 1`` (a threshold of -1 leaves a partition out), some
partition differs by no more than its threshold. Each fingerprint chooses its thresholds by dynamic programming on
estimated candidate counts, so partitions in which it has a frequent value are left out and rare ones probed wider.
Probes meet the index in a join and every candidate is verified.

Only distinct fingerprints take part. A bucket (partition and value) that holds many of them is not joined: its
members are linked exactly through shared one-bit variants, of which each has 65, since two fingerprints differ in at
most two bits if and only if they share one. So the work stays in proportion to the number of fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, map_texts, row_id, table, written
from .components import components
from .registry import query

BITS, PARTS, DISTANCE, SHINGLE = 64, 3, 2, 3
#: Buckets with more distinct fingerprints than this are linked through variants.
BUCKET = 48
#: Subpartitions of a partition in the estimate of candidate counts.
SUBPARTS = 2

CHUNK = 1 << 16


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles of a text with A-Z in lower case, repeats included; one of all words if there are fewer."""
    # ASCII white space and ASCII case only, as methods of bytes have them
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is set in more than half of the shingles' XXH64 (seed 42). No words: 0."""
    parts = shingles(text, size)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(parts), CHUNK):
        some = parts[start : start + CHUNK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in some), np.uint64, len(some))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(parts)).tolist())


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each row's text as a signed long; null counts as empty and gives 0."""

    def make():
        return lambda t: (signed(fingerprint(t, size)),)

    return map_texts(docs, make, "fp bigint", key, text)


def bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_products(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set; one 64 x 64 sum per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = bit_matrix(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            for start in range(0, len(bits), CHUNK):
                total += bits[start : start + CHUNK].T @ bits[start : start + CHUNK]
            n += len(bits)
        i = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))],
            names=["i", "n"],
        )

    sums = distinct.select("fp").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    found = {r["i"]: r["n"] for r in sums}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray) -> list[list[int]]:
    """Bits in ``PARTS`` groups of nearly equal size, each grown by the bit most correlated with it."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    free, parts = set(range(BITS)), []
    for k in range(PARTS):
        size = BITS // PARTS + (k < BITS % PARTS)
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: strength[b, group].sum())
            group.append(best)
            free.discard(best)
        parts.append(sorted(group))
    return parts


def part_values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    """The value of some of the bits of each row, as an integer."""
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def subpart_counts(distinct: DataFrame, parts: list[list[int]]) -> list[list[np.ndarray]]:
    """For each subpartition, how many fingerprints have each value: at most 2**11 counts each, over all rows."""
    subs = [part[i::SUBPARTS] for part in parts for i in range(SUBPARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(s), np.int64) for s in subs]
        for batch in batches:
            bits = bit_matrix(batch.column(0).to_numpy(zero_copy_only=False))
            for s, c in zip(subs, counts):
                c += np.bincount(part_values(bits, s), minlength=len(c))
        for k, c in enumerate(counts):
            v = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), k, np.int32)), pa.array(v.astype(np.int32)), pa.array(c[v])],
                names=["s", "v", "n"],
            )

    rows = distinct.select("fp").mapInArrow(run, "s int, v int, n bigint").groupBy("s", "v").agg(F.sum("n").alias("n"))
    out = [np.zeros(1 << len(s)) for s in subs]
    for r in rows.collect():
        out[r["s"]][r["v"]] = r["n"]
    return [out[i : i + SUBPARTS] for i in range(0, len(out), SUBPARTS)]


def within(counts: np.ndarray, most: int) -> np.ndarray:
    """(value, e): how many fingerprints have a value that differs from it in exactly e bits, e up to ``most``."""
    values = np.arange(len(counts))
    masks = np.array([bin(v).count("1") for v in values])
    return np.stack([sum((counts[values ^ m] for m in np.flatnonzero(masks == e)), np.zeros(len(counts))) for e in range(most + 1)], 1)


def estimated_candidates(bits: np.ndarray, parts, tables, total: float, most: int) -> np.ndarray:
    """(row, part, e + 1): expected candidates at threshold e from -1 up, subpartitions taken as independent."""
    out = np.zeros((len(bits), len(parts), most + 2))
    for k, part in enumerate(parts):
        exact = np.zeros((len(bits), most + 1))
        exact[:, 0] = max(total, 1)
        for i, near in enumerate(tables[k]):
            share = near[part_values(bits, part[i::SUBPARTS])] / max(total, 1)
            exact = np.stack(
                [sum(exact[:, a] * share[:, e - a] for a in range(e + 1)) for e in range(most + 1)], axis=1
            )
        out[:, k, 1:] = np.cumsum(exact, axis=1)
    return out


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """(row, part): thresholds from -1 up that add up to ``total`` at the least cost, by dynamic programming."""
    rows, parts, choices = costs.shape
    budget = total + parts  # thresholds counted from -1
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    taken = np.zeros((rows, parts, budget + 1), np.int64)
    for k in range(parts):
        new = np.full_like(best, np.inf)
        for have in range(budget + 1):
            for spend in range(min(have, choices - 1) + 1):
                cost = best[:, have - spend] + costs[:, k, spend]
                better = cost < new[:, have]
                new[better, have] = cost[better]
                taken[better, k, have] = spend
        best = new
    out, left = np.zeros((rows, parts), np.int64), np.full(rows, budget)
    for k in range(parts - 1, -1, -1):
        out[:, k] = taken[np.arange(rows), k, left]
        left -= out[:, k]
    return out - 1


def masks_within(width: int, threshold: int) -> np.ndarray:
    """All masks of up to ``threshold`` bits; none at -1."""
    found = [sum(1 << b for b in c) for e in range(threshold + 1) for c in itertools.combinations(range(width), e)]
    return np.array(found, np.int64)


def probes_and_index(distinct: DataFrame, distance: int) -> DataFrame:
    """(part, value, fp, probe): an index row per fingerprint and partition, and a row per probed value."""
    n, both = bit_products(distinct)
    parts = correlated_parts(n, both)
    tables = [[within(c, distance) for c in part] for part in subpart_counts(distinct, parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {(len(p), t): masks_within(len(p), t) for p in parts for t in range(-1, distance + 1)}
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start in range(0, len(fps), CHUNK // 4):
                fp = fps[start : start + CHUNK // 4]
                bits = bit_matrix(fp)
                costs = estimated_candidates(bits, parts, tables, n, distance)
                # a probe costs something even where it finds nothing
                costs += 0.05 * np.array([[0, *(len(masks[len(p), t]) for t in range(distance + 1))] for p in parts])
                thresholds = allocate(costs, distance - PARTS + 1)
                for k, part in enumerate(parts):
                    value = part_values(bits, part)
                    columns = [(value, fp, False)]
                    for t in range(distance + 1):
                        some = thresholds[:, k] == t
                        if some.any():
                            m = masks[len(part), t]
                            columns.append(((value[some, None] ^ m).ravel(), np.repeat(fp[some], len(m)), True))
                    for v, f, probe in columns:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(v), k, np.int32)),
                                pa.array(v.astype(np.int32)),
                                pa.array(f),
                                pa.array(np.full(len(v), probe)),
                            ],
                            names=["part", "value", "fp", "probe"],
                        )

    return distinct.select("fp").mapInArrow(run, "part int, value int, fp bigint, probe boolean")


def variants(fps: DataFrame) -> DataFrame:
    """(variant, fp): each fingerprint and its 64 one-bit changes."""
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(signed(1 << b)).cast("bigint") for b in range(BITS)])
    return fps.select("fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs at up to ``distance`` bits.

    Members of crowded buckets are linked to the smallest fingerprint that shares a variant with them, a true
    component but not every pair, so such a group does not grow with its square.
    """
    if distance != 2:
        raise ValueError("crowded buckets are linked through one-bit variants, which is exact at a distance of 2")
    rows = written(probes_and_index(distinct, distance), "simhash-probes")
    sizes = rows.groupBy("part", "value").agg(
        F.count(F.when(~F.col("probe"), 1)).alias("held"), F.count(F.when(F.col("probe"), 1)).alias("asked")
    )
    useful = sizes.where((F.col("held") > 0) & (F.col("asked") > 0))
    sized = rows.join(useful, ["part", "value"])
    crowded = F.greatest("held", "asked") > BUCKET
    calm = sized.where(~crowded)
    pairs = (
        calm.where("probe")
        .select("part", "value", F.col("fp").alias("a"))
        .join(calm.where(~F.col("probe")).select("part", "value", F.col("fp").alias("b")), ["part", "value"])
        .where("a <> b and bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    shared = variants(sized.where(crowded).select("fp").distinct())
    stars = shared.groupBy("variant").agg(F.min("fp").alias("a"))
    starred = shared.join(stars, "variant").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(starred).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id) per row: the smallest key reachable over links of up to 2 differing bits.

    Null and empty texts have fingerprint 0 and link to each other. Equal fingerprints share a row in the search, so
    copies cost nothing there. A null key takes part under the smallest other key of its component, null if there is
    none. Repeated rows come back as often as they stand.
    """
    found = grouped(written(fingerprints(docs, size, key, text), "simhash-fingerprints"), key)
    return found.select(key, "fp", "component_id")


def grouped(marked: DataFrame, key: str) -> DataFrame:
    """Fingerprinted rows with ``root``, a fingerprint that names their component, and its smallest key."""
    distinct = marked.groupBy("fp").agg(F.min(key).alias("least"))
    distinct = written(distinct, "simhash-distinct")
    reached = components(links(distinct), "a", "b")  # node, root
    named = distinct.join(reached, distinct["fp"] == reached["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = written(named, "simhash-roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = named.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(class_of, "fp")


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of the smallest key of each component; rows with a null key are kept.

    Rows that share a key but lie in different components are kept apart; of several rows of the smallest key in one
    component the one of the smallest hash of key and text stays, of several of those the one of the smallest hash of all
    columns.
    """
    row, named = free_name(docs, "row"), free_name(docs, "named")
    marked = docs.withColumn(row, row_id(key, text))
    pair = F.struct(F.col(f"`{key}`").alias("key"), F.col(row).alias("row"))
    prints = fingerprints(marked.withColumn(named, pair), SHINGLE, named, text).select(f"{named}.key", f"{named}.row", "fp")
    found = grouped(written(prints, "simhash-fingerprints"), "key")
    kept = found.where("key = component_id").groupBy("root").agg(F.min("row").alias(row)).select(row)
    # rows of one key and text may differ in other columns: the one of the least hash over all of them stays
    first = Window.partitionBy(row).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    keyed = marked.where(F.col(f"`{key}`").isNotNull()).join(kept, row, "left_semi")
    place = free_name(marked, "place")
    keyed = keyed.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return keyed.select(*docs.columns).unionByName(docs.where(F.col(f"`{key}`").isNull()))
