"""Approximate nearest neighbours with forests of hash prefixes.

Vectors are dealt into shards of bounded size by a hash of their id, so copies and hot clusters spread evenly. Each
shard has several trees; a tree is a sorted array of long hash strings, one bit per random hyperplane. A query descends
every tree to its longest matching prefix and then all trees ascend together, one prefix length at a time, until enough
candidates share a prefix with it. Candidates are ranked by exact distance, and the shards' answers are merged.

Queries are a stated set and meet the shards in blocks: a task holds one shard and one block of queries, whatever the
size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .registry import query

#: Vectors in a shard and queries in a block, on average.
SHARD_ROWS, BLOCK_QUERIES = 8192, 16384
TREES, BITS = 16, 48
#: Prefix matches that a query needs in all trees of a shard together before they stop ascending, per vector of the
#: shard, and at least so many. A row found in several trees counts as often. Measured recall at 10: see the README.
MATCHES, LEAST = 1.3, 2048
#: Queries that descend and ascend together.
CHUNK = 256


def planes(dimensions: int, seed: int = 20) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, TREES * BITS))


def hash_strings(vectors: np.ndarray, centre: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """(tree, row): hash strings as integers, the first bit the highest."""
    out = np.zeros((TREES, len(vectors)), np.uint64)
    for start in range(0, len(vectors), 4096):
        bits = ((vectors[start : start + 4096] - centre) @ normals > 0).reshape(-1, TREES, BITS)
        for b in range(BITS):
            out[:, start : start + 4096] |= bits[:, :, b].T.astype(np.uint64) << np.uint64(BITS - 1 - b)
    return out


class PrefixForest:
    """Sorted hash strings of one shard, and synchronous ascent for queries."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.centre = vectors.mean(axis=0)
        self.normals = planes(vectors.shape[1])
        strings = hash_strings(vectors, self.centre, self.normals)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def ranges(self, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(tree, query): the places whose strings share a prefix of ``length`` bits with the query's."""
        rest = np.uint64(BITS - length)
        low = strings >> rest << rest
        high = low + (np.uint64(1) << rest)
        return (
            np.stack([np.searchsorted(s, x) for s, x in zip(self.strings, low)]),
            np.stack([np.searchsorted(s, x) for s, x in zip(self.strings, high)]),
        )

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query, the rows that share a prefix with it once the trees have ascended far enough."""
        strings = hash_strings(queries, self.centre, self.normals)
        low, high = self.ranges(strings, 0)
        longest = np.zeros(len(queries), np.int64)
        open_queries = np.arange(len(queries))
        for length in range(BITS, -1, -1):
            a, b = self.ranges(strings[:, open_queries], length)
            # a row may be found in several trees; the bound is on rows found in all of them together
            enough = (b - a).sum(axis=0) >= wanted
            done = open_queries[enough]
            low[:, done], high[:, done], longest[done] = a[:, enough], b[:, enough], length
            open_queries = open_queries[~enough]
            if not len(open_queries):
                break
        seen = np.zeros(len(self.vectors), bool)
        for q in range(len(queries)):
            seen[:] = False
            for t in range(TREES):
                seen[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(seen)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors of finite components that are not all zero, as doubles; null keys take no part."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(finite & F.exists("v", lambda x: x != 0))
    )


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows found for each query but itself, by distance, then id.

    Null, zero and non-finite vectors take no part, nor do rows without a key. A query meets only vectors of its own
    length. A key that stands in several rows is one candidate, at its smallest distance. No rows: no answers.
    """
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    place = F.xxhash64("vec_id", "v")
    left = rows.select(
        F.pmod(place, F.lit(shards)).cast("bigint").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v"
    )
    right = asked.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
        F.pmod(place, F.lit(blocks)).cast("int").alias("block"),
        "vec_id",
        "v",
    )

    def search(_, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in sorted(set(wanted["v"].map(len)) & set(held["v"].map(len))):
            some = held[held["v"].map(len) == size].sort_values("vec_id")
            ask = wanted[wanted["v"].map(len) == size]
            x, ids = np.stack(some["v"].to_numpy()), some["vec_id"].to_numpy()
            forest = PrefixForest(x)
            enough = max(LEAST, int(MATCHES * len(x)))
            for start in range(0, len(ask), CHUNK):
                part = ask.iloc[start : start + CHUNK]
                q = np.stack(part["v"].to_numpy())
                for query_id, vec, found in zip(part["vec_id"], q, forest.candidates(q, enough)):
                    found = found[ids[found] != query_id]
                    distance = np.sqrt(((x[found] - vec) ** 2).sum(axis=1))
                    # each id once, then the best k of them
                    best = np.lexsort((ids[found], distance))
                    _, first = np.unique(ids[found][best], return_index=True)
                    best = best[np.sort(first)][:k]
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found][best], "score": distance[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    )
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query()
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)
