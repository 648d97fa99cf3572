"""Removal of repeated 200-byte strings with suffix arrays built by Lyndon grouping.

Every window of ``LENGTH`` bytes chooses an anchor inside itself: the place of the smallest hash among its first k-grams.
Equal windows choose the same anchor, so they also share the bytes from the anchor that all windows of that anchor have
in common. Anchors whose shared bytes occur once are done with; that is most of a corpus, and only counts of hashes were
shuffled. For the rest, the stretch of text that the anchor's windows span goes to the shard of its shared bytes.

A shard packs the stretches' bytes from the anchor on into symbols, sorts their suffixes by the linear grouping
construction, and takes the common prefixes of neighbours. Windows at one distance before the anchor are equal if their
stretches stand in one interval of long enough common prefixes and their bytes before the anchor agree. Equal stretches
are merged first, so copies cost nothing. Anchors that more than ``HOT`` places share do not go to a shard: their windows
are counted one by one with map-side sums, which no single key can crowd.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, hash_rows, merged_spans, table, written
from .lyndon import suffix_order
from .registry import query

LENGTH, GRAM, REACH = 200, 16, 128
#: Bytes from an anchor on that all of its windows share.
SHARED = LENGTH - REACH + 1
#: Bytes of text that are hashed at once; stretches in a shard, on average; places from which an anchor counts as hot.
SLICE, SHARD, HOT = 1 << 20, 4000, 50_000
#: Bytes in a symbol of a shard's text.
SYMBOL = 16

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@lru_cache(maxsize=2)
def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    size = SLICE + 4 * LENGTH
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Hashes:
    """64-bit hashes of any substring of a slice."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return hash_rows((self.sums[starts + length] - self.sums[starts]) * self.down[starts])


def slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Parts of texts (text, from, to) whose windows are disjoint and complete, grouped to at most ``SLICE`` bytes."""
    group, held = [], 0
    for t, text in enumerate(texts):
        at = 0
        while len(text) - at >= LENGTH:
            end = min(len(text), at + SLICE // 2)
            if held + end - at > SLICE and group:
                yield group
                group, held = [], 0
            group.append((t, at, end))
            held += end - at
            if end == len(text):
                break
            at = end - LENGTH + 1
    if group:
        yield group


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, last window, anchor, hash of the shared bytes) of all anchors, windows as byte offsets."""
    for group in slices(texts):
        data = np.frombuffer(b"".join(texts[t][a:b] for t, a, b in group), np.uint8)
        sizes = np.array([b - a for _, a, b in group])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        hashes = Hashes(data)
        n = len(data) - GRAM + 1
        places = np.arange(n, dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        key = (hashes.of(np.arange(n), GRAM) & ~low) | places
        width = 1
        while width < REACH:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        chosen = (key & low).astype(np.int64)
        window = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(begins, ends)])
        anchor = chosen[window]
        owner = np.repeat(np.arange(len(group)), sizes - LENGTH + 1)
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        who = owner[first]
        text = np.array([t for t, _, _ in group])[who]
        shift = np.array([a for _, a, _ in group])[who] - begins[who]
        yield (
            text,
            window[first] + shift,
            window[last] + shift,
            anchor[first] + shift,
            hashes.of(anchor[first], SHARED).view(np.int64),
        )


ROW = "rid bigint, first bigint, last bigint, anchor bigint, h bigint"


def anchor_table(docs: DataFrame) -> DataFrame:
    """(rid, first, last, anchor, h) of docs (rid, text)."""
    schema = arrow_schema(docs.sparkSession, ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            texts = [t.encode("utf-8") for t in batch.column(1).to_pylist()]
            for text, first, last, anchor, h in anchors(texts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (rid[text], first, last, anchor, h)], schema=schema
                )

    return docs.select("rid", "text").mapInArrow(run, ROW)


class Stretch:
    """Distinct stretches of a shard: bytes before the anchor, bytes from it on, and how often each occurs."""

    def __init__(self, before: list[bytes], after: list[bytes], times: np.ndarray):
        n = len(before)
        self.times = times
        self.most = np.array([len(b) for b in before])
        self.least = np.array([LENGTH - len(a) for a in after])
        self.left = np.zeros((n, REACH), np.uint8)
        for i, b in enumerate(before):
            self.left[i, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
        self.rank, self.common = sorted_after(after)

    def repeated(self) -> np.ndarray:
        """(distance, stretch): whether the window that starts so far before the anchor occurs elsewhere."""
        n = len(self.times)
        out = np.zeros((REACH, n), bool)
        # intervals of the widest distance: only stretches of one of them can ever agree
        widest = np.cumsum(self.common < SHARED)[self.rank]
        alive = np.arange(n)
        kind = np.zeros(n, np.int64)
        for d in range(REACH):
            if d:
                mixed = kind * 256 + self.left[alive, d - 1]
                kind = np.unique(mixed, return_inverse=True)[1]
            fits = (self.least[alive] <= d) & (d <= self.most[alive])
            if fits.any():
                some = alive[fits]
                interval = np.cumsum(self.common < LENGTH - d)[self.rank[some]]
                key = kind[fits] * (n + 1) + interval
                _, which = np.unique(key, return_inverse=True)
                out[d, some] = np.bincount(which, self.times[some])[which] >= 2
            key = kind * (n + 1) + widest[alive]
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            keep = ((count[which] > 1) | (self.times[alive] > 1)) & (self.most[alive] > d)
            alive, kind = alive[keep], kind[keep]
            if not len(alive):
                break
        return out


def sorted_after(after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string, and for each rank the bytes it shares with the rank before it."""
    distinct = list(dict.fromkeys(after))
    place = {a: i for i, a in enumerate(distinct)}
    width = -(-LENGTH // SYMBOL)
    raw = np.zeros((len(distinct), width * SYMBOL), np.uint8)
    sizes = np.array([len(a) for a in distinct])
    for i, a in enumerate(distinct):
        raw[i, : len(a)] = np.frombuffer(a, np.uint8)
    big = raw.reshape(-1, SYMBOL).view(">u8")
    order = np.lexsort((big[:, 1], big[:, 0]))
    new = np.ones(len(order), np.int64)
    new[1:] = (big[order[1:]] != big[order[:-1]]).any(axis=1)
    symbols = np.empty(len(order), np.int64)
    symbols[order] = np.cumsum(new)
    # a zero ends each string
    text = np.concatenate([symbols.reshape(-1, width), np.zeros((len(distinct), 1), np.int64)], axis=1).ravel()
    suffixes = suffix_order(text)
    heads = suffixes[suffixes % (width + 1) == 0] // (width + 1)
    shared = np.full(len(distinct), -1)
    above, below = raw[heads[:-1]], raw[heads[1:]]
    unequal = above != below
    common = np.where(unequal.any(axis=1), unequal.argmax(axis=1), LENGTH)
    shared[1:] = np.minimum(common, np.minimum(sizes[heads[:-1]], sizes[heads[1:]]))
    rank = np.empty(len(distinct), np.int64)
    rank[heads] = np.arange(len(distinct))
    return rank[np.array([place[a] for a in after], np.int64)], shared


def shard_spans(rows: pd.DataFrame) -> pd.DataFrame:
    """(rid, start, end): repeated windows of a shard, joined where they follow each other."""
    if not len(rows):
        return pd.DataFrame({"rid": [], "start": [], "end": []}, dtype="int64")
    # stretches of different shared bytes never agree, so a key is part of what makes a stretch
    index: dict[tuple[bytes, int], int] = {}
    which = np.array([index.setdefault((s, k), len(index)) for s, k in zip(rows["stretch"], rows["before"])])
    before = [s[:k] for s, k in index]
    after = [s[k:] for s, k in index]
    stretch = Stretch(before, after, np.bincount(which, minlength=len(index)))
    hit = stretch.repeated()
    edge = np.diff(np.vstack([np.zeros((1, hit.shape[1]), np.int8), hit.astype(np.int8), np.zeros((1, hit.shape[1]), np.int8)]), axis=0)
    at, opens = np.nonzero(edge.T == 1)
    _, closes = np.nonzero(edge.T == -1)
    begin = np.searchsorted(at, which, side="left")
    times = np.searchsorted(at, which, side="right") - begin
    row = np.repeat(np.arange(len(rows)), times)
    run = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
    anchor = rows["first"].to_numpy()[row] + rows["before"].to_numpy()[row]
    return pd.DataFrame(
        {"rid": rows["rid"].to_numpy()[row], "start": anchor - closes[run] + 1, "end": anchor - opens[run] + LENGTH}
    )


STRETCH = "rid bigint, first bigint, before int, h bigint, stretch binary"
WINDOW = "rid bigint, start bigint, w1 bigint, w2 bigint"


def stretches(candidates: DataFrame) -> DataFrame:
    """Text of the calm anchors of (rid, text, found): bytes spanned by their windows."""
    schema = arrow_schema(candidates.sparkSession, STRETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, found in zip(*(batch.column(i) for i in range(3))):
                data, parts = text.as_py().encode("utf-8"), [f for f in found.as_py() if not f["hot"]]
                if parts:
                    columns = [
                        [rid.as_py()] * len(parts),
                        [f["first"] for f in parts],
                        [f["anchor"] - f["first"] for f in parts],
                        [f["h"] for f in parts],
                        [data[f["first"] : f["last"] + LENGTH] for f in parts],
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], schema=schema
                    )

    return candidates.select("rid", "text", "found").mapInArrow(run, STRETCH)


def hot_windows(candidates: DataFrame) -> DataFrame:
    """(rid, start, w1, w2): all windows of the hot anchors, as 128-bit hashes."""
    schema = arrow_schema(candidates.sparkSession, WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, found in zip(*(batch.column(i) for i in range(3))):
                data = np.frombuffer(text.as_py().encode("utf-8"), np.uint8)
                for f in found.as_py():
                    if f["hot"]:
                        part = data[f["first"] : f["last"] + LENGTH]
                        at = np.arange(f["last"] - f["first"] + 1)
                        w = [Hashes(part, b).of(at, LENGTH).view(np.int64) for b in BASES]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), rid.as_py())), pa.array(at + f["first"]), *map(pa.array, w)],
                            schema=schema,
                        )

    return candidates.where(F.exists("found", lambda f: f["hot"])).select("rid", "text", "found").mapInArrow(run, WINDOW)


def repeated_spans(candidates: DataFrame, shards: int) -> DataFrame:
    """(rid, start, end) of repeated windows."""
    dealt = stretches(candidates).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    calm = dealt.groupBy("shard").applyInPandas(shard_spans, "rid bigint, start bigint, end bigint")
    windows = hot_windows(candidates)
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    hot = windows.join(again, ["w1", "w2"]).select("rid", "start", (F.col("start") + LENGTH).alias("end"))
    return calm.unionByName(hot)


DIGEST = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def digest(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    starts, ends = merged_spans(starts, ends)
    hasher, at = hashlib.sha256(), 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        hasher.update(data[at:a])
        at = b
    hasher.update(data[at:])
    return len(data), int((ends - starts).sum()) if len(starts) else 0, len(starts), hasher.hexdigest()


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for each row: every byte of a repeated ``LENGTH``-byte string goes.

    Strings are compared over all rows, within a text too, and judged on the input. Texts are their UTF-8 bytes; null is
    empty, shorter texts keep everything. Repeated rows repeat each other's passages. Keys may be null or equal.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), body.alias("text")).withColumn("rid", F.xxhash64("key", "text"))
    found = anchor_table(rows.where(F.octet_length("text") >= LENGTH))
    found = written(found, "anchors")
    counts = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # at most a thousand hashes hold more than a thousandth of the anchors each; they need no shuffle by hash
    frequent = F.col("n") * 1000 > total
    crowd = F.broadcast(counts.where(frequent).select("h", F.col("n").alias("crowd_n")))
    marked = found.join(crowd, "h", "left")
    rest = marked.where("crowd_n is null").drop("crowd_n").join(counts.where(~frequent), "h")
    again = marked.where("crowd_n is not null").withColumnRenamed("crowd_n", "n").unionByName(rest)
    again = again.withColumn("hot", F.col("n") > HOT)
    by_doc = again.groupBy("rid").agg(
        F.collect_set(F.struct("first", "last", "anchor", "h", "hot")).alias("found")
    )
    kind = docs.schema[key].dataType.simpleString()
    full = f"rid bigint, key {kind}, text string, {DIGEST}"
    schema = arrow_schema(spark, f"{full}, found array<struct<first:bigint,last:bigint,anchor:bigint,h:bigint,hot:boolean>>")
    none = np.zeros(0, np.int64)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a candidate get their digest here and are passed on without the text."""
        for batch in batches:
            bare = batch.column(3).is_null().to_pylist()
            texts = batch.column(2).to_pylist()
            digests = [digest(t.encode("utf-8"), none, none) if b else (None,) * 4 for t, b in zip(texts, bare)]
            columns = [pa.array([None if b else t for t, b in zip(texts, bare)], pa.string())]
            columns += [pa.array(list(c), schema.field(3 + i).type) for i, c in enumerate(zip(*digests))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(schema.field(1).type), *columns, batch.column(3).cast(schema.field(7).type)],
                schema=schema,
            )

    joined = rows.select("rid", "key", "text").join(by_doc, "rid", "left").select("rid", "key", "text", "found")
    stage = joined.mapInArrow(
        settle, f"{full}, found array<struct<first:bigint,last:bigint,anchor:bigint,h:bigint,hot:boolean>>"
    )
    stage = written(stage, "passages")
    candidates = stage.where("text is not null")
    total = candidates.agg(F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("n")).first()["n"]
    spans = repeated_spans(candidates, max(1, -(-total // SHARD)))
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = arrow_schema(spark, f"key {kind}, {DIGEST}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s = s or []
                starts = np.array([x["start"] for x in s], np.int64)
                made.append(digest(t.encode("utf-8"), starts, np.array([x["end"] for x in s], np.int64)))
            if made:
                arrays = [pa.array(list(c), out.field(1 + i).type) for i, c in enumerate(zip(*made))]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), *arrays], schema=out)

    cut = (
        candidates.select("rid", "key", "text")
        .join(spans, "rid", "left")
        .select("key", "text", "spans")
        .mapInArrow(finish, f"key {kind}, {DIGEST}")
    )
    names = [part.split()[0] for part in DIGEST.split(", ")]
    return stage.where("text is null").select("key", *names).unionByName(cut).withColumnRenamed("key", key)


@query()
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
