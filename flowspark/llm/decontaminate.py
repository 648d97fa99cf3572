"""Benchmark decontamination: an FM-index per training shard, searched for the test items' word windows.

Words of a shard's documents become symbols; a word that no test item has cannot lie in an occurrence, so it only
separates. Runs long enough to hold a window are indexed, all windows are searched backwards at once through
wavelet-tree ranks, occurrences are located by sampled suffix positions, and their spans are merged per document.

The test items are a stated query set. They are taken in blocks of bounded size, each broadcast; every block gives each row
its spans, which are united within the row. Documents never move, and no row is known by its key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, free_name, merged_spans, table, written
from .registry import query
from .wavelet import FmIndex

WINDOW = 13
#: Words of test items in one block, and words of test items in one row of it.
BLOCK_WORDS, PIECE_WORDS = 1_000_000, 4096
#: Symbols in one shard's index.
SHARD_SYMBOLS = 4_000_000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII digits and letters (A-Z in lower case) and of all characters beyond ASCII."""
    return WORD.findall(text.encode("utf-8").lower())


def item_pieces(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, words, n): items cut into rows of bounded length that overlap by a window less one word."""
    schema = arrow_schema(items.sparkSession, "item string, words array<binary>, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                step = PIECE_WORDS - window + 1
                for start in range(0, max(1, len(words) - window + 1), step):
                    piece = words[start : start + PIECE_WORDS]
                    if piece:
                        rows.append((name, piece, len(piece)))
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), schema.field(i).type) for i, c in enumerate(columns)], schema=schema
            )

    slim = items.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    return slim.mapInArrow(run, "item string, words array<binary>, n bigint")


class Phrases:
    """The windows of a block of items, as symbols: by length, with the items that each stands in."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, words in pieces:
            ids = [vocabulary.setdefault(bytes(w), len(vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                found.setdefault(tuple(ids[i : i + size]), set()).add(name)
        self.vocabulary = vocabulary
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for size in sorted({len(p) for p in found}):
            some = [p for p in found if len(p) == size]
            self.by_length.append((np.array(some, np.int64), [sorted(found[p]) for p in some]))
        self.shortest = min((len(p) for p in found), default=1)


def shard_hits(texts: list[str], phrases: Phrases) -> list[tuple[int, list[int], list[int], list[str]]]:
    """For each text of a shard: words, starts and ends of merged hit spans, items whose windows occur."""
    counts, runs, owner, place = [], [], [], []
    lookup = phrases.vocabulary.get
    for d, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        ids = np.fromiter((lookup(w, 0) for w in words), np.int64, len(words))
        inside = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        for a, b in zip(inside[::2].tolist(), inside[1::2].tolist()):
            if b - a >= phrases.shortest:
                runs.append(np.append(ids[a:b], 0))
                owner.append(d)
                place.append(a)
    spans: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if runs:
        symbols = np.concatenate([np.zeros(1, np.int64), *runs])
        begins = 1 + np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]])
        owner_of, place_of = np.array(owner), np.array(place)
        index = FmIndex(symbols, len(phrases.vocabulary))
        for wanted, names in phrases.by_length:
            low, high = index.search(wanted)
            times = high - low
            which = np.repeat(np.arange(len(wanted)), times)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            at = index.locate(rows)
            run = np.searchsorted(begins, at, side="right") - 1
            doc, start = owner_of[run], place_of[run] + at - begins[run]
            order = np.argsort(doc, kind="stable")
            edges = np.flatnonzero(np.diff(doc[order])) + 1
            for part in np.split(order, edges) if len(order) else ():
                d = int(doc[part[0]])
                spans[d].append((start[part], start[part] + wanted.shape[1]))
                for w in np.unique(which[part]).tolist():
                    items[d].update(names[w])
    out = []
    for d, count in enumerate(counts):
        if spans[d]:
            starts, ends = merged_spans(*(np.concatenate(x) for x in zip(*spans[d])))
            out.append((count, starts.tolist(), ends.tolist(), sorted(items[d])))
        else:
            out.append((count, [], [], []))
    return out


SPANS = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def block_hits(spark: SparkSession, phrases: Phrases, text: Column) -> Column:
    """A struct (n_words, starts, ends, items) of a text for one block of items."""
    shared = spark.sparkContext.broadcast(phrases)
    fields = list(arrow_schema(spark, SPANS))

    @F.arrow_udf(f"struct<{SPANS.replace(' bigint', ':bigint').replace(' array', ':array')}>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, found, start, size = batch.to_pylist(), [], 0, 0
            for i, t in enumerate(texts, 1):
                size += len(t) // 2 + 1  # a word and its separator have two bytes at least
                if size >= SHARD_SYMBOLS or i == len(texts):
                    found += shard_hits(texts[start:i], shared.value)
                    start, size = i, 0
            columns = list(zip(*found)) if found else [()] * len(fields)
            yield pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], fields=fields)

    return hits(text)


def hit_column(
    docs: DataFrame, items: DataFrame, text: str, item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> Column:
    """A struct (n_words, starts, ends, items) of each row's text: merged word spans that lie in an item's window."""
    spark = docs.sparkSession
    pieces = written(item_pieces(items, item, item_text, window), "benchmark")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_WORDS))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = []
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).select("item", "words").collect()
        found.append(block_hits(spark, Phrases([(r["item"], r["words"]) for r in rows], window), body))
    if blocks == 1:
        return found[0]
    spans = _united(F.array_sort(F.flatten(F.array(*[F.arrays_zip(h["starts"], h["ends"]) for h in found]))))
    names = F.array_sort(F.array_distinct(F.flatten(F.array(*[h["items"] for h in found]))))
    return F.struct(
        found[0]["n_words"].alias("n_words"), spans["starts"].alias("starts"), spans["ends"].alias("ends"), names.alias("items")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(key, n_words, starts, ends, items) per row of ``docs``: merged word spans that lie in an item's window.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window. Null
    texts have no words, a null item id counts as an empty name, repeated items count once, no items give no spans.
    Each row is judged on its own, whatever its key.
    """
    name = free_name(docs, "hit")
    found = docs.withColumn(name, hit_column(docs, items, text, item, item_text, window))
    return found.select(F.col(f"`{key}`").alias(key), *[F.col(f"`{name}`.{c}") for c in ("n_words", "starts", "ends", "items")])


def _united(spans: Column) -> Column:
    """Sorted spans (starts, ends) with touching and overlapping ones joined, as a struct of two arrays."""
    empty = F.array().cast("array<struct<starts:bigint,ends:bigint>>")

    def step(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], span["ends"]).alias("ends"))
        touches = (F.size(done) > 0) & (span["starts"] <= F.try_element_at(done, F.lit(-1))["ends"])
        kept = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(kept, F.array(joined))).otherwise(F.concat(done, F.array(span)))

    done = F.aggregate(spans, empty, step)
    return F.struct(done["starts"].alias("starts"), done["ends"].alias("ends"))


def words_hit(starts: Column, ends: Column) -> Column:
    return F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0).cast("bigint"), lambda total, n: total + n)


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """Some word is hit, and at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def judged(found: DataFrame) -> DataFrame:
    """Spans with their number of words and the verdict."""
    found = found.withColumn("n_hit", words_hit(F.col("starts"), F.col("ends")))
    return found.withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


@query()
def op5_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated; each row is judged by its own text, in a narrow pass."""
    name = free_name(docs, "hit")
    hit = F.col(f"`{name}`")
    found = docs.withColumn(name, hit_column(docs, items, text))
    return found.where(~is_contaminated(hit["n_words"], words_hit(hit["starts"], hit["ends"]))).select(*docs.columns)
