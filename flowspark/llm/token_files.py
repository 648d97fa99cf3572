"""Token ids in files: ids ranked by frequency, in a byte-aligned variable-length code with separate control bytes.

Ranks are one, two, three or four bytes long; a control byte holds the lengths of four of them, so frequent tokens take
one byte and a decoder finds all lengths by a table before it touches the data. A file's rows are blocks in ascending
order of documents, and every block starts with its numbers of documents and ids.

Blocks are written and read by Spark, so the files can lie in any store it reaches. Documents are dealt by ranges of
the key, so a hot source or text does not matter; a document larger than a block makes a block of its own.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BEYOND, LETTERS, NUMBERS, SPACE, byte_symbols, tokenizer_path
from .common import arrow_schema, table, written
from .registry import query

END, VOCABULARY = 0, 1 << 16
#: Ids in a block, pretokens that a worker keeps, and characters of the longest one that it keeps.
BLOCK_IDS, CACHED, CACHED_LENGTH = 1 << 20, 400_000, 64
#: Bytes of a row's ids that ranges of equal keys are cut by.
RANGE_BYTES = 64
MAGIC = b"FRVB"

WORDS = r" ?{L}+|'(?:s|t|re|ve|m|ll|d)| ?{N}+| ?{O}+|{S}+(?!{T})|{S}+"


class Pretokens:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, pretoken by pretoken.

    Merges never cross the borders of pretokens, so each distinct one is encoded by the library once per worker.
    """

    def __init__(self, path: str, kept: int | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {s: np.array([i], "<u2").tobytes() for s, i in special.items()}
        self.borders = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        contractions_first = "'s|'t|'re|'ve|'m|'ll|'d|"
        self.any = regex.compile(
            contractions_first + r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        near = contractions_first + WORDS.format(
            L=f"[{LETTERS}]", N=f"[{NUMBERS}]", O=f"[^{SPACE}{LETTERS}{NUMBERS}]", S=f"[{SPACE}]", T=f"[^{SPACE}]"
        )
        self.near = re.compile(near)
        self.symbols = "".join(byte_symbols())
        self.packed = [i.tobytes() for i in np.arange(VOCABULARY).astype("<u2")]
        self.known = Known(self.ids_of, kept)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 16-bit integers."""
        out, known = [], self.known
        known.turn()
        for i, piece in enumerate(self.borders.split(text) if self.borders else [text]):
            if i % 2:
                out.append(self.special[piece])
            else:
                words = (self.any if BEYOND.search(piece) else self.near).findall(piece)
                out += map(known.__getitem__, words)
        return b"".join(out)

    def ids_of(self, word: str) -> bytes:
        """The library's own BPE of one pretoken: no threads to wait for, no offsets."""
        symbols = codecs.charmap_decode(word.encode("utf-8"), "strict", self.symbols)[0]
        return b"".join([self.packed[t.id] for t in self.library.model.tokenize(symbols)])


class Known(dict):
    """Pretokens met last, and below them those met before: most rare words come once, frequent ones stay known."""

    def __init__(self, learn: Callable[[str], bytes], kept: int | None = None):
        self.learn, self.kept, self.older = learn, CACHED if kept is None else kept, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids

    def turn(self) -> None:
        """Before a text: at most ``kept`` pretokens and those of one text are kept, twice."""
        if len(self) > self.kept:
            self.older = dict(self)
            self.clear()


@lru_cache(maxsize=2)
def pretokens(path: str, kept: int | None = None) -> Pretokens:
    return Pretokens(path, kept)


def packed_texts(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """(key, n, ids): ids of each text and the end id, as 16-bit integers."""
    slim = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    full = f"{key} {slim.schema[key].dataType.simpleString()}, n bigint, ids binary"
    schema = arrow_schema(docs.sparkSession, full)
    end = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pretokens(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                ids = [tokens.encode(t) + end for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(schema.field(0).type), pa.array([len(i) // 2 for i in ids]), pa.array(ids, pa.binary())],
                    schema=schema,
                )

    return slim.mapInArrow(run, full)


def ranks_by_frequency(packed: DataFrame) -> np.ndarray:
    """The rank of each id, the most frequent first, ties to the smaller id; a count per id is all that is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = b"".join(batch.column(0).slice(start, 256).to_pylist())
                counts += np.bincount(np.frombuffer(some, "<u2"), minlength=VOCABULARY)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "n"])

    rows = packed.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(VOCABULARY, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    ranks = np.empty(VOCABULARY, np.int64)
    ranks[np.argsort(-counts, kind="stable")] = np.arange(VOCABULARY)
    return ranks


def encode_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of integers below 2**32."""
    values = values.astype(np.uint32)
    sizes = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    data = np.empty(int(sizes.sum(dtype=np.int64)), np.uint8)
    data[starts] = values & np.uint32(255)
    for lane in range(1, int(sizes.max(initial=1))):
        some = np.flatnonzero(sizes > lane)
        data[starts[some] + lane] = values[some] >> np.uint32(8 * lane) & np.uint32(255)
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: Lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of a block: lengths from the table, then each byte lane gathered where it is present."""
    if not n:
        return np.zeros(0, np.uint32)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for lane in range(1, int(lengths.max())):
        some = np.flatnonzero(lengths > lane)
        out[some] |= raw[starts[some] + lane].astype(np.uint32) << np.uint32(8 * lane)
    return out


BLOCK = "shard int, block int, local_start bigint, n_ids bigint, keys array<{0}>, body binary"


def block_body(sizes: list[int], ranks: np.ndarray) -> bytes:
    """Header, lengths of the documents, control bytes, data bytes."""
    control, data = encode_block(ranks)
    head = np.array([len(sizes), len(ranks), len(control), len(data)], "<u8").tobytes()
    return MAGIC + head + np.array(sizes, "<u8").tobytes() + control + data


def open_block(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the documents, and ranks."""
    if body[:4] != MAGIC:
        raise ValueError("not a block of token ranks")
    docs, n, control, data = np.frombuffer(body, "<u8", 4, 4).tolist()
    at = 36
    sizes = np.frombuffer(body, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    return sizes, decode_block(body[at : at + control], body[at + control : at + control + data], n)


def write_token_files(packed: DataFrame, ranks: np.ndarray, folder: str, key: str) -> None:
    """Blocks of the packed documents in ascending order of key (nulls first, equal keys by their ids)."""
    spark = packed.sparkSession
    kind = packed.schema[key].dataType.simpleString()
    schema = arrow_schema(spark, BLOCK.format(kind))
    table16 = ranks.astype(np.uint32)  # 2**16 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, total = TaskContext.get().partitionId(), 0, 0
        keys, sizes, parts, held = [], [], [], 0

        def flush():
            values = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            columns = [[shard], [block], [total], [len(values)], [list(keys)], [block_body(sizes, values)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], schema=schema
            )

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = table16[np.frombuffer(ids.as_buffer(), "<u2")]
                keys.append(k)
                sizes.append(len(values))
                parts.append(values)
                held += len(values)
                if held >= BLOCK_IDS:
                    yield flush()
                    block, total = block + 1, total + held
                    keys, sizes, parts, held = [], [], [], 0
        if keys:
            yield flush()

    # rows of one key, null or not, are told apart by their first ids
    ordered = packed.select(key, "ids").repartitionByRange(
        F.col(key).asc_nulls_first(), F.substring("ids", 1, RANGE_BYTES)
    ).sortWithinPartitions(F.col(key).asc_nulls_first(), "ids")
    ordered.mapInArrow(run, BLOCK.format(kind)).write.option("compression", "none").parquet(folder)


def read_token_files(
    spark: SparkSession, folder: str, ranks: np.ndarray, key: str = "doc_id", with_ids: bool = True
) -> DataFrame:
    """(key, shard, local, n_tokens, ids_crc32, ids) of every document in the files; ``local`` counts the ids before it
    in its file. Without ``with_ids`` they are decoded all the same, but only their checksum is returned.
    """
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    ids_of = np.argsort(ranks).astype("<u4")
    full = f"{key} {kind}, shard int, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    schema = arrow_schema(spark, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, keys, body in zip(*(batch.column(i) for i in range(4))):
                sizes, found = open_block(body.as_py())
                ids = ids_of[found]
                ends = np.cumsum(sizes)
                begins = ends - sizes
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [
                    keys.values.cast(schema.field(0).type),
                    pa.array(np.full(len(sizes), shard.as_py(), np.int32)),
                    pa.array(begins + start.as_py()),
                    pa.array(sizes),
                    pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))).cast(schema.field(5).type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = blocks.select("shard", "local_start", "keys", "body").mapInArrow(run, full)
    return rows


def with_starts(rows: DataFrame, totals: dict[int, int]) -> DataFrame:
    """Starts over all files from starts within each: one number per file, looked up in an array."""
    shards = max(totals, default=-1) + 1
    sizes = np.array([totals.get(s, 0) for s in range(shards)], np.int64)
    before = (np.cumsum(sizes) - sizes).tolist()
    starts = rows.sparkSession.createDataFrame(list(enumerate(before)) or [(0, 0)], "shard int, before bigint")
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("before") + F.col("local"))


def token_files(
    docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", with_ids: bool = True
) -> tuple[DataFrame, np.ndarray]:
    """Write the ids of ``docs`` below ``folder`` and return the documents read back, and the ranks of the ids.

    Null texts count as empty and have the end id alone; repeated rows are written each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    packed = written(packed_texts(docs, path, key, text), "token-ids", compression="zstd")
    ranks = ranks_by_frequency(packed)
    write_token_files(packed, ranks, folder, key)
    rows = read_token_files(spark, folder, ranks, key, with_ids)
    held = spark.read.parquet(folder).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    return with_starts(rows, {r["shard"]: r["n"] for r in held}), ranks


@query()
def op8_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.session import work_path

    docs = table(spark, sf_dir, "documents")
    rows, _ = token_files(docs, tokenizer_path("byte_bpe_50k.json"), work_path(spark, "token-files"), with_ids=False)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
