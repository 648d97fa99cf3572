"""Exact Jaccard join of word shingle sets with PartEnum signatures.

Sets are dealt into bands by size. Two linked sets of a level (its band, and the larger sets that may link into it)
differ in at most ``k`` shingles. The domain of shingles is split by hash into groups, and each group into parts; some
group holds at most ``spare`` of the differences, so some choice of all but ``spare`` of its parts sees none, and both
sets have the same shingles there. Each such choice of parts is a signature, so sufficiently similar sets share one.

There are more groups than the pigeonhole needs. So a set may leave out signatures of fewer than ``WEAK`` shingles, which
many sets share by chance, unless too many of its groups have one; then it keeps them all, and nothing is lost.

Only distinct sets take part. Each is compared with the members that most of its signatures name first, and linked ones
are united. What then still lies in several components of a signature is compared in blocks of parity sketches, which
never lie above the true difference: first each set with its nearest ones, and after linked ones are united again, all
pairs that a sketch allows are compared exactly. So no signature's members are paired with each other but those that
are close and not yet known to be connected.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, hash_rows, table, written
from .components import components
from .registry import query

SHINGLE, PERCENT = 4, 85
#: Least number of shingles of a strong signature, and the number that layouts aim at.
WEAK, WANTED = 2, 4.0
#: Ratio of a band's largest size to its smallest one.
WIDTH = 1.4
#: Words that are worked on at once; words that a worker knows by hash; sets of a signature that are compared at once.
CHUNK_WORDS, KNOWN, BLOCK = 1 << 18, 400_000, 2048
#: Comparisons of a set with first members of its signatures, and with its nearest ones.
FIRSTS, NEAREST = 1, 3

SALTS = tuple(np.uint64(s) for s in (0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99, 0xD1B54A32D192ED03))


class Layout(NamedTuple):
    """A level's sizes (``low`` to ``high`` in its band, ``top`` among those that link into it) and its signatures."""

    level: int
    low: int
    high: int
    top: int
    k: int
    groups: int
    spare: int
    parts: int
    good: int  # groups with at most ``spare`` differences that any two linked sets have

    def choices(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.parts), self.parts - self.spare))

    def sketch_bytes(self) -> int:
        """Sixteen bits or more for each possible difference, so that few of them fall together."""
        return 1 << max(4, (2 * self.k - 1).bit_length())


def most_different(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of ``a`` and ``b`` shingles."""
    return (a + b) * (100 - percent) // (100 + percent)


def layout(level: int, low: int, percent: int) -> Layout:
    """The level whose smallest size is ``low``, with the fewest signatures whose parts hold enough shingles."""
    high = max(100 * low // percent, int(low * WIDTH))
    top = 100 * high // percent
    k = most_different(high, top, percent)
    best = None
    for spare in range(min(k, 4) + 1):
        for parts in range(spare + 1, spare + 6):
            bad = k // (spare + 1)
            # one group needs no other; of several, an eighth and one more may be weak
            groups = 1 if not bad else next(g for g in itertools.count(bad + 1) if g - bad >= 2 + g // 8)
            held = low * (parts - spare) / (groups * parts)
            cost = groups * math.comb(parts, spare)
            rank = (0, cost, -held) if held >= WANTED else (1, -held, cost)
            if best is None or rank < best[0]:
                best = (rank, Layout(level, low, high, top, k, groups, spare, parts, groups - bad))
    return best[1]


@lru_cache(maxsize=None)
def layouts(percent: int, largest: int) -> list[Layout]:
    """Levels for sets of up to ``largest`` shingles, from the smallest size that links to a different set."""
    out, low = [], -(-percent // (100 - percent)) if percent < 100 else largest + 1
    while low <= largest:
        out.append(layout(len(out), low, percent))
        low = out[-1].high + 1
    return out


class Words:
    """64-bit hashes of words; a worker keeps the ones it has met last."""

    def __init__(self):
        self.old: dict[bytes, int] = {}
        self.new: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.new.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(self.new) > KNOWN:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        for w in words:
            if w not in new:
                new[w] = old[w] if w in old else xxhash.xxh64_intdigest(w, 11)
        return np.fromiter(map(new.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def known_words() -> Words:
    return Words()


def split(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes): hashes of the distinct shingles of each text, ascending, one text after the other.

    A text of fewer words has one shingle of all of them, one without words none.
    """
    counts = np.array([len(t) for t in texts], np.int64)
    hashes = known_words().of(list(itertools.chain.from_iterable(texts)))
    n = len(hashes)
    value = hash_rows(hashes + SALTS[0])
    for i in range(1, min(size, n)):
        value[: n - i] = hash_rows(value[: n - i] * SALTS[1] + hashes[i:])
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    whole = np.arange(n) + size <= ends[owner]
    value, owner = value[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        one = [xxhash.xxh64_intdigest(b" ".join(texts[i]), 1000 + len(texts[i])) for i in short.tolist()]
        value, owner = np.append(value, np.array(one, np.uint64)), np.append(owner, short)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[first], np.bincount(owner[first], minlength=len(texts))


def level_signatures(values: np.ndarray, owner: np.ndarray, sets: int, form: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) rows of ``sets`` sets at one level; ``owner`` tells the set of each value."""
    mixed = hash_rows(values ^ SALTS[2])
    group = ((mixed >> np.uint64(32)) % np.uint64(form.groups)).astype(np.int64)
    part = ((mixed & np.uint64(0xFFFFFFFF)) % np.uint64(form.parts)).astype(np.int64)
    cell = (owner * form.groups + group) * form.parts + part
    shape = (sets, form.groups, form.parts)
    held = np.bincount(cell, minlength=math.prod(shape)).reshape(shape)
    sums = np.zeros(math.prod(shape), np.uint64)
    np.add.at(sums, cell, hash_rows(values + SALTS[0]))
    sums = sums.reshape(shape)
    choices = [list(c) for c in form.choices()]
    count = np.stack([held[:, :, c].sum(axis=2) for c in choices], axis=2)
    total = np.stack([sums[:, :, c].sum(axis=2, dtype=np.uint64) for c in choices], axis=2)
    name = np.arange(form.groups * len(choices), dtype=np.uint64).reshape(1, form.groups, -1) + np.uint64(form.level << 40)
    signature = hash_rows(total + hash_rows(name + SALTS[1]))
    weak = count < WEAK
    # some good group of a set with fewer weak groups is strong throughout
    all_of = weak.any(axis=2).sum(axis=1) >= form.good
    emitted = ~weak | all_of[:, None, None]
    which = np.nonzero(emitted)[0]
    return which, signature[emitted]


def signatures(values: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) rows of several sets, each at its own level and, where it may link into it, the one below."""
    ends = np.cumsum(sizes)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for form in layouts(percent, 1 << (int(sizes.max(initial=0)) + 1).bit_length()):
        some = np.flatnonzero((sizes >= form.low) & (sizes <= form.top))
        if not len(some):
            continue
        take = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in some.tolist()])
        owner = np.repeat(np.arange(len(some)), sizes[some])
        which, signature = level_signatures(values[take], owner, len(some), form)
        found.append((some[which], signature))
    which, signature = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(which, kind="stable")
    return which[order], signature[order]


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(place, words) of texts in groups of up to ``CHUNK_WORDS`` words; a longer text stands alone."""
    start, group, held = 0, [], 0
    for i, text in enumerate(texts):
        words = split(text.as_py())
        if group and held + len(words) > CHUNK_WORDS:
            yield start, group
            start, group, held = i, [], 0
        group.append(words)
        held += len(words)
    if group:
        yield start, group


def name_of(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = np.frombuffer(hashlib.md5(values.tobytes()).digest(), "<i8").tolist()
    return a, b


def set_table(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, n, s1, s2, signatures) per row of docs (key, text).

    A set's signatures come with its first copy in each task, so copies are not shuffled.
    """
    kind = docs.schema["key"].dataType.simpleString()
    full = f"key {kind}, n bigint, s1 bigint, s2 bigint, signatures array<bigint>"
    schema = arrow_schema(docs.sparkSession, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for start, words in chunks(batch.column(1)):
                values, sizes = shingle_sets(words, size)
                ends = np.cumsum(sizes)
                names = [name_of(values[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                new = np.zeros(len(words), bool)
                for i, name in enumerate(names):
                    if name not in met:
                        met.add(name)
                        new[i] = True
                which, signature = signatures(values[np.repeat(new, sizes)], sizes[new], percent)
                counts = np.zeros(len(words), np.int64)
                counts[new] = np.bincount(which, minlength=int(new.sum()))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(signature.view(np.int64)))
                columns = [batch.column(0).slice(start, len(words)).cast(schema.field(0).type), pa.array(sizes)]
                columns += [pa.array([n[i] for n in names], pa.int64()) for i in (0, 1)] + [lists.cast(schema.field(4).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, full)


def sketch(values: np.ndarray, size: int) -> bytes:
    """Parities of the values that fall on each of ``8 * size`` bits, a power of two."""
    place = (hash_rows(values + SALTS[1]) & np.uint64(8 * size - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=8 * size) & 1).astype(np.uint8).tobytes()


def compared_sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, n, hashes, sketch) of the sets in ``nodes`` (s1, s2, node); ``wanted`` holds keys of rows with them."""
    full = "s1 bigint, s2 bigint, n bigint, hashes binary, sketch binary"
    schema = arrow_schema(docs.sparkSession, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in chunks(batch.column(0)):
                values, sizes = shingle_sets(words, size)
                forms = layouts(percent, 1 << (int(sizes.max(initial=0)) + 1).bit_length())
                lows = [f.low for f in forms]
                rows, at = [], 0
                for n in sizes.tolist():
                    some = values[at : at + n]
                    at += n
                    level = int(np.searchsorted(lows, n, side="right")) - 1
                    if level >= 0:
                        rows.append((*name_of(some), n, some.tobytes(), sketch(some, forms[level].sketch_bytes())))
                if rows:
                    arrays = [pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    same = F.col("key").eqNullSafe(F.col("wanted"))
    rows = docs.join(wanted.select(F.col("key").alias("wanted")), same, "left_semi").select("text")
    found = rows.mapInArrow(run, full).join(nodes, ["s1", "s2"])
    # rows of other copies, or of a repeated key, may bring a set once more
    return found.dropDuplicates(["node"]).select("node", "n", "hashes", "sketch")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("left"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("right"))
    sizes = F.col("na"), F.col("nb")
    near = 100 * F.least(*sizes) >= percent * F.greatest(*sizes)
    joined = pairs.join(one, "a").join(two, "b").where(near).select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a bigint, b bigint")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches of ``size`` bytes from longer ones: places are taken modulo a smaller power of two."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def allowed_pairs(rows: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """(a, b) of nodes in different components whose sketches allow a link; rows (sig, i, j, own, node, root, n, sketch).

    Rows of a signature and two blocks i and j stand together; ``own`` is a row's block, and rows of one block meet rows
    of the other, or each other where i is j. With ``nearest``, each node has no more than so many pairs, the closest.
    """

    def joined(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b", "apart"])

    def bucket(i: int, j: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        size = min(len(r[4]) for r in rows)
        node, root, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        bits = np.stack([folded(np.frombuffer(r[4], np.uint8), size) for r in rows]).view(np.uint64)
        own = np.array([r[0] for r in rows], np.int64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        ways = [(left, right)] if nearest is None or i == j else [(left, right), (right, left)]
        for x, right in ((x, right) for one, right in ways for x in one.tolist()):
            some = right[right > x] if i == j and nearest is None else right
            some = some[root[some] != root[x]]
            some = some[100 * np.minimum(n[some], n[x]) >= percent * np.maximum(n[some], n[x])]
            if len(some):
                apart = np.bitwise_count(bits[some] ^ bits[x]).sum(axis=1, dtype=np.int64)
                allowed = apart <= (n[some] + n[x]) * (100 - percent) // (100 + percent)
                some, apart = some[allowed], apart[allowed]
                if nearest is not None and len(some) > nearest:
                    order = np.lexsort((node[some], apart))[:nearest]
                    some, apart = some[order], apart[order]
            if len(some):
                out.append((np.full(len(some), node[x]), node[some], apart))
                held += len(some)
            if held >= 1 << 14:
                yield joined(out)
                out, held = [], 0
        if out:
            yield joined(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            for sig, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (sig, i, j) != name:
                    if len(held) > 1:
                        yield from bucket(*name[1:], held)
                    name, held = (sig, i, j), []
                held.append(row)
        if len(held) > 1:
            yield from bucket(*name[1:], held)

    columns = ["sig", "i", "j", "own", "node", "root", "n", "sketch"]
    dealt = rows.select(*columns).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    pairs = dealt.mapInArrow(run, "a bigint, b bigint, apart bigint")
    if nearest is not None:
        pairs = pairs.distinct()
        window = Window.partitionBy("a").orderBy("apart", "b")
        pairs = pairs.withColumn("place", F.row_number().over(window)).where(F.col("place") <= nearest)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (sig, node, ...) of a signature in blocks of about ``BLOCK``, each row with every block pair it takes part in."""
    sizes = rows.groupBy("sig").agg(F.count("*").alias("held"))
    many = F.greatest(F.lit(1), F.ceil(F.col("held") / BLOCK)).cast("int")
    dealt = rows.join(sizes, "sig").withColumn("many", many)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def open_signatures(rooted: DataFrame) -> DataFrame:
    """Rows (sig, node, root) of the signatures whose members lie in several components."""
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("sig")
    return rooted.join(mixed, "sig")


def links(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links whose components are those of all linked pairs among rows (sig, node) of shared signatures.

    The first two rounds only save work: whatever they leave apart is compared afterwards, without exception.
    """

    def united(rooted: DataFrame, linked: DataFrame) -> DataFrame:
        roots = written(components(linked, "a", "b"), "jaccard-roots").select("node", F.col("root").alias("least"))
        rooted = rooted.join(roots, "node", "left").select("sig", "node", F.coalesce("least", "root").alias("root"))
        return written(open_signatures(rooted), "jaccard-rooted")

    def sketched(rooted: DataFrame) -> DataFrame:
        return blocks(rooted).join(sets.select("node", "n", "sketch"), "node")

    least = shared.groupBy("sig").agg(F.min("node").alias("a"))
    first = shared.join(least, "sig").where("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
    window = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    first = first.withColumn("place", F.row_number().over(window)).where(F.col("place") <= FIRSTS).select("a", "b")
    linked = written(verified(first, sets, percent), "jaccard-links")
    rooted = united(shared.withColumn("root", F.col("node")), linked)
    near = written(allowed_pairs(sketched(rooted), percent, NEAREST), "jaccard-pairs")
    linked = written(linked.unionByName(verified(near, sets, percent)), "jaccard-links")
    rooted = united(rooted, linked)
    rest = written(allowed_pairs(sketched(rooted), percent), "jaccard-pairs")
    return linked.unionByName(verified(rest, sets, percent))


def shingle_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(key, n_shingles, component_id) per row: the smallest key that it reaches over links of ``percent`` and more.

    Null and empty texts, and those of white space, have no shingles and link to nothing. Rows of equal sets are linked
    (copies, repeated rows). A null key takes part under the smallest other key of its component, null if there is
    none. Shingles are compared by 64-bit hashes, sets named by 128 bits.
    """
    slim = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    sets = written(set_table(slim, size, percent), "jaccard-sets")
    each = sets.select("s1", "s2", F.explode("signatures").alias("sig"))
    of_sig = "partition by sig"
    met = each.withColumn("low", F.expr(f"min(s1) over ({of_sig})")).withColumn("high", F.expr(f"max(s1) over ({of_sig})"))
    met = written(met.where("low <> high").select("sig", "s1", "s2"), "jaccard-met")
    nodes = written(met.select("s1", "s2").distinct().withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    shared = written(met.join(nodes, ["s1", "s2"]).select("sig", "node").distinct(), "jaccard-shared")
    # the rows of a set are counted and reduced to their smallest key before they meet anything
    distinct = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct, "jaccard-distinct")
    wanted = distinct.join(nodes, ["s1", "s2"], "left_semi").select(F.col("least").alias("key")).distinct()
    compared = written(compared_sets(slim, wanted, nodes, size, percent), "jaccard-compared")
    reached = written(components(links(shared, compared, percent), "a", "b"), "jaccard-components").select("node", "root")
    # sets outside of every link stand for themselves
    linked = nodes.join(reached, "node").select("s1", "s2", "root")
    named = written(distinct.join(linked, ["s1", "s2"], "left"), "jaccard-named")
    smallest = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = named.where("root is not null").join(smallest, "root").select("s1", "s2", "component_id", "copies")
    alone = named.where("root is null").select("s1", "s2", F.col("least").alias("component_id"), "copies")
    class_of = class_of.unionByName(alone)
    return with_classes(sets, written(class_of, "jaccard-classes")).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id"
    )


def with_classes(sets: DataFrame, class_of: DataFrame) -> DataFrame:
    """(key, n, component_id) of all rows; sets with a thousandth of the rows or more are joined by broadcast."""
    total = class_of.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    frequent = F.col("copies") * 1000 > total
    common = F.broadcast(class_of.where(frequent).select("s1", "s2", F.col("component_id").alias("common"), F.lit(True).alias("met")))
    marked = sets.where("n > 0").select("key", "n", "s1", "s2").join(common, ["s1", "s2"], "left")
    some = marked.where("met").select("key", "n", F.col("common").alias("component_id"))
    rest = marked.where("met is null").join(class_of.where(~frequent), ["s1", "s2"]).select("key", "n", "component_id")
    none = sets.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return some.unionByName(rest).unionByName(none)


@query()
def op13_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_classes(table(spark, sf_dir, "documents"))
