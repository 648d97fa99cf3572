"""Repair of conversation structure by a dynamic program whose audits are persistent.

A conversation's role initials shall read ``(s?(ua)+)?``. Rows are kept, given another role or deleted, and empty rows
are inserted, at the least cost; of equally cheap repairs the one whose audit (the edits' initials in order) is least.
The program keeps the cheapest audit of each grammar state. Audits share their prefixes as linked nodes: a node has its
letter, its ancestors at distances of powers of two and a rolling hash of its prefix, so that a tie is decided by a
search for the longest common prefix, and equal hashes are verified letter by letter.

Rows are range-partitioned by conversation, turn and content, so that a conversation of any length is spread over
tasks; equal rows are counted before that. A conversation that lies within one task is repaired there. Of a longer one,
each piece is summed up on its own, as the cheapest audit from each state to each state; the pieces' sums are folded
along the conversation without any text, and at last each piece applies its share of the audit. Only the hash of a
repaired conversation reads its lines in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, table, written
from .registry import query

#: Costs of the edits; a row that is kept or given a role although it is truncated costs ``TRUNCATED`` more.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Grammar states: nothing yet, after s, after u, after a. A repaired conversation ends in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state that the next user or assistant row leads to.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"
#: Rows and characters of a piece.
PIECE_ROWS, PIECE_TEXT = 4096, 4 << 20
#: Hashes are taken modulo this prime.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6F1 % ((1 << 61) - 1)


class Audits:
    """Persistent strings: node 0 is the empty one, every other node its parent's string and a letter."""

    def __init__(self):
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]

    def append(self, node: int, letter: str) -> int:
        new = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % PRIME)
        ancestors = [node]
        while len(self.up[ancestors[-1]]) >= len(ancestors):
            ancestors.append(self.up[ancestors[-1]][len(ancestors) - 1])
        self.up.append(ancestors)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        rise = self.depth[node] - depth
        while rise:
            k = rise.bit_length() - 1
            node = self.up[node][k]
            rise -= 1 << k
        return node

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of equal depth hold the same string: hashes first, then the letters up to a shared node."""
        if self.hash[x] != self.hash[y]:
            return False
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``; a prefix comes first."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        # rise as long as the strings differ: the parents at the end are the longest common prefix
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def string(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def cheapest(codes: str, entry: int = START) -> dict[int, tuple[int, str]]:
    """For each state that ``codes`` can lead to from ``entry``: least cost and least audit at that cost.

    A code is a row's role initial (x if it is none of s, u, a), upper case if truncated, or - if it must be deleted.
    Two audits of the same rows at the same cost are never prefixes of one another, since a longer one would have paid
    for its insertions; so what is least stays least whatever follows.
    """
    audits = Audits()

    def settle(best: dict[int, tuple[int, int]], state: int, cost: int, node: int, letter: str) -> None:
        old = best.get(state)
        if old is None or cost < old[0]:
            best[state] = (cost, audits.append(node, letter))
        elif cost == old[0]:
            new = audits.append(node, letter)
            if audits.less(new, old[1]):
                best[state] = (cost, new)

    def inserted(best: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """With insertions; states are settled in the order of their costs, and every insertion costs something."""
        left = set(range(4))
        while open_states := [s for s in left if s in best]:
            state = min(open_states, key=lambda s: best[s][0])
            left.discard(state)
            if NEXT[state] in left:
                settle(best, NEXT[state], best[state][0] + INSERT, best[state][1], "I")
        return best

    best = inserted({entry: (0, 0)})
    for code in codes:
        after: dict[int, tuple[int, int]] = {}
        extra = TRUNCATED if code.isupper() else 0
        kept = KEPT.get(code.lower(), {})
        for state, (cost, node) in best.items():
            settle(after, state, cost + DELETE, node, "D")
            if code != "-":
                if state in kept:
                    settle(after, kept[state], cost + extra, node, "K")
                settle(after, NEXT[state], cost + extra + REROLE, node, "R")
        best = inserted(after)
    return {state: (cost, audits.string(node)) for state, (cost, node) in best.items()}


@lru_cache(maxsize=1 << 14)
def short_cheapest(codes: str, entry: int) -> dict[int, tuple[int, str]]:
    return cheapest(codes, entry)


def solved(codes: str, entry: int = START) -> dict[int, tuple[int, str]]:
    """Short conversations repeat each other's codes, so their answers are kept."""
    return short_cheapest(codes, entry) if len(codes) <= 32 else cheapest(codes, entry)


def applied(audit: str, rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows; ``state`` is that before the first edit."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[role[0]][state]
        else:
            state = NEXT[state]
            role = "user" if state == USER else "assistant"
        yield role, text


class Piece:
    """Faults, codes and turns of consecutive rows (turn, role, text, copies) of a conversation."""

    def __init__(self, items: list[tuple], seen: set[bytes]):
        self.blank = self.duplicate = self.truncated = 0
        codes, initials, self.rows = [], [], []
        for turn, role, text, copies in items:
            if not copies:
                continue
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            initials.append(initial * copies)
            stripped = text.rstrip(SPACE)
            if not stripped:
                self.blank += copies
                codes.append("-" * copies)
            else:
                name = digest(role, text)
                if name in seen:
                    fresh = 0
                else:
                    seen.add(name)
                    fresh = 1
                    cut = stripped[-1] not in ".!?"
                    self.truncated += cut
                    codes.append(initial.upper() if cut else initial)
                self.duplicate += copies - fresh
                codes.append("-" * (copies - fresh))
            self.rows += [(role, text)] * copies
        self.codes, self.initials = "".join(codes), "".join(initials)
        pairs = zip(self.initials, self.initials[1:])
        self.illegal = sum(a + b not in LEGAL for a, b in pairs)
        turns = [turn for turn, _, _, copies in items if copies and turn is not None]
        self.first, self.last = (turns[0], turns[-1]) if turns else (None, None)
        self.turns = len(set(turns))


def digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def lines(rows) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode("utf-8", "surrogatepass")


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
ITEM = "struct<turn:bigint,role:string,text:string,n:bigint>"
NAMES = [part.split()[0] for part in COUNTS.split(", ")]


def gaps(first, last, turns: int) -> int:
    return last - first + 1 - turns if turns else 0


def whole(items: list[tuple]) -> tuple:
    """Counts, audit, hash and rows of a conversation that lies in one place."""
    piece = Piece(items, set())
    found = solved(piece.codes)
    cost, audit = min(found[s] for s in ENDS if s in found)
    rows = list(applied(audit, piece.rows, START))
    counts = (gaps(piece.first, piece.last, piece.turns), piece.blank, piece.duplicate, piece.truncated, piece.illegal)
    return (*counts, cost, audit, hashlib.sha256(lines(rows)).hexdigest(), rows)


def laid_out(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """(conv, turn, role, text, n) in order within range partitions; equal rows are one row with their number.

    Rows of no copies only make their conversation known.
    """
    n = F.lit(1).cast("bigint") if copies is None else F.col(f"`{copies}`").cast("bigint")
    blank = F.lit(" ")
    slim = rows.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.when(n > 0, F.coalesce(F.col(f"`{role}`").cast("string"), blank)).otherwise("").alias("role"),
        F.when(n > 0, F.coalesce(F.col(f"`{text}`").cast("string"), blank)).otherwise("").alias("text"),
        n.alias("n"),
    )
    slim = slim.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    slim = slim.withColumn("mark", F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("mark").asc()]
    return slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("mark")


def solved_and_pieces(ordered: DataFrame, turns: bool) -> DataFrame:
    """One row per conversation that a partition surely holds whole, and one per piece of the others."""
    kind = ordered.schema["conv"].dataType.simpleString()
    full = (
        f"conv {kind}, {COUNTS}, repaired_sha256 string, repaired array<struct<role:string,text:string>>, "
        f"part int, seq bigint, items array<{ITEM}>"
    )
    schema = arrow_schema(ordered.sparkSession, full)
    width = len(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seq, out, held = 0, [], 0
        key, items, size, alone, first = None, None, 0, True, True

        def batch_of(some):
            columns = zip(*some)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema)], schema=schema)

        def piece():
            nonlocal seq
            seq += 1
            rows = [{"turn": t, "role": r, "text": x, "n": n} for t, r, x, n in items]
            return (key, *[None] * (width - 4), part, seq, rows)

        def close(edge: bool):
            if alone and not edge:
                *counts, rows = whole(items)
                repaired = [{"role": r, "text": x} for r, x in rows] if turns else None
                return (key, *counts, repaired, None, None, None)
            return piece()

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if items is None:
                    key, items = k, []
                elif k != key:
                    # the first conversation may have begun in an earlier partition
                    out.append(close(first))
                    held += size
                    key, items, size, alone, first = k, [], 0, True, False
                elif len(items) >= PIECE_ROWS or size >= PIECE_TEXT:
                    out.append(piece())
                    held += size
                    items, size, alone = [], 0, False
                items.append(tuple(row))
                size += len(row[2])
                if held > PIECE_TEXT or len(out) >= PIECE_ROWS:
                    yield batch_of(out)
                    out, held = [], 0
        if items:
            out.append(close(True))  # and the last one may go on in a later one
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(run, full)


def by_conversation(df: DataFrame) -> DataFrame:
    """Rows of a conversation follow each other in one partition, in the order of its pieces."""
    return df.repartition("name").sortWithinPartitions("name", "part", "seq")


SUMS = (
    "name string, part int, seq bigint, size bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first bigint, last bigint, turns bigint, initials string, costs array<int>, audits array<string>"
)


def summed_up(pieces: DataFrame, earlier: DataFrame) -> DataFrame:
    """Per piece: its counts, and cost and audit from each state to each state (null where there is no way)."""
    schema = arrow_schema(pieces.sparkSession, SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items = [(i["turn"], i["role"], i["text"], i["n"]) for i in row["items"]]
                piece = Piece(items, set(row["known"] or ()))
                ways = [cheapest(piece.codes, entry) for entry in range(4)]
                flat = [w.get(s, (None, None)) for w in ways for s in range(4)]
                ends = piece.initials[:1] + piece.initials[-1:]
                made = [row["name"], row["part"], row["seq"], len(piece.codes), piece.blank, piece.duplicate, piece.truncated]
                made += [piece.illegal, piece.first, piece.last, piece.turns, ends, [c for c, _ in flat], [a for _, a in flat]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(made, schema)], schema=schema)

    joined = pieces.join(earlier, ["name", "part", "seq"], "left").select("name", "part", "seq", "items", "known")
    return joined.mapInArrow(run, SUMS)


class Fold:
    """Joins the sums of pieces in order; audits are linked lists of the pieces' shares, which share their beginnings."""

    def __init__(self):
        # state: (cost, (previous, part, seq, entry state, share))
        self.best: dict[int, tuple[int, tuple | None]] = {START: (0, None)}
        self.counts = [0, 0, 0, 0]
        self.turns, self.first, self.last, self.initial = 0, None, None, ""

    @staticmethod
    def less(a: tuple, b: tuple) -> bool:
        """Whether one audit comes before another one of as many pieces; only what they don't share is read."""
        x, y, left, right = a, b, [], []
        while x is not y:
            left.append(x[4])
            right.append(y[4])
            x, y = x[0], y[0]
        return "".join(reversed(left)) < "".join(reversed(right))

    def add(self, row: dict) -> None:
        best: dict[int, tuple[int, tuple]] = {}
        for entry, (cost, before) in self.best.items():
            for state in range(4):
                more, share = row["costs"][4 * entry + state], row["audits"][4 * entry + state]
                if more is None:
                    continue
                node = (before, row["part"], row["seq"], entry, share)
                old = best.get(state)
                if old is None or cost + more < old[0] or (cost + more == old[0] and self.less(node, old[1])):
                    best[state] = (cost + more, node)
        self.best = best
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += row[name]
        if row["initials"]:
            self.counts[3] += bool(self.initial) and self.initial + row["initials"][0] not in LEGAL
            self.initial = row["initials"][-1]
        if row["turns"]:
            self.turns += row["turns"] - (self.last is not None and self.last == row["first"])
            self.first = row["first"] if self.first is None else self.first
            self.last = row["last"]

    def result(self) -> tuple[tuple, list[tuple]]:
        """Counts and audit, and (part, seq, entry, share of the audit) of each piece."""
        ends = [self.best[s] for s in ENDS if s in self.best]
        cost, node = ends[0]
        for other in ends[1:]:
            if other[0] < cost or (other[0] == cost and self.less(other[1], node)):
                cost, node = other
        shares = []
        while node is not None:
            shares.append(node[1:])
            node = node[0]
        shares.reverse()
        audit = "".join(share for *_, share in shares)
        return (gaps(self.first, self.last, self.turns), *self.counts, cost, audit), shares


def folded(sums: DataFrame) -> DataFrame:
    """Per conversation a row of counts (part is null), and per piece its entry state and share of the audit."""
    full = f"name string, {COUNTS}, part int, seq bigint, entry int, share string"
    schema = arrow_schema(sums.sparkSession, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, fold = None, None

        def close():
            counts, shares = fold.result()
            rows = [(name, *counts, None, None, None, None)]
            rows += [(name, *[None] * len(NAMES), *share) for share in shares]
            arrays = [pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    if fold:
                        yield close()
                    name, fold = row["name"], Fold()
                fold.add(row)
        if fold:
            yield close()

    return by_conversation(sums).mapInArrow(run, full)


def repaired_pieces(pieces: DataFrame, shares: DataFrame) -> DataFrame:
    """(name, part, seq, repaired): each piece after its share of the audit."""
    full = "name string, part int, seq bigint, repaired array<struct<role:string,text:string>>"
    schema = arrow_schema(pieces.sparkSession, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [(i["role"], i["text"]) for i in row["items"] for _ in range(i["n"])]
                done = [{"role": r, "text": t} for r, t in applied(row["share"], rows, row["entry"])]
                made = [row["name"], row["part"], row["seq"], done]
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(made, schema)], schema=schema)

    joined = pieces.join(shares, ["name", "part", "seq"]).select("name", "part", "seq", "items", "entry", "share")
    return joined.mapInArrow(run, full)


def hashed(repaired: DataFrame) -> DataFrame:
    """(name, repaired_sha256): the lines of each conversation pass one hasher, piece by piece."""
    full = "name string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hasher, any_line = None, None, False

        def close():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([hasher.hexdigest()])], names=["name", "repaired_sha256"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    if hasher:
                        yield close()
                    name, hasher, any_line = row["name"], hashlib.sha256(), False
                if row["repaired"]:
                    hasher.update((b"\n" if any_line else b"") + lines((r["role"], r["text"]) for r in row["repaired"]))
                    any_line = True
        if hasher:
            yield close()

    return by_conversation(repaired).mapInArrow(run, full)


def _repair(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None, turns: bool):
    laid = written(solved_and_pieces(laid_out(rows, conv, turn, role, text, copies), turns), "conversations")
    name = F.coalesce(F.concat(F.lit("k"), F.col("conv").cast("string")), F.lit("n"))
    pieces = laid.where("part is not null").withColumn("name", name).select("name", "conv", "part", "seq", "items")
    each = pieces.select("name", "part", "seq", F.explode("items").alias("i")).where("i.n > 0")
    mark = F.md5(F.concat(F.length("i.role").cast("string"), F.lit(":"), "i.role", "i.text").cast("binary"))
    each = each.select("name", "part", "seq", F.unhex(mark).alias("mark")).distinct()
    first = each.groupBy("name", "mark").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = each.join(first, ["name", "mark"]).where(F.struct("part", "seq") > F.col("first"))
    earlier = later.groupBy("name", "part", "seq").agg(F.collect_list("mark").alias("known"))
    found = written(folded(summed_up(pieces, earlier)), "conversation-audits")
    repaired = repaired_pieces(pieces, found.where("part is not null").select("name", "part", "seq", "entry", "share"))
    return laid, pieces, found, written(repaired, "conversation-pieces")


def repaired_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Rows go by turn, nulls first; rows of one turn by the md5 of their role and text. Null roles and texts count as one
    space, a null conversation is one of its own. A role that starts with none of s, u, a (an empty one too) cannot be
    kept. ``copies`` names a column with the number of times that a row stands there; rows of none only make their
    conversation known, and one without any other row has zeros, an empty audit and the hash of the empty string.
    """
    laid, pieces, found, repaired = _repair(rows, conv, turn, role, text, copies, False)
    names = pieces.groupBy("name").agg(F.first("conv").alias("conv"))
    long = found.where("part is null").join(names, "name").join(hashed(repaired), "name")
    columns = ["conv", *NAMES, "repaired_sha256"]
    return laid.where("part is null").select(*columns).unionByName(long.select(*columns)).withColumnRenamed("conv", conv)


def repaired_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> DataFrame:
    """(conv, part, seq, place, role, text): the repaired rows themselves, in the order of the three numbers."""
    laid, pieces, _, repaired = _repair(rows, conv, turn, role, text, copies, True)
    zero = F.lit(0)
    short = laid.where("part is null").select("conv", zero.alias("part"), zero.cast("bigint").alias("seq"), "repaired")
    names = pieces.select("name", "part", "seq", "conv")
    long = repaired.join(names, ["name", "part", "seq"]).select("conv", "part", "seq", "repaired")
    each = short.unionByName(long).select("conv", "part", "seq", F.posexplode("repaired").alias("place", "row"))
    return each.select(F.col("conv").alias(conv), "part", "seq", "place", F.col("row.role").alias(role), F.col("row.text").alias(text))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows with faults by the crc32 of their names; a dropped row has no copies."""
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    fault = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(damaged(table(spark, sf_dir, "conversations")), copies="copies")
