"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from flowspark.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, name string, part string, n int"
FORM = re.compile(r"(s?(ua)+)?")


def plain(codes):
    """Least cost and least audit by a search in the order of (cost, audit), one edit at a time."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if at == len(codes) and FORM.fullmatch(out):
            return cost, audit
        # what was written matters by its end, and by whether it is empty
        state = (at, out[-1:])
        if state in done:
            continue
        done.add(state)
        if at < len(codes):
            code = codes[at]
            extra = code.isupper()
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, out))
            if code != "-":
                if code.lower() != "x":
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, out + code.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, out + role))
        for role in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", at, out + role))
        heap = [h for h in heap if re.fullmatch(r"s?(ua)*u?", h[3])]
        heapq.heapify(heap)


def test_cheapest_audits_of_all_short_codes():
    rng = random.Random(1)
    for _ in range(1500):
        codes = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 9)))
        found = C.cheapest(codes)
        assert min(found[s] for s in C.ENDS if s in found) == plain(codes), codes


def test_nodes_compare_as_their_strings():
    rng = random.Random(2)
    audits, strings = C.Audits(), {0: ""}
    for _ in range(400):
        node, letter = rng.choice(list(strings)), rng.choice("DI")
        strings[audits.append(node, letter)] = strings[node] + letter
    nodes = list(strings)
    for _ in range(4000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert audits.less(a, b) == (strings[a] < strings[b])
        assert audits.string(a) == strings[a]


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(C, "PRIME", 1)  # every hash is 0
    test_nodes_compare_as_their_strings()


def order(row):
    _, turn, role, text = row
    mark = hashlib.md5((role + "\0" + text).encode()).hexdigest()
    return (turn is not None, turn or 0, mark)


def expected(rows):
    """Result rows of (conv, turn, role, text, copies) rows, by the plain search."""
    out = {}
    for conv in {r[0] for r in rows}:
        some = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in rows if c == conv for _ in range(n)), key=order)
        codes, seen, blank, dup, cut = "", set(), 0, 0, 0
        for _, _, role, text in some:
            initial = role[:1] if role[:1] and role[:1] in "sua" else "x"
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            if not body:
                blank, code = blank + 1, "-"
            elif (role, text) in seen:
                dup, code = dup + 1, "-"
            elif body[-1] not in ".!?":
                cut, code = cut + 1, initial.upper()
            else:
                code = initial
            seen.add((role, text))
            codes += code
        cost, audit = plain(codes)
        repaired, at, last = [], iter(some), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(at)[2:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            repaired.append(f"{role}:{text}")
            last = role[0]
        initials = [r[2][:1] for r in some]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[1] for r in some if r[1] is not None]
        gap = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gap, blank, dup, cut, illegal, cost, audit, sha, repaired)
    return out


def awkward():
    rng = random.Random(4)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 7)):
            turn = rng.choice([turn, turn, turn, 3, None, 2**40])
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "User", "user"])
            text = rng.choice(["Fine.", "Not ended", "", "  \t", None, "Ünï 日本😀!", "a b?\n", "again.", "x" * 3000, "e."]) 
            rows.append((conv, turn, role, text, rng.choice([0, 1, 1, 1, 2, 3])))
    rows += [(100, i, "user" if i % 2 == 0 else "assistant", f"text {i % 70}.", 1) for i in range(300)]
    rows += [(101, None, "user", "the same.", 5), (102, 1, "user", "gone.", 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], "x", "y", 7, r[4]) for r in rows], SCHEMA + ", copies bigint")


@pytest.mark.parametrize("size", [4096, 3])
def test_repairs_of_awkward_rows(spark, monkeypatch, size):
    """Conversations in one place and in pieces, spread over partitions."""
    monkeypatch.setattr(C, "PIECE_ROWS", size)
    rows = awkward()
    want = expected(rows)
    got = C.repaired_conversations(frame(spark, rows), copies="copies").collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]][:8], r["conv_id"]
    turns = C.repaired_turns(frame(spark, rows), copies="copies").collect()
    lines = {}
    for r in sorted(turns, key=lambda r: (r["part"], r["seq"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert lines == {k: v[8] for k, v in want.items() if v[8]}


def test_empty_table(spark):
    assert C.repaired_conversations(frame(spark, [])).count() == 0


def test_query_equals_plain_repair_of_the_damaged_table(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        fault = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        role, text = " " if r["role"] is None else r["role"], " " if r["text"] is None else r["text"]
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        rows.append((r["conv_id"], r["turn"], "user" if fault == 4 else role, text, {0: 0, 3: 2}.get(fault, 1)))
    want = expected(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.op12_conversation_repair(spark, sf_dir).collect()}
    assert got == {k: v[:8] for k, v in want.items()}
