"""Small inputs with the awkward rows that every operator must take, and plain versions of what they compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

LONG = " ".join(f"word{i % 977} thing{i % 13}" for i in range(20000))
PASSAGE = "the quick brown fox jumps over one lazy dog while thirteen more words are standing here in line and wait"

ROWS = [
    (1, PASSAGE, "en"),
    (2, PASSAGE, "en"),
    (2, PASSAGE, "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "   \n\t ", "en"),
    (6, LONG, "en"),
    (7, "Ünïcödé ΑΣ 日本語 😀 ﬁ <|endoftext|> it's 123 " + PASSAGE, "de"),
    (8, "short", None),
    (None, "no key", "en"),
    (9, PASSAGE + " " + LONG[:500], "en"),
    (10, PASSAGE.upper() + "!!", "en"),
]


def documents(spark, rows=None):
    """Documents with extra columns whose names operators use inside."""
    rows = ROWS if rows is None else rows
    own = ("row", "_row", "named", "hit", "scored", "place")
    extra = [(k, t, lang, "src", len(t or ""), 1, 2, "x", 3, *(f"own {c}" for c in own)) for k, t, lang in rows]
    return spark.createDataFrame(
        extra,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, rid int, mentions string, block int, "
        + ", ".join(f"{c} string" for c in own),
    )


def lower_ascii(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def linked(values, distance=2):
    """Smallest key reachable for (key, fingerprint) pairs, all pairs compared."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i][1] ^ values[j][1]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(values):
        r = find(i)
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return [least.get(find(i)) for i in range(len(values))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))


def contamination(text, items, size=13):
    words, windows = bench_words(text), {}
    for name, body in items:
        w = bench_words(body)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    hit, found = [0] * len(words), set()
    for length in {len(w) for w in windows}:
        for i in range(len(words) - length + 1):
            names = windows.get(tuple(words[i : i + length]))
            if names:
                found |= names
                hit[i : i + length] = [1] * length
    n = sum(hit)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), n, len(found), digest, n > 0 and 20 * n >= len(words)


def repeated(texts, size=200):
    """(bytes, removed, runs, sha256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        mark = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - size + 1):
            if counts[d[i : i + size]] > 1:
                mark[i] += 1
                mark[i + size] -= 1
        gone = np.cumsum(mark)[: len(d)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
