"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import LONG, PASSAGE, documents

from flowspark.llm import periods


def plain_runs(x, least=6, exponent=4):
    """All maximal stretches of each period that is the smallest one of the stretch."""
    x, out = list(x), {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= max(least, exponent * q))


def plain_lyndon(x):
    n = len(x)
    best = []
    for i in range(n):
        best.append(max(k for k in range(1, n - i + 1) if all(x[i : i + k] < x[i + j : i + k] for j in range(1, k))))
    return best


def texts(rng, rounds):
    for _ in range(rounds):
        letters = rng.choice([1, 2, 2, 3, 4])
        x = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.6:
            x = x * rng.randint(1, 6) + [rng.randrange(letters) for _ in range(rng.randint(0, 6))] + x[:2] * rng.randint(0, 5)
        yield x


def test_lyndon_arrays_from_grouping():
    for x in texts(random.Random(1), 500):
        assert periods.lyndon_array(np.array(x)).tolist() == plain_lyndon(x), x


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (1, 3)])
def test_runs_of_all_kinds(least, exponent):
    for x in texts(random.Random(least), 700):
        assert list(map(tuple, periods.runs(np.array(x), least, exponent).tolist())) == plain_runs(x, least, exponent), x


def test_wrong_hashes_are_found_out(monkeypatch):
    """With hashes that are all equal the claimed runs are too long; what comes out is never false."""
    monkeypatch.setattr(periods, "hash_rows", lambda v: np.zeros(len(v), np.uint64))
    for x in texts(random.Random(9), 200):
        assert set(map(tuple, periods.runs(np.array(x)).tolist())) <= set(plain_runs(x)), x


def test_texts_of_a_batch_stay_apart():
    rng = random.Random(5)
    for _ in range(60):
        some = [np.array(x, np.int64) for x in texts(rng, rng.randint(1, 12))] + [np.zeros(0, np.int64)]
        rng.shuffle(some)
        found = periods.batch_runs(some)
        assert [list(map(tuple, f.tolist())) for f in found] == [plain_runs(x) for x in some]


def expected(key, text, change):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if change and key is not None and n and h % 10 == 0:
        g = h // 10
        a, words = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        source = list(words)
        for i in range(a, n):
            words[i] = source[a + (i - a) % p]
    found = plain_runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *four, sha(lines), sha(left), left)


def rows():
    rng = random.Random(3)
    out = [(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, " \t\n "), (None, "a b " * 9), (None, "x"), (5, "a " * 7 + "A a a a"), (6, LONG[:9000])]
    out += [(7, "é ü é ü é ü é ü é ü 日 日 日 日 日 日\x0b日\x0c日   nb sp"), (8, "la la la la la"), (9, "la la la la la la")]
    for k in range(10, 120):
        out.append((k, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 70)))))
    return out


@pytest.mark.parametrize("held", [1 << 18, 10])
def test_digests_of_awkward_rows(spark, monkeypatch, held):
    monkeypatch.setattr(periods, "BATCH_WORDS", held)
    docs = documents(spark, [(k, t, "en") for k, t in rows()]).withColumnRenamed("fp", "collapsed").withColumnRenamed("rid", "key")
    for change in (None, periods.made_periodic):
        got = [tuple(r) for r in periods.periodic_runs(docs, change=change).collect()]
        want = [(k, *expected(k, t, change)) for k, t in rows()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert periods.periodic_runs(documents(spark, [])).count() == 0


def test_query_equals_plain_search(spark, sf_dir):
    """Short texts of the smallest table word by word; the plain search is too slow for the long ones."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in periods.op11_lyndon_runs(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    short = {k: t for k, t in docs.items() if len(t or "") < 6000}
    assert len(short) > 100
    assert {k: got[k] for k in short} == {k: expected(k, t, True)[:7] for k, t in short.items()}
