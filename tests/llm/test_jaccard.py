"""The shingle join against all pairs."""

import random
import re

import numpy as np
import pytest
from cases import LONG, PASSAGE, documents, lower_ascii

from flowspark.llm import jaccard


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def expected(rows, size=4, percent=85):
    """(key, n, component) per row, all pairs compared."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(frame, **more):
    return sorted(map(tuple, jaccard.shingle_classes(frame, **more).collect()), key=repr)


def families(rng, count, longest):
    """Texts that are edited again and again, so that similarities lie on both sides of the bound."""
    rows, key = [], 0
    for _ in range(count):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, longest))]
        for _ in range(rng.randint(1, 9)):
            words = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(words) // 40])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1, 2])] = [f"w{rng.randrange(400)}"] * rng.choice([0, 1, 1])
                words = words or ["w"]
            rows.append((key * 7919 % 100_003, " ".join(words)))
            key += 1
    rng.shuffle(rows)
    return rows


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for percent in (50, 85, 95):
        for _ in range(250):
            n = int(rng.integers(1, 300))
            x = rng.integers(0, 1 << 62, n).astype(np.uint64)
            most = jaccard.most_different(n, n, percent)
            out = int(rng.integers(0, most + 1))
            y = np.concatenate([x[out:], rng.integers(0, 1 << 62, int(rng.integers(0, most + 1 - out))).astype(np.uint64)])
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if not len(y) or np.array_equal(x, y) or 100 * both < percent * (len(x) + len(y) - both):
                continue
            which, signature = jaccard.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]), percent)
            assert set(signature[which == 0].tolist()) & set(signature[which == 1].tolist()), (percent, len(x), len(y))


@pytest.mark.parametrize("size, top", [(6, 8), (500, 1000), (20000, 30000)])
def test_signatures_are_fewer_than_shingles(size, top):
    form = next(f for f in jaccard.layouts(85, top * 2) if f.low <= size <= f.high)
    assert form.good >= 1 and form.spare >= 1
    assert form.groups * len(form.choices()) <= max(6, 0.5 * size)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(100):
        x = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
        y = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
        a, b = (np.frombuffer(jaccard.sketch(v, 64), np.uint8) for v in (x, y))
        for size in (64, 16):
            apart = int(np.bitwise_count(jaccard.folded(a, size) ^ jaccard.folded(b, size)).sum())
            assert apart <= len(np.setxor1d(x, y))
        assert np.array_equal(jaccard.folded(a, 16), np.frombuffer(jaccard.sketch(x, 16), np.uint8))


@pytest.mark.parametrize("block, nearest", [(2048, 4), (2, 1)])
def test_families_of_edited_texts(spark, monkeypatch, block, nearest):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "NEAREST", nearest)
    rng = random.Random(block)
    rows = families(rng, 45, 30) + [(k + 200_000, t) for k, t in families(rng, 25, 160)]
    got = found(documents(spark, [(k, t, "en") for k, t in rows]))
    assert got == expected(rows)
    assert len({c for *_, c in got}) < len(rows)


def test_awkward_rows(spark):
    rows = [(1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, " \n\t"), (6, LONG), (7, LONG + " end"), (8, "short")]
    rows += [(9, "SHORT"), (None, "short"), (None, "no key"), (10, PASSAGE.upper() + " now"), (11, "Ü ü é\x0b日本 😀"), (12, "ü Ü é 日本 😀")]
    rows += [(13, None), (2, "another text of the same key"), (None, "a b c d e f g"), (None, "a b c d e f g")]
    frame = documents(spark, [(k, t, "en") for k, t in rows])
    frame = frame.withColumnRenamed("rid", "key").withColumnRenamed("mentions", "node").withColumnRenamed("block", "sig")
    assert found(frame) == expected(rows)


def test_empty_table_and_single_rows(spark):
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [(1, "two words", "en")])) == [(1, 1, 1)]
    assert found(documents(spark, [(1, "", "en")])) == [(1, 0, 1)]


def test_other_sizes_and_bounds(spark):
    rows = families(random.Random(8), 30, 60)
    frame = documents(spark, [(k, t, "en") for k, t in rows])
    assert found(frame, size=2, percent=60) == expected(rows, 2, 60)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = jaccard.op13_partenum_jaccard(spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
