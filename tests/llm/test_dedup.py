"""SimHash groups and repeated passages against brute force."""

import random

import numpy as np
import pytest
from cases import LONG, PASSAGE, ROWS, documents, fingerprint, linked, repeated

from flowspark.llm import simhash, suffix_dedup
from flowspark.llm.components import components
from flowspark.llm.lyndon import suffix_order


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    prints = [(k, fingerprint(t)) for k, t, _ in ROWS]
    expected = sorted((str(k), f, c) for (k, f), c in zip(prints, linked(prints)))
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == expected


@pytest.mark.parametrize("bucket", [0, 48])
def test_links_of_clustered_fingerprints(spark, monkeypatch, bucket):
    """The crowded and the calm path find the components of all pairs."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    values = set()
    for centre in [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]:
        for _ in range(30):
            values.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}))
    values = sorted(values)
    distinct = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp bigint")
    found = components(simhash.links(distinct), "a", "b").collect()
    root = {r["node"] & (1 << 64) - 1: r["root"] for r in found}
    expected = linked([(i, v) for i, v in enumerate(values)])
    groups, theirs = {}, {}
    for v, e in zip(values, expected):
        groups.setdefault(e, set()).add(v)
        theirs.setdefault(root.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_thresholds_add_up_and_avoid_frequent_values():
    costs = np.array([[[0, 5.0, 50, 500], [0, 1.0, 10, 100], [0, 900.0, 990, 999]]])
    chosen = simhash.allocate(costs, simhash.DISTANCE - simhash.PARTS + 1)[0]
    assert chosen.sum() == 0 and chosen[2] == -1 and chosen[1] == 1


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a int, b int")
    found = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_empty_tables(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert suffix_dedup.repeated_passages(documents(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    keys = [r["doc_id"] for r in kept.collect()]
    prints = [(k, fingerprint(t)) for k, t, _ in ROWS]
    expected = {k for (k, _), c in zip(prints, linked(prints)) if k is not None and k == c}
    assert sorted(k for k in keys if k is not None) == sorted(expected)
    assert keys.count(2) == 0 and keys.count(None) == 1


def test_rows_that_share_a_key_stay_apart(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one, "en"), (5, two, "en"), (6, two, "en"), (5, one, "en"), (7, one, "en")]
    kept = simhash.keep_one(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(5, one), (5, two)]


def test_lyndon_grouping_sorts_suffixes():
    rng = random.Random(3)
    for _ in range(800):
        x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
        assert suffix_order(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("hot", [3, 50_000])
def test_repeated_passages(spark, monkeypatch, hot):
    """Overlaps, runs of one character, edges of texts, bytes of wide characters; hot anchors counted apart."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [
        base[:400], base[100:700], "x" * 1000, "x" * 199, "x" * 200, None, "", "ab" * 300, base[:250] + "é" * 300,
        base[500:699] + "Q" + base[700:1000], base[800:900] + base[:199] + base[1999:2300], PASSAGE, LONG[:30000], LONG[5:9000],
    ]
    texts += [rng.choice("xyz") * rng.randint(0, 60) + base[1200 : 1200 + rng.randint(150, 260)] + str(i) for i in range(60)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_passages(documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == repeated(texts)


def test_repeated_rows_repeat_each_other(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(1, text, None), (1, text, None), (None, "tiny", None)]
    got = suffix_dedup.repeated_passages(documents(spark, rows)).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(4, 0), (300, 300), (300, 300)]
