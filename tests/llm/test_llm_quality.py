"""Decontamination, toxicity, surrogates, licences, neighbours and language scores."""

import zlib
from collections import Counter

import numpy as np
import pytest
from cases import PASSAGE, ROWS, contamination, documents
from compare import differences, duck

from flowspark.llm import attention, decontaminate, licences, neighbours, simhash, surrogates, toxicity, transformer
from flowspark.llm.bpe import tokenizer_path
from flowspark.llm.common import sha256_hex
from flowspark.llm.wavelet import FmIndex

ITEMS = [("b", PASSAGE), ("a", PASSAGE + " and more"), ("c", "short"), ("d", ""), ("e", None), ("a", PASSAGE), (None, "no key")]


@pytest.mark.parametrize("block,piece", [(1_000_000, 4096), (20, 15)])
def test_contamination(spark, monkeypatch, block, piece):
    """Null and repeated ids too; the number of blocks changes nothing."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    rows = [*ROWS, (None, PASSAGE, "en"), (None, None, "en"), (1, "clean words of a known id", "en")]
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = decontaminate.judged(decontaminate.contamination(documents(spark, rows), items)).collect()
    got = [
        (r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), sha256_hex(",".join(r["items"]).encode()), r["contaminated"])
        for r in found
    ]
    expected = [(k, *contamination(t, [(n or "", x) for n, x in ITEMS])) for k, t, _ in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert decontaminate.contamination(documents(spark, []), items).count() == 0
    none = decontaminate.contamination(documents(spark), items.limit(0))
    assert none.count() == len(ROWS) and all(r["starts"] == [] for r in none.collect())


def test_filters_leave_columns_of_any_name_alone(spark):
    items = spark.createDataFrame([("b", PASSAGE)], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = documents(spark)
    for kept in (decontaminate.without_contaminated(docs, items), toxicity.without_toxic(docs, labels), simhash.keep_one(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in ("row", "_row", "named", "hit", "scored", "place"))


def test_contaminated_rows_go(spark):
    items = spark.createDataFrame([("b", PASSAGE)], "item_id string, text string")
    kept = decontaminate.without_contaminated(documents(spark), items)
    assert kept.columns == documents(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(k) for k, t, _ in ROWS if not contamination(t, [("b", PASSAGE)])[4]
    )


def test_rows_are_judged_by_their_own_text(spark):
    """A contaminated or toxic row takes no other row of its key with it."""
    items = spark.createDataFrame([("b", PASSAGE)], "item_id string, text string")
    bad = PASSAGE + " you idiot"
    rows = [(None, bad, "en"), (None, "clean one", "en"), (5, bad, "en"), (5, "clean two", "en"), (6, None, "en"), (6, bad, "en"), (6, bad, "en")]
    docs = documents(spark, rows)
    expected = [(None, "clean one"), (5, "clean two"), (6, None)]
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for kept in (decontaminate.without_contaminated(docs, items), toxicity.without_toxic(docs, labels)):
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    text = np.concatenate([[0], *(np.append(rng.integers(1, 4, 50), 0) for _ in range(20))])
    index = FmIndex(text, 3, sample=5)
    phrases = np.array([text[i : i + 3] for i in range(1, 40) if 0 not in text[i : i + 3]])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        at = sorted(index.locate(np.arange(a, b)).tolist())
        assert at == [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]


def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append((i, f"alpha{i % 17} beta{i % 11} gamma " + ("you idiot and moron " if toxic else "") + f"delta{i % 5}", "en"))
        if i % 2 == 0:
            labels.append((i, int(toxic), "clash"))
    labels += [(None, 1, "x"), (3, None, "x"), (2, 0, "again")]
    return documents(spark, rows + ROWS[3:6]), spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    wrong = [r for r in got if r["score"] is None or (r["doc_id"] % 8 == 0 and r["doc_id"] < 400) != bool(r["predicted"])]
    assert len(wrong) <= 4
    # labels of held-out rows and other columns change nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity_scores(docs.withColumn("lang", F.lit("zz")), flipped).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity_scores(docs, labels.limit(0)).where("predicted = 1").count()
    assert got == 50
    assert toxicity.toxicity_scores(documents(spark, []), labels).count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_surrogates(spark):
    text = (
        "Dear Mrs. Maria Keller and Mr Smith Mrs Holm, call +49 171 5551234, card 4111-1111-1111-1111 or 4111111111111111, "
        "not 4111111111111112; A.B@X.ORG a.b@x.org 10.20.30.40 078-05-1120 Г-жа Анна Петрова version 3."
    )
    rows = [(1, text, "en"), (2, "a.b@x.org again", "en"), *ROWS[3:6], (None, "10.20.30.40", "en"), (2, "a.b@x.org again", "en")]
    docs = documents(spark, rows)
    out = surrogates.with_surrogates(docs)
    assert out.schema == docs.schema or out.columns == docs.columns
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r)
    first = by[1][0]["text"]
    for gone in ("Keller", "Smith", "171 555", "4111-1111", "4111111111111111", "a.b@x.org", "A.B@X.ORG", "10.20.30.40", "078-05-1120", "Петрова"):
        assert gone not in first
    assert "4111111111111112" in first and "version 3." in first
    address = by[2][0]["text"].split()[0]
    assert address in first and address.upper() in first and by[2][0]["text"] == by[2][1]["text"]
    assert by[None][0]["text"] in first
    dashed = next(w for w in first.replace(",", "").split() if w.count("-") == 3 and w[0] == "4")
    assert dashed.replace("-", "") in first
    assert first.split("Mrs. ")[1].split()[0] in surrogates.NAMES["latin", "f"]
    assert by[3][0]["text"] is None and by[4][0]["text"] == ""
    assert len(first) == by[1][0]["n_chars"]
    assert surrogates.with_surrogates(documents(spark, [])).count() == 0


def test_surrogates_differ(spark, monkeypatch):
    """With few names to choose from, replacements still differ, and none is a name of the corpus."""
    monkeypatch.setattr(surrogates, "SURNAMES", {"latin": ["Abel", "Berger", "Carver", "Dorn", "Ellis", "Falk"], "cyrillic": ["Белов"]})
    names = [f"N{chr(97 + i)}n" for i in range(20)] + ["Abel-Berger"]
    entities = spark.createDataFrame([("name", n, "m", 1) for n in names], "kind string, value string, gender string, n bigint")
    new = [r["new"] for r in surrogates.surrogate_table(entities, "k").collect()]
    assert len(set(new)) == len(names) and not set(new) & set(names)


def test_licences_beside_other_words(spark):
    """Whole licences, notices within long lines and headers, and texts that only speak of licences."""
    bsd, isc, mit = (f"Copyright (c) 2020, A Person\nAll rights reserved.\n\n{licences.WHOLE[n]}\n" for n in ("BSD-3-Clause", "ISC", "MIT"))
    texts = {
        "a/LICENSE": (bsd, "BSD-3-Clause", "own"), "b/COPYING": (isc, "ISC", "own"), "c/LICENSE.txt": (mit, "MIT", "own"),
        "a/x/y.py": ("print(1)", "BSD-3-Clause", "inherited"),
        "d/one": ("one two three four five six seven eight Released under the MIT License.", "MIT", "own"),
        "d/two": ("All sorts of words stand here. Released under the ISC License. " + "More words follow it here, unlike any other " * 9, "ISC", "own"),
        "d/three": ("x = 1\n" * 500 + "# SPDX-License-Identifier: GPL-3.0\n# copyright somebody\nanother license line here", "GPL-3.0", "own"),
        "d/four": ("To drive a car you need a license from the office in the town where you live", "none", "none"),
        "d/five": ("", "none", "none"), "d/six": (None, "none", "none"),
    }
    rows = [(i, path, t[0]) for i, (path, t) in enumerate(texts.items())]
    scan = licences.licence_scan(spark.createDataFrame(rows, "file_id int, path string, text string"), licences.template_table(spark))
    assert {r["path"]: (r["licence"], r["source"]) for r in scan.collect()} == {p: t[1:] for p, t in texts.items()}


def test_licences(spark, sf_dir):
    assert differences(licences.op10_licence_inheritance(spark, sf_dir), duck(sf_dir).execute(licences._sql())) == []
    mit = "Released under the MIT License."
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.py", "x = 1"), (3, "a/b/LICENSE.txt", mit),
        (4, "a/d.py", None), (5, "e.py", ""), (6, None, "x"), (7, "ab/f.py", "y"), (8, "a/b/g/h.py", "# " + mit + "\nz"), (8, "a/b/g/h/i.py", "z"),
    ]
    scan = licences.licence_scan(spark.createDataFrame(files, "file_id int, path string, text string"), licences.template_table(spark))
    got = {r["path"]: (r["licence"], r["source"]) for r in scan.collect()}
    assert got == {
        "a/LICENSE": ("Apache-2.0", "own"), "a/b/c.py": ("MIT", "inherited"), "a/b/LICENSE.txt": ("MIT", "own"), "a/d.py": ("Apache-2.0", "inherited"),
        "e.py": ("none", "none"), "": ("none", "none"), "ab/f.py": ("none", "none"), "a/b/g/h.py": ("MIT", "own"), "a/b/g/h/i.py": ("MIT", "inherited"),
    }
    assert licences.licence_scan(spark.createDataFrame([], "file_id int, path string, text string"), licences.template_table(spark)).count() == 0


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 700)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 10)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [None] * 24), (None, [1.0] * 24), (5400, [1.0, 2.0]), (5500, [])]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table.where("vec_id % 100 = 0"), table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[2] for f in found] == pytest.approx([d[f[1]] for f in found])
        hits += len({f[1] for f in found} & set(best))
    assert hits >= 0.9 * 300
    assert [f[1] for f in got[100]] == list(range(101, 111))
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0


def test_gradients():
    """Numerical slopes of the attention model."""
    rng = np.random.default_rng(0)
    p = {n: w.astype(float) for n, w in transformer.initial(np.ones(transformer.SLOTS)).items()}
    slots, targets = rng.integers(0, transformer.SLOTS, (2, 48))
    text, weight = np.repeat([0, 1], 24), np.ones(48)
    g = transformer.gradients(p, slots, text, targets, weight)

    def loss():
        u = transformer.attention(p, slots, text)["u"]
        c = targets // transformer.SIDE
        out = transformer.log_softmax(u @ p["classes"] + p["class_bias"])[np.arange(48), c]
        for k, rows in transformer.by_class(c):
            out[rows] += transformer.log_softmax(u[rows] @ p["tokens"][k] + p["token_bias"][k])[np.arange(len(rows)), targets[rows] % transformer.SIDE]
        return -out.mean()

    for name in ("embed", "query", "key", "value", "distance", "hidden", "classes"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept = p[name][at]
        p[name][at] = kept + 1e-3
        up = loss()
        p[name][at] = kept - 1e-3
        down = loss()
        p[name][at] = kept
        assert (up - down) / 2e-3 == pytest.approx(g[name][at], rel=0.05, abs=2e-4), name


def test_windows_do_not_see_the_future_or_other_texts():
    p = transformer.initial(np.ones(transformer.SLOTS))
    rng = np.random.default_rng(0)
    slots, targets = rng.integers(0, transformer.SLOTS, (2, 100))
    text = np.repeat([0, 1], 50)
    whole = transformer.log_probabilities(p, slots, text, targets)
    changed = slots.copy()
    changed[70:] = 1
    assert transformer.log_probabilities(p, changed, text, targets)[:70] == pytest.approx(whole[:70], abs=1e-4)
    alone = transformer.log_probabilities(p, slots[:50], text[:50], targets[:50])
    assert alone == pytest.approx(whole[:50], abs=1e-4)


def test_language_scores(spark):
    rows = ROWS + [(100 + i, f"one two three four five {i % 7} six seven", "en") for i in range(300)]
    got = attention.language_scores(documents(spark, rows), tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for k, t, _ in rows:
        if k is None or zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update((t or "").encode().lower().split() + [None])
    total, distinct = sum(counts.values()), len(counts)
    texts = {k: t for k, t, _ in rows}
    for r in got:
        words = (texts[r["doc_id"]] or "").encode().lower().split() + [None]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert attention.language_scores(documents(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_words_name_their_blocks(spark):
    """Each word once, with its count and all its blocks; the documents' words come from these without a join."""
    docs = [(i, f"all w{i % 5} W{i}", "en") for i in range(60)]
    rows = attention.prepared(documents(spark, docs), "doc_id", "text", 4).repartition(3).cache()
    words = attention.word_table(attention.word_pairs(rows), tokenizer_path("byte_bpe_50k.json"))
    counts, blocks = Counter(), {}
    for r in rows.collect():
        for w in r["text"].lower().encode().split():
            counts[w] += not r["held_out"]
            blocks.setdefault(w, set()).add(r["block"])
    got = words.collect()
    assert {bytes(r["word"]): (r["n"], sorted(r["blocks"])) for r in got} == {w: (counts[w], sorted(b)) for w, b in blocks.items()}
    assert len(got) == len(blocks) and len(blocks[b"all"]) == 4
    found = attention.encoded(rows, words, 100, 10, 48)
    assert {r["key"]: r["n_tokens"] for r in found.collect()} == {i: 4 for i in range(60)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    rows.unpersist()


def test_training_windows_cover_all_ids(spark):
    """Each id of each training document is the target of one window, after the slot before it."""
    ids = {k: np.append(np.arange(n) * 7 % 5000, attention.END).astype("<u2") for k, n in ((1, 0), (2, 47), (3, 48), (4, 60_000))}
    rows = [(k, k == 2, x.tobytes()) for k, x in ids.items()]
    documents = spark.createDataFrame(rows, "key int, held_out boolean, ids binary")
    slots = attention.Slots(np.arange(attention.VOCABULARY))
    found = attention.training_windows(documents, slots)
    dealt = [np.frombuffer(r["windows"], "<i2") for r in attention.dealt_windows(found).collect()]
    got = np.concatenate(dealt).reshape(-1, attention.WINDOW + 1)
    expected = Counter()
    for k, x in ids.items():
        before = slots.of[np.append(attention.END, x)].tolist()
        for i in range(0, len(x) if k != 2 else 0, attention.WINDOW):
            one = before[i : i + attention.WINDOW + 1]
            expected[tuple(one + [-1] * (attention.WINDOW + 1 - len(one)))] += 1
    assert Counter(map(tuple, got.tolist())) == expected
    assert (got[:, 1:] >= 0).sum() == sum(len(x) for k, x in ids.items() if k != 2)


def test_pipeline(spark, sf_dir):
    """Each stage takes what the one before kept; the last has a row for each document that is left."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns, name
        assert after.count() <= docs.count() and after.select("doc_id").distinct().count() == after.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()
