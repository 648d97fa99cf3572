"""BPE and token files against the tokenizers library, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import ROWS, documents
from tokenizers import Tokenizer

from flowspark.llm import bpe, token_files
from flowspark.session import work_path

WORDS, BYTES = bpe.tokenizer_path("word_bpe_49k.json"), bpe.tokenizer_path("byte_bpe_50k.json")
POOL = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0x85, 0x1C, 0xA0, 0x3A3, 0x130, 0xDF, 0xFB01, 0x301, 0x4E2D, 0x1F600, 0x2028, 0x660, 0xB2, 0x212B]]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*POOL, "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "\n\n", " ", "the", "ing"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)] + ["a" * 3000, "ab" * 999, "x" * 100, "the" * 400]


def test_forced_boundaries_equal_the_library():
    library, own = Tokenizer.from_file(WORDS), bpe.encoder(WORDS)
    for text in odd_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        packed, decoded = own.both(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids == own.encode(text)
        assert decoded == library.decode(ids, skip_special_tokens=False) == own.decode(ids)


def test_no_token_crosses_a_cut():
    own = bpe.encoder(WORDS)
    for word in ("ththerheons", "xqzjk", "straße"):
        assert "".join(f for f, _ in own.fragments(word)) == "".join(own.printable[b] for b in word.encode())


def test_encoding_digests(spark):
    library = Tokenizer.from_file(WORDS)
    got = sorted(tuple(map(str, r)) for r in bpe.encoding_digests(documents(spark), WORDS).collect())
    expected = []
    for k, t, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, "<u4").tobytes()
        expected.append(tuple(map(str, (k, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))))
    assert got == sorted(expected)
    assert bpe.encode_texts(documents(spark, []), WORDS).count() == 0


def test_pretokens_equal_the_library(monkeypatch):
    library = Tokenizer.from_file(BYTES)
    for kept in (50, 400_000):
        monkeypatch.setattr(token_files, "CACHED", kept)
        own = token_files.Pretokens(BYTES)
        for text in odd_texts(1500, kept):
            assert np.frombuffer(own.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_variable_length_code():
    for n in range(9):
        values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7, 1], np.int64)[:n]
        assert token_files.decode_block(*token_files.encode_block(values), n).tolist() == values.tolist()


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_token_files(spark, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    library = Tokenizer.from_file(BYTES)
    rows, ranks = token_files.token_files(documents(spark), BYTES, work_path(spark, "token-test"))
    got = rows.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    lengths, expected = {}, []
    for k, t, _ in ROWS:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected.append((-1 if k is None else k, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(expected)
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert sorted(ranks.tolist()) == list(range(1 << 16))


def test_no_documents(spark):
    rows, _ = token_files.token_files(documents(spark, []), BYTES, work_path(spark, "token-none"))
    assert rows.count() == 0


def test_pretokens_that_a_worker_keeps():
    own = token_files.Pretokens(BYTES, 20)
    words = [f"{c}{d}x" for c in "abcdefghij" for d in "klmnopqrst"]
    for word in words:
        own.encode(f"{word} {'z' * 5000}")
    assert len(own.known) <= 22 and len(own.known.older) <= 22
    assert max(map(len, [*own.known, *own.known.older])) <= token_files.CACHED_LENGTH
    library = Tokenizer.from_file(BYTES)
    for word in ["é", "\x00", "'ll", "中", " \n", "\xad"]:
        assert np.frombuffer(own.ids_of(word), "<u2").tolist() == library.encode(word, add_special_tokens=False).ids


def test_pretokens_within_the_larger_store_are_learnt_once():
    learnt = []
    known = token_files.Known(lambda w: learnt.append(w) or b"")
    for _ in range(2):
        for start in range(0, 500_000, 100_000):
            known.turn()
            for i in range(start, start + 100_000):
                known[str(i)]
    assert len(learnt) == 500_000
