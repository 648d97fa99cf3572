"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring symbols that stands inside no token of the vocabulary can never be merged across, so every
such pair in a word is a certain cut. The fragments between cuts are encoded on their own and their ids joined;
merges are chosen by rank within a fragment only. Words and fragments repeat, so both are kept per Python worker.

The vocabulary is a public tokenizer file whose path is a parameter: BPE over byte symbols with an end-of-word mark,
NFC and lower case, words by a pattern. Strings of its special tokens in a text become those tokens.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, sha256_hex, table
from .registry import query

#: Words kept per worker, and the longest word (in characters) that is kept.
CACHED_WORDS, CACHED_LENGTH = 600_000, 64
#: Fragments of up to so many symbols are merged by scanning, longer ones with a heap.
SCANNED = 64
#: Rank of a pair that no merge joins.
NONE = 1 << 30

#: Letters, numbers and white space up to U+024F, so that texts within it can use the faster of two pattern engines.
LETTERS, NUMBERS, SPACE = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ\u0100-\u024f", "0-9²³¹¼-¾", " \\t-\\r\x85\xa0"
BEYOND = re.compile("[^\x00-\u024f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder for one tokenizer file.

    ``encode`` takes any string, the empty one included; ``decode`` joins token strings with a space, as the library
    does for a file without a decoder.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = model["vocab"] | special
        self.tokens = {i: t for t, i in vocabulary.items()}
        self.packed = {t: struct.pack("<I", i) for t, i in vocabulary.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        near = pattern.replace(r"[\p{L}]", f"[{LETTERS}]").replace(r"[\p{N}]", f"[{NUMBERS}]")
        near = near.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{LETTERS}{NUMBERS}]")
        self.near_words = re.compile(near) if r"\p" not in near and r"\s" not in near else None
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.printable = dict(enumerate(byte_symbols()))
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(merges)}
        #: Pairs of symbols that stand side by side inside some token; all others are cuts.
        self.inside = set()
        for token in model["vocab"]:
            parts = self._parts(token)
            self.inside.update(zip(parts, parts[1:]))
        self.word_ids: dict[str, bytes] = {}
        self.word_text: dict[str, str] = {}
        #: Of fragments inside a word, and of those at its end.
        self.fragment_ids: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _parts(self, token: str) -> list[str]:
        """The byte symbols of a token, the last one with its end-of-word mark if there is one."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return [*token[:-1], token[-1] + self.suffix]
        return list(token)

    def segments(self, text: str):
        """(is special, string) in order; ordinary ones normalised."""
        pieces = self.specials.split(text) if self.specials else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                yield True, piece
            elif piece:
                # character by character, so without the final form of sigma
                yield False, unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    def fragments(self, word: str) -> list[tuple[str, bool]]:
        """(symbols, ends the word) of each fragment: cut where a pair occurs in no token."""
        text = word.encode("utf-8").decode("latin-1").translate(self.printable)
        last = len(text) - 1
        pairs = zip(text[: last - 1], text[1:last]) if last > 1 else ()
        cuts = [i for i, pair in enumerate(pairs, 1) if pair not in self.inside]
        if last and (text[last - 1], text[last] + self.suffix) not in self.inside:
            cuts.append(last)
        edges = [0, *cuts, last + 1]
        return [(text[i:j], j > last) for i, j in zip(edges, edges[1:])]

    def merge(self, fragment: str, final: bool) -> list[str]:
        """The fragment's tokens: the pair of lowest rank, leftmost first, until none is left."""
        parts = list(fragment)
        if final:
            parts[-1] += self.suffix
        if len(fragment) > SCANNED:
            return self._merge_long(parts)
        rank_of = self.ranks.get
        found = [rank_of(pair, NONE) for pair in zip(parts, parts[1:])]
        while found and (rank := min(found)) != NONE:
            i = found.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = rank_of((parts[i], parts[i + 1]), NONE)
            if i:
                found[i - 1] = rank_of((parts[i - 1], parts[i]), NONE)
        return parts

    def _merge_long(self, parts: list[str | None]) -> list[str]:
        """As ``merge``, in n log n: a heap of pairs over a linked list."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or j >= n or parts[j] is None or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, k))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, i))
        return [p for p in parts if p is not None]

    def _learn(self, word: str) -> tuple[bytes, str]:
        packed = b""
        for fragment, final in self.fragments(word):
            known = self.fragment_ids[final].get(fragment)
            if known is None:
                known = b"".join([self.packed[t] for t in self.merge(fragment, final)])
                if len(fragment) <= CACHED_LENGTH:
                    self.fragment_ids[final][fragment] = known
            packed += known
        text = " ".join([self.tokens[i] for i in struct.unpack(f"<{len(packed) // 4}I", packed)])
        if len(word) <= CACHED_LENGTH:
            if len(self.word_ids) >= CACHED_WORDS:
                self.word_ids.clear()
                self.word_text.clear()
                for known in self.fragment_ids:
                    known.clear()
            self.word_ids[word], self.word_text[word] = packed, text
        return packed, text

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids of a text as little-endian 32-bit integers, and the text decoded from them."""
        packed, decoded = [], []
        for is_special, segment in self.segments(text):
            if is_special:
                packed.append(self.packed[segment])
                decoded.append(segment)
                continue
            near = self.near_words is not None and not BEYOND.search(segment)
            words = (self.near_words if near else self.words).findall(segment)
            try:
                p, d = list(map(self.word_ids.__getitem__, words)), list(map(self.word_text.__getitem__, words))
            except KeyError:
                learnt = [
                    (self.word_ids[w], self.word_text[w]) if w in self.word_ids else self._learn(w) for w in words
                ]
                p, d = [x[0] for x in learnt], [x[1] for x in learnt]
            packed += p
            decoded += d
        return b"".join(packed), " ".join(decoded)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.both(text)[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """Special tokens are kept; an id outside the vocabulary gives nothing."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryBpe:
    """One encoder per file and Python worker."""
    return ForcedBoundaryBpe(path)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array, decoded text); a null text counts as empty, repeated rows are kept."""

    def make():
        bpe = encoder(path)

        def one(t: str):
            packed, decoded = bpe.both(t)
            return np.frombuffer(packed, "<u4").astype("int32"), decoded

        return one

    return map_texts(docs, make, "ids array<int>, decoded string", key, text)


def encoding_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row; null and empty texts have no tokens.

    Rows are independent and stay where they are: no shuffle, whatever the key looks like, and a lost task is redone
    from its input alone.
    """

    def make():
        bpe = encoder(path)

        def one(t: str):
            packed, decoded = bpe.both(t)
            return len(packed) // 4, sha256_hex(packed), sha256_hex(decoded.encode("utf-8"))

        return one

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", key, text)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op3_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encoding_digests(docs, tokenizer_path("word_bpe_49k.json"))
