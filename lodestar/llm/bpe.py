"""Byte-level BPE: exact encoding by per-prefix dynamic programming, and decoding.

An automaton over the vocabulary with suffix links reports, for every prefix of a word, the tokens that end there.
BPE's encoding of a prefix ends in exactly one of them: the one that is compatible with the stored last token of
the prefix before it. Storing that token per prefix and following the back-pointers from the end gives the ids that
merging would give, in time linear in the word, whatever its length. Two tokens are compatible if undoing the
youngest merges beside their seam, one after the other, never uncovers a pair that would have merged earlier.

Words repeat, so bounded caches hold the ids of words, and of the stretches between single spaces, across which no
word of the pre-tokenizer can reach.

Cases: a null text is empty and has no ids; the special token's string in a text becomes its id, as the library
does by default; texts of any length are taken in blocks, and a single word of any length in one linear pass; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import as_before, as_text, table

#: Fixed value: the pre-tokenizer's pattern.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block of a long text, and stretches that a cache holds.
BLOCK = 1 << 20
CACHE = 400_000

_MARKS = frozenset(".,")
_word = regex.compile(WORD)
_beside_space = re.compile(r"\s | \s")
_single_space = re.compile(r"(?<=\S) (?=\S)")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in blocks of about size; each but the first begins with a space between two characters that aren't
    white space, where the pre-tokenizer always parts words."""
    at = 0
    while len(text) - at > size:
        cut = _single_space.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pre_tokens(text: str) -> tuple[str, ...] | list[str]:
    """The pre-tokenizer's words of a stretch; most are one word, with a mark or without."""
    if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
        return (text,)
    if text[-1:] in _MARKS and text[1:-1].isalpha() and (text[0] == " " or text[0].isalpha()):
        return (text[:-1], text[-1])
    return _word.findall(text)


class StretchEncoder:
    """Ids (little-endian unsigned 32-bit, as bytes) of whole texts, from a function that encodes words."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], special: dict[str, int]):
        self.encode, self.special = encode, special
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}  # stretch after a space -> ids, with the space
        self.words: dict[str, bytes] = {}  # word of the pre-tokenizer -> ids

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        out: list[list[bytes]] = []
        waiting: list[tuple[list[bytes], str, list[str]]] = []
        size = 0
        for text in texts:
            out.append(parts := [])
            if not text:
                continue
            for part in self.marks.split(text) if self.marks and self.marks.search(text) else [text]:
                if part in self.special:
                    self._flush(waiting)
                    size = 0
                    parts.append(self.special[part].to_bytes(4, "little"))
                elif part:
                    for block in blocks(part):
                        waiting.append((parts, *self._stretches(block)))
                        size += len(block)
                        if size > BLOCK:
                            self._flush(waiting)
                            size = 0
        self._flush(waiting)
        return [b"".join(parts) for parts in out]

    def _stretches(self, text: str) -> tuple[str, list[str]]:
        """The first stretch, and those that follow a single space."""
        if text[0] == " " or text[-1] == " " or _beside_space.search(text):
            first, *rest = _single_space.split(text)
        else:
            first, *rest = text.split(" ")
        return first, rest

    def _flush(self, waiting: list[tuple[list[bytes], str, list[str]]]) -> None:
        if not waiting:
            return
        new = set().union(*(rest for _, _, rest in waiting))
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
        new = list(new - self.known.keys())
        self.known.update(zip(new, self._encode([" " + x for x in new])))
        for (parts, _, rest), first in zip(waiting, self._encode([first for _, first, _ in waiting])):
            parts.append(first)
            parts += map(self.known.__getitem__, rest)
        waiting.clear()

    def _encode(self, stretches: list[str]) -> list[bytes]:
        parted = list(map(pre_tokens, stretches))
        new = set().union(*parted)
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
        new = list(new - self.words.keys())
        self.words.update(zip(new, self.encode(new)))
        return [b"".join(map(self.words.__getitem__, words)) for words in parted]


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, with the automaton and the tests that encoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        byte_of = {c: b for b, c in shown.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t.encode() for t, i in self.special.items()}
        marks = set(self.special.values())
        self.size = [0] * (max(model["vocab"].values()) + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in model["vocab"].items():
            if i not in marks:
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
                self.size[i] = len(token)
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left part, right part
        for at, (left, right) in enumerate(model["merges"]):
            a, b = ids[left], ids[right]
            self.rank[a, b] = at
            self.made.setdefault(ids[left + right], (at, a, b))
        self.tested: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether token a followed by token b is what merging their joint bytes gives."""
        if len(self.tested) >= CACHE:
            self.tested.clear()
        known = self.tested[a << 20 | b] = self._holds(a, b)
        return known

    def _holds(self, a: int, b: int) -> bool:
        base = (-1, 0, 0)
        before = len(self.rank)
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            left, right = self.made.get(a, base), self.made.get(b, base)
            if left[0] < 0 and right[0] < 0:
                return True
            if left[0] > right[0]:
                before, a = left[0], left[2]
            else:  # equal merges go from left to right, so one across the seam would come before b's own
                before, b = right[0] + 1, right[1]

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        raw = word.encode("utf-8", "replace")
        last = [-1] * len(raw)  # per prefix: its last token
        size, tested = self.size, self.tested
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            if last[end] < 0:
                start = end - size[token]
                if start < 0:
                    last[end] = token
                else:
                    fits = tested.get(last[start] << 20 | token)
                    if fits is None:
                        fits = self.compatible(last[start], token)
                    if fits:
                        last[end] = token
        out, at = array("I"), len(raw) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out.tobytes()

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def encoder(path: str) -> tuple[Vocabulary, StretchEncoder]:
    """One per worker process."""
    vocabulary = Vocabulary(path)
    return vocabulary, StretchEncoder(lambda words: list(map(vocabulary.encode_word, words)), vocabulary.special)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with keep also ids (binary) and decoded."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, texts = encoder(path)
        for pdf in batches:
            ids = texts.ids(pdf["text"])
            decoded = [vocabulary.decode(x) for x in ids]
            out = {
                "doc_id": pdf["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
            }
            yield pd.DataFrame(out | ({"ids": ids, "decoded": decoded} if keep else {}))

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    rows = docs.select(as_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return as_before(rows.mapInPandas(work, schema), docs, "doc_id", id_col)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
