"""Secrets in texts: three patterns, and the strings that a primed compressor can't foresee in a sensitive place.

Base kinds are matched from left to right without overlaps, and matches that are too short are dropped afterwards:
`assign` (a name, = or :, a value), `access` (AKIA...) and `hex`. The method adds the kind `novel`: every long run of
key characters that follows a sensitive word within REACH characters and isn't part of a base match is a candidate. Its
marginal cost is the size of the surrounding text with it less the size without it, both compressed by zstandard with
a dictionary of the corpus's own identifiers. What the surroundings or the identifiers hold already costs next to
nothing, words cost about half a byte a character, a key of random characters most of a byte; a candidate is reported
from NOVELTY bytes a character on.

The dictionary is counted over all documents: words of letters and _ by the number of documents that hold them, the
most frequent DICTIONARY ones of those that a thousandth of the documents, and three at least, hold. It has
DICTIONARY * LONGEST bytes at most; words with digits are left out, as copied keys would be learned.

Spans are (kind, start, end) of whole matches in code points, end exclusive.

Cases: a null text is empty and has no spans; repeated rows each come out; ties of starts go by kind in the order of
KINDS; a very long text is scanned as a whole, and each candidate measured within WINDOW characters on either side;
an empty table gives an empty result and an empty dictionary; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import as_before, as_text, table, text_of

KINDS = ("assign", "access", "hex", "novel")
#: Pattern, the group whose length counts, and the least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
# Words that make a place sensitive.
SENSITIVE = re.compile(
    "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private|credential|auth|bearer|signature|session|cookie|login",
    re.A | re.I,
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])|(?=.*[a-z])(?=.*[A-Z])")
REACH, WINDOW, NOVELTY = 48, 512, 0.6
DICTIONARY, SHORTEST, LONGEST = 4096, 4, 24


def identifiers(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The words of the dictionary, the most frequent last, where a match with them is cheapest; DICTIONARY at most."""
    words = F.filter(
        F.array_distinct(F.split(text_of(text_col), "[^A-Za-z_]+")), lambda w: (F.length(w) >= SHORTEST) & (F.length(w) <= LONGEST)
    )
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    least = max(3, -(-docs.count() // 1000))
    most = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(DICTIONARY)
    return [r.word for r in most.collect()][::-1]


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """One per worker process and dictionary."""
    options = {"level": 3, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**options)
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=primed, **options)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches that are long enough, by start and kind."""
    found = [
        (m.start(), KINDS.index(kind), m.end())
        for kind, (pattern, group, least) in BASE.items()
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]
    return [(start, end, KINDS[k]) for start, k, end in sorted(found)]


def marginal_bytes(text: str, start: int, end: int, compressor: zstandard.ZstdCompressor) -> int:
    """Bytes that text[start:end] adds to its surroundings when they are compressed."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    size = lambda *parts: len(compressor.compress("".join(parts).encode("utf-8", "replace")))
    return size(before, text[start:end], after) - size(before, after)


def novel_spans(text: str, base: list[tuple[int, int, str]], compressor: zstandard.ZstdCompressor) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates that nothing around them foretells."""
    places = [m.end() for m in SENSITIVE.finditer(text)]
    if not places:
        return []
    taken = sorted((start, end) for start, end, _ in base)
    out, place, span = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while place < len(places) and places[place] <= start:
            place += 1
        while span < len(taken) and taken[span][1] <= start:
            span += 1
        if not place or start - places[place - 1] > REACH or not MIXED.match(m[0]):
            continue
        if any(s < end and start < e for s, e in taken[span : span + len(KINDS)]):
            continue
        if marginal_bytes(text, start, end, compressor) >= NOVELTY * (end - start):
            out.append((start, end, "novel"))
    return out


def spans(text: str, compressor: zstandard.ZstdCompressor) -> list[tuple[int, int, str]]:
    """All spans of a text, by start and kind."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, compressor), key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame, words: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row. words: the dictionary; counted from docs if not given."""
    dictionary = " ".join(identifiers(docs, text_col) if words is None else words).encode()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressor = _compressor(dictionary)
        for pdf in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t, compressor)] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": found})

    rows = docs.select(as_text(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    found = rows.mapInPandas(work, "doc_id string, spans array<struct<kind: string, start: long, end: long>>")
    return as_before(found, docs, "doc_id", id_col)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number of base spans of each kind, digest of the base spans, and all spans as text."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
