"""Packing of token pieces into sequences of fixed length, bounded-space and online.

Each partition keeps at most WINDOWS open windows. Whole sequences are cut off long documents; the remainder goes
to the window that it fits best. When none fits and all windows are open, the fullest is emitted; if its gap is at
least MIN_CUT ids, the piece's head fills it first. Windows still open at a partition's end travel on with their
ids and are packed again, FAN partitions at a time, until one group is left, whose last windows are filled one
after the other. So a task never holds more than FAN * WINDOWS windows, and only the last sequence of all is short
by more than a small gap.

Cases: a null or empty text is the one end id; very long texts are encoded in blocks; repeated rows and ids are
packed each for itself; a null id is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import WORD, blocks, encoder
from lodestar.llm.common import as_before, as_text, give_back, table
from lodestar.session import materialize

LENGTH = 1024
WINDOWS = 16
MIN_CUT = 8
FAN = 16

_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class FileEncoder:
    """Ids of whole texts by the vocabulary of a tokenizers file, with add_special_tokens=False.

    The compiled encoder of tiktoken is given the file's vocabulary: its ids are those of the tokenizers library, at a
    third of the cost. Its pattern engine gives up on very long runs of white space; such a block is encoded by the
    dynamic programme of this subpackage, which is exact too."""

    def __init__(self, path: str):
        vocabulary, self.exact = encoder(path)
        self.special = vocabulary.special
        marks = set(self.special.values())
        ranks = {raw: i for i, raw in vocabulary.bytes_of.items() if i not in marks}
        self.fast = tiktoken.Encoding("file", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def _part(self, text: str) -> np.ndarray:
        if text in self.special:
            return np.array([self.special[text]], "u4")
        try:
            return np.array(self.fast.encode_ordinary(text), "u4")
        except BaseException as error:  # a panic of the compiled code is no Exception
            if type(error).__name__ != "PanicException":
                raise
            return np.frombuffer(self.exact.ids([text])[0], "<u4")

    def ids(self, text: str | None) -> np.ndarray:
        parts = self.marks.split(text) if text and self.marks.search(text) else [text or ""]
        found = [self._part(b) for p in parts if p for b in ([p] if p in self.special else blocks(p))]
        return found[0] if len(found) == 1 else np.concatenate([np.empty(0, "u4"), *found])


@cache
def file_encoder(path: str) -> FileEncoder:
    """One per worker process."""
    return FileEncoder(path)


class Packer:
    """Open windows of one task. Rows are (doc_id, start, length, crc, doc_tokens, sequence, offset, part, ids); part
    is -1 for placed pieces, else the group that packs the piece on."""

    def __init__(self, base: int, length: int, windows: int):
        self.base, self.length, self.windows = base, length, windows
        self.made = 0
        self.open: list[list] = []  # [ids used, pieces]
        self.rows: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        n = self.length
        for at in range(0, len(ids) - n + 1, n):
            self.emit([n, [(doc_id, start + at, ids[at : at + n], total)]])
        at = len(ids) // n * n
        while at < len(ids):
            rest = len(ids) - at
            fits = [w for w in self.open if n - w[0] >= rest]
            if fits:
                window = max(fits, key=lambda w: w[0])
                take = rest
            elif len(self.open) < self.windows:
                self.open.append(window := [0, []])
                take = rest
            else:
                window = max(self.open, key=lambda w: w[0])
                take = n - window[0] if n - window[0] >= MIN_CUT else 0
            if take:
                window[1].append((doc_id, start + at, ids[at : at + take], total))
                window[0] += take
                at += take
            if take < rest and at < len(ids) or window[0] == n:
                self.open = [w for w in self.open if w is not window]
                self.emit(window)

    def emit(self, window: list) -> None:
        offset, sequence = 0, self.base + self.made
        for doc_id, start, ids, total in window[1]:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, sequence, offset, -1, None))
            offset += len(ids)
        self.made += 1

    def pass_on(self, part: int) -> None:
        for _, pieces in self.open:
            for doc_id, start, ids, total in pieces:
                self.rows.append((doc_id, start, len(ids), 0, total, -1, -1, part, ids.astype("<u4").tobytes()))
        self.open = []

    def finish(self) -> None:
        """Fill the last windows one after the other, cutting at their ends."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        last = [0, []]
        for doc_id, start, ids, total in pieces:
            while len(ids):
                take = min(len(ids), self.length - last[0])
                last[1].append((doc_id, start, ids[:take], total))
                last[0] += take
                start, ids = start + take, ids[take:]
                if last[0] == self.length:
                    self.emit(last)
                    last = [0, []]
        if last[0]:
            self.emit(last)
        self.open = []

    def frame(self) -> pd.DataFrame:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=names)


def pack(
    docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, end = file_encoder(path), np.array([end_id], "u4")
        task = TaskContext.get().partitionId()
        packer = Packer(task << 32, length, windows)
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                own = np.concatenate((texts.ids(text), end))
                packer.add(doc_id, 0, own, len(own))
            yield packer.frame()
        packer.pass_on(task // FAN)
        yield packer.frame()
        give_back()

    def again(level: int, last: bool):
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            part = int(pdf["part"].iloc[0])
            packer = Packer((level << 57) + (part << 32), length, windows)
            for r in pdf.sort_values(["doc_id", "start", "doc_tokens"]).itertuples():
                packer.add(r.doc_id, r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens)
            packer.finish() if last else packer.pass_on(part // FAN)
            return packer.frame()

        return work

    schema = f"doc_id string, {_PIECE}"
    rows = docs.select(as_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(rows.mapInPandas(first, schema), "packed")
    placed = [found.where("part < 0")]
    for level in range(1, 32):
        open_ = found.where("part >= 0")
        parts = open_.agg(F.max("part").alias("most")).first().most
        if parts is None:
            break
        found = materialize(open_.groupBy("part").applyInPandas(again(level, parts == 0), schema), "packed")
        placed.append(found.where("part < 0"))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return as_before(out.drop("part", "ids"), docs, "doc_id", id_col)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
