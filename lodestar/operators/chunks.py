"""Cutting long texts into chunks for storing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Where a long paragraph may be cut, best last.
ENDS = ("。", "．", ". ", "\n", " ")


def cut_long(text: str, most: int) -> list[str]:
    """Pieces of at most most bytes, cut after the last end of a sentence, line or word, else anywhere."""
    out = []
    while len(text.encode()) > most:
        head = text.encode()[:most].decode("utf-8", "ignore")
        at = next((head.rfind(e) + len(e) for e in ENDS if head.rfind(e) > 0), len(head))
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [x for x in (*out, text) if x]


def chunk(text: str | None, most: int) -> list[str]:
    """Paragraphs packed in order into chunks of at most most bytes."""
    out, open_ = [], ""
    for paragraph in (p.strip() for p in (text or "").split("\n\n")):
        if not paragraph:
            continue
        for part in cut_long(paragraph, most):
            if open_ and len(open_.encode()) + len(part.encode()) + 2 > most:
                out.append(open_)
                open_ = ""
            open_ = f"{open_}\n\n{part}" if open_ else part
    return [*out, open_] if open_ else out


def chunks(docs: DataFrame, most: int = 1000) -> DataFrame:
    """doc_id, at, chunk of every document; an empty text has none."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t, most))

    return docs.select("doc_id", F.posexplode(cut("text")).alias("at", "chunk"))
