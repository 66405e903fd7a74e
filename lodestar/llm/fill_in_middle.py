"""Fill-in-the-middle documents, cut at token boundaries that a learned rank index finds.

A text's tokens are runs of ASCII letters and single other characters. The index of a text learns where its boundaries
lie: a greedy cone fits straight segments to (rank, offset), each as long as no boundary is further than ERROR from it,
and every boundary keeps the byte by which the segment misses it. An offset is then looked up in three steps, without
another look at the text: find the segment of the rank, predict, add the stored residual. Segments have integer slopes
(in 2**-16 characters), so Python and the JVM predict the same.

The index takes a byte a token and a few numbers a segment; a text is read in blocks of BLOCK characters, so building
it needs little more than that, whatever the length of the text. Python makes the index; cuts, forms, outputs and the
way back are Column expressions, and nothing is shuffled.

Cases: a null text is empty, and plain; a null id counts as an empty one where cuts are drawn, and stays null; repeated
rows each come out; ties of the two cuts give an empty middle; very long texts are indexed by blocks; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table, text_of

#: The furthest that a boundary may be from its segment, with two to spare for rounding in a signed byte.
ERROR = 125
#: Code points that are read at once, and ranks of a segment: the slope's rounding stays below one.
BLOCK = 1 << 20
LONGEST = 1 << 16
SCALE = 16

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

INDEX = "struct<n: long, starts: array<long>, bases: array<long>, slopes: array<long>, residuals: binary>"


def boundaries(text: str) -> Iterator[np.ndarray]:
    """Offsets at which tokens start, block by block, and behind the last its end."""
    before = False
    for at in range(0, max(len(text), 1), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = (codes | 32) - np.uint32(97) < 26
        inside = letter & np.concatenate(([before], letter[:-1])) if len(letter) else letter
        before = bool(letter[-1]) if len(letter) else False
        offsets = np.flatnonzero(~inside) + at
        yield np.append(offsets, len(text)) if at + BLOCK >= len(text) else offsets


def segments(offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, end, slope) of segments that stay within ERROR of all their points, by a cone that shrinks point by point."""
    first, count, width = 0, len(offsets), 512
    while first < count:
        low, high, end = -np.inf, np.inf, first + 1
        while end < min(count, first + LONGEST):
            stop = min(count, first + LONGEST, end + width)
            run, rise = np.arange(end - first, stop - first), offsets[end:stop] - offsets[first]
            lows = np.maximum.accumulate(np.maximum((rise - ERROR) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + ERROR) / run, high))
            fits = int(np.searchsorted(lows - highs, 0, side="right"))  # the gap only grows
            if fits:
                low, high, end = lows[fits - 1], highs[fits - 1], end + fits
            if end < stop:
                break
        yield first, end, 0 if end == first + 1 else int((low + high) / 2 * (1 << SCALE))
        first = end


def fit(text: str) -> dict:
    """The rank index of one text: its number of tokens, segments, and a residual byte for each of n + 1 boundaries."""
    starts, bases, slopes, residuals, rank = [], [], [], [], 0
    for offsets in boundaries(text):
        for first, end, slope in segments(offsets):
            predicted = offsets[first] + (np.arange(end - first) * slope >> SCALE)
            starts.append(rank + first)
            bases.append(int(offsets[first]))
            slopes.append(slope)
            residuals.append((offsets[first:end] - predicted + 128).astype(np.uint8))
        rank += len(offsets)
    return {"n": rank - 1, "starts": starts, "bases": bases, "slopes": slopes, "residuals": b"".join(map(bytes, residuals))}


def _fit_all(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fit(t) for t in texts], columns=["n", "starts", "bases", "slopes", "residuals"])


def rank_index(text: Column) -> Column:
    """The rank index of every text, a struct as INDEX says."""
    return F.pandas_udf(_fit_all, INDEX)(text)


def rank_offset(index: Column, rank: Column) -> Column:
    """Offset in code points of the boundary of that rank (0 to n): prediction of its segment, and the residual."""
    at = F.size(F.filter(index["starts"], lambda s: s <= rank))
    predicted = F.element_at(index["bases"], at) + F.shiftright((rank - F.element_at(index["starts"], at)) * F.element_at(index["slopes"], at), SCALE)
    residual = F.conv(F.hex(F.substring(index["residuals"], rank.cast("int") + 1, F.lit(1))), 16, 10).cast("long") - 128
    return predicted + residual


def _drawn(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th number from 0 to 2**32 - 1 that belongs to an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: its three parts, put back in order."""
    second, third = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    at = F.position(second, output)
    end = F.position(third, output, at)
    one = F.substring(output, F.lit(len(SUFFIX) + 1), at - len(SUFFIX) - 1)
    two = F.substring(output, at + len(SUFFIX), end - at - len(SUFFIX))
    middle = F.substring(output, end + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, changed: int = 90, spm: int = 20
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row. changed: percent of texts that aren't left plain;
    spm: percent of those that have the suffix first."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    draw = lambda k: _drawn(F.col("doc_id"), seed, k)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (draw(3) % 100 >= changed)
    indexed = rows.withColumn("index", rank_index(F.col("text")))
    one, two = (draw(k) % (F.col("index.n") + 1) for k in (1, 2))
    index = F.col("index")
    cut = indexed.select(
        "doc_id",
        "text",
        F.col("index.n").alias("n"),
        F.when(plain, "plain").when(draw(4) % 100 < spm, "spm").otherwise("psm").alias("form"),
        rank_offset(index, F.least(one, two)).alias("a"),
        rank_offset(index, F.greatest(one, two)).alias("b"),
    )
    part = lambda first, size: F.substring("text", (first + 1).cast("int"), size.cast("int"))
    prefix, middle = part(F.lit(0), F.col("a")), part(F.col("a"), F.col("b") - F.col("a"))
    suffix = part(F.col("b"), F.length("text"))
    p, s, m = map(F.lit, (PREFIX, SUFFIX, MIDDLE))
    form = F.col("form")
    output = F.when(form == "plain", F.col("text")).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle))
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.when(form != "plain", F.col("a")).alias("prefix_chars"),
        F.when(form != "plain", F.col("b") - F.col("a")).alias("middle_chars"),
        output.otherwise(F.concat(s, suffix, p, prefix, m, middle)).alias("output"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_H = [f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT" for k in range(4)]
_JOIN = "array_to_string(tokens[{0}:{1}], '')"
OP11_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
 sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(tokens)::BIGINT AS n, least({_H[0]} % (len(tokens) + 1), {_H[1]} % (len(tokens) + 1)) AS a,
 greatest({_H[0]} % (len(tokens) + 1), {_H[1]} % (len(tokens) + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_H[2]} % 100 >= 90 THEN 'plain'
 WHEN {_H[3]} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, {_JOIN.format("1", "a")} AS prefix, {_JOIN.format("a + 1", "b")} AS middle, {_JOIN.format("b + 1", "n")} AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
 ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
