"""Language identification by cross-parsing: the language whose labelled text needs fewest phrases wins.

For every language a suffix automaton of a bounded sample of labelled text (SAMPLE_CHARS symbols, of the distinct
texts with the least hashes, so that every language with a letter has one) is built in each worker. No text gives more
than a DOC_SHARE-th of the sample, unless the language has too few texts to fill it so. A text is parsed greedily: a phrase is the
longest match of what follows with anything in the language's sample; the number of phrases, normalised by the
text's length, estimates the cross-entropy. Whole texts are parsed. All blocks of BLOCK symbols of a batch advance
together, a symbol at a time, and are then joined at their ends as one parse of the whole text would go.

Only the samples are broadcast (languages * SAMPLE_CHARS characters). Letters are lower-cased; a run of anything
else is one symbol.

Cases: null text or text without a letter: `und`, score 0; nothing to learn from: `und` for all; ties: the first
language in alphabetical order; repeated rows are alike; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestar.llm.common import as_before, as_text, fold, give_back, table, text_of

SAMPLE_CHARS = 30_000
DOC_SHARE = 20
BLOCK = 256
LANES = 4096


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts all substrings; state 0 is the start."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
        last = new
    return nexts


class CrossParser:
    """Phrase counts of texts under each language's sample."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        letters = sorted({c for _, text in samples for c in text.lower() if c.isalpha()})
        self.symbol_of = np.zeros(0x110000, "u2")  # 0: not a letter, 1: a letter that no sample has
        self.letters = letters
        for at in range(0, 0x110000, 0x10000):  # letters of all scripts
            self.symbol_of[at : at + 0x10000] = [chr(c).isalpha() for c in range(at, at + 0x10000)]
        for i, c in enumerate(letters):
            self.symbol_of[ord(c)] = i + 2
        self.width = len(letters) + 2
        self.tables = []  # of each language: the next state by state and symbol, -1 where there is none; state 0 is the root
        for _, text in samples:
            states = suffix_automaton(self.symbols(text).tolist())
            dense = np.full((len(states), self.width), -1, "i4")
            for state, row in enumerate(states):
                for c, to in row.items():
                    dense[state, c] = to
            self.tables.append(dense.ravel())

    def symbols(self, text: str) -> np.ndarray:
        found = self.symbol_of[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """texts x languages.

        All blocks of a batch are parsed side by side, each from the root. Then each block is parsed anew from the state in
        which the block before it ends, until it meets the states of the parse from the root; from there on both are the
        same. A block that doesn't meet them ends in another state, and the block after it is done again."""
        out = np.zeros((len(texts), len(self.langs)), "i8")
        blocks = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), BLOCK)]
        blocks.sort(key=lambda b: -min(BLOCK, len(texts[b[0]]) - b[1]))  # stable: a block comes after the one before it
        place = {b: at for at, b in enumerate(blocks)}
        before = np.array([place.get((i, at - BLOCK), -1) for i, at in blocks], "i8")
        ends = np.zeros((len(blocks), len(self.tables)), "i8")
        for at in range(0, len(blocks), LANES):
            part = blocks[at : at + LANES]
            sizes = np.array([min(BLOCK, len(texts[i]) - x) for i, x in part])
            steps = np.zeros((sizes[0], len(part)), "i4")
            for lane, (i, x) in enumerate(part):
                steps[: sizes[lane], lane] = texts[i][x : x + BLOCK]
            owner = np.array([i for i, _ in part])
            follows = before[at : at + LANES]
            for k, table in enumerate(self.tables):
                count, end = self._count(table, steps, sizes, follows, at, ends[:, k])
                ends[at : at + LANES, k] = end
                np.add.at(out[:, k], owner, count)
        return out

    def _advance(self, table: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol each, and the places where a phrase begins with it."""
        to = table[state * self.width + c]
        miss = np.flatnonzero(to < 0)
        again = table[c[miss]]
        to[miss] = np.where(again < 0, 0, again)
        return to, miss

    def _count(self, table: np.ndarray, steps: np.ndarray, sizes: np.ndarray, follows: np.ndarray, at: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block, and the state at its end. follows: the number of the block before, or -1;
        at: the number of the first block here; ends: the end states of the blocks before these."""
        lanes = np.arange(len(sizes))
        active = np.searchsorted(-sizes, -np.arange(sizes[0]))  # lanes that have a symbol at this step
        states, counts = np.zeros(steps.shape, "i4"), np.zeros(steps.shape, "i2")
        state, count = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i2")
        for step, n in enumerate(active.tolist()):
            state[:n], miss = self._advance(table, state[:n], steps[step, :n])
            count[miss] += 1
            states[step, :n], counts[step, :n] = state[:n], count[:n]
        root_end, root_total = states[sizes - 1, lanes].astype("i8"), counts[sizes - 1, lanes].astype("i8")
        end, total = root_end.copy(), root_total + (follows < 0)
        todo = lanes[follows >= 0]
        after = np.full(len(sizes), -1)
        inside = todo[follows[todo] >= at]
        after[follows[inside] - at] = inside
        while len(todo):
            ahead = follows[todo] < at
            state = np.where(ahead, ends[follows[todo]], end[np.where(ahead, 0, follows[todo] - at)])
            here, count = todo, np.zeros(len(todo), "i8")
            new_end, new_total = root_end[todo], np.zeros(len(todo), "i8")
            slot = np.arange(len(todo))
            for step in range(sizes[0]):
                over = sizes[here] <= step
                if over.any():  # the parses haven't met within the block
                    new_end[slot[over]], new_total[slot[over]] = state[over], count[over]
                    here, state, count, slot = here[~over], state[~over], count[~over], slot[~over]
                if not len(here):
                    break
                state, miss = self._advance(table, state, steps[step, here])
                count[miss] += 1
                met = state == states[step, here]
                if met.any():
                    new_total[slot[met]] = count[met] + root_total[here[met]] - counts[step, here[met]]
                    here, state, count, slot = here[~met], state[~met], count[~met], slot[~met]
            new_end[slot], new_total[slot] = state, count
            changed = todo[new_end != end[todo]]
            end[todo], total[todo] = new_end, new_total
            todo = after[changed]
            todo = todo[todo >= 0]
        return total, end

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [self.symbols(t or "") for t in texts]
        lettered = [i for i, s in enumerate(found) if s.any()]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if self.langs and lettered:
            phrases = self.phrases([found[i] for i in lettered])
            best = phrases.argmin(1)
            odds = np.exp(-(phrases - phrases.min(1, keepdims=True)).astype("f8")).sum(1)
            for i, b, o in zip(lettered, best.tolist(), odds.tolist()):
                lang[i], score[i] = self.langs[b], 1 / o
        return lang, score


@lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    """One per worker process: workers outlive queries, so the automata of earlier samples are let go."""
    made = CrossParser(samples)
    give_back()
    return made


def learn(docs: DataFrame, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample) from the labelled rows outside fold 2 of 4: at most chars characters a language, and as many
    where its texts have them.

    A text's level is the number of leading zeros of its hash. Of each language the levels from the top are taken until
    its texts, each counted up to the share that it may give, fill the sample; the lowest such level doubles their number
    or so, whatever the input."""
    start = F.regexp_replace(text_of(), r"^\P{L}+", "")
    rows = docs.where(F.col("lang").isNotNull() & (fold("doc_id", 4) != 2)).select("lang", start.alias("text")).where("text <> ''")
    rows = rows.withColumn("draw", F.xxhash64("text")).withColumn("level", F.lit(64) - F.length(F.bin("draw")))
    most = max(chars // DOC_SHARE, 1)
    distinct = rows.groupBy("lang", "draw", "level").agg(F.max(F.least(F.length("text"), F.lit(most))).alias("n"))
    levels: dict[str, dict[int, int]] = {}
    for r in distinct.groupBy("lang", "level").agg(F.sum("n").alias("n")).collect():
        levels.setdefault(r.lang, {})[r.level] = r.n
    taken = []
    for lang, held in levels.items():
        least, total = 64, 0
        for level in sorted(held, reverse=True):
            least, total = level, total + held[level]
            if total >= chars:
                break
        taken.append((lang, least, most if total >= chars else chars))
    bounds = docs.sparkSession.createDataFrame(taken, "lang string, least int, most int")
    drawn = rows.join(F.broadcast(bounds), "lang").where("level >= least").select("lang", "draw", F.expr("substring(text, 1, most)").alias("text"))
    parts: dict[str, list[str]] = {}
    for r in sorted(drawn.distinct().collect(), key=lambda r: (r.lang, r.draw % 2**64, r.text)):
        parts.setdefault(r.lang, []).append(r.text)
    return tuple(sorted((lang, _fill(own, chars, most)) for lang, own in parts.items()))


def _fill(texts: list[str], chars: int, most: int) -> str:
    """At most chars characters of the texts, in turns of at most so many characters of each."""
    out, left = [], chars
    for turn in range(-(-max(map(len, texts)) // most)):
        for text in texts:
            part = text[turn * most : (turn + 1) * most][: max(left, 0)]
            if part:
                out.append(part)
                left -= len(part) + 1
    return " ".join(out)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cross = parser(shared.value)
        for pdf in batches:
            lang, score = cross.predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": lang, "score": score})
        give_back()

    rows = docs.select(as_text().alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return as_before(rows.mapInPandas(work, "doc_id string, held_out boolean, lang_pred string, score double"), docs)


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """docs whose language is recognised with that score at least; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf(BooleanType())
    def known(texts: pd.Series) -> pd.Series:
        lang, score = parser(shared.value).predict(texts.tolist())
        give_back()
        return pd.Series([name != "und" and x >= least for name, x in zip(lang, score)], dtype=bool)

    return docs.where(known(F.col("text")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
