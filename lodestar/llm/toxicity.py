"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons of insults by kind and language, lexicons of word stems mined from the
labelled rows, and patterns. A generative label model gives the probability of every vote given the class, and of
correlated voters given each other; it is fitted by expectation-maximisation over the counts of vote patterns of all
documents (at most 3 * 2**voters of them, so the driver holds a bounded table); labels enter it as one more, fallible
voter. A linear classifier is then trained on the posterior labels of a bounded sample (SAMPLE_ROWS rows) and scores
every whole text.

Cases: a null text is empty; an empty text gets the score of a text without votes; very long texts are read whole, one
at a time; without labels only the fixed voters count; repeated rows are alike and count each time; rows of `labels` that
repeat an id count as the greater label; of stems that fit equally well the shorter, then the alphabetically first is
taken; a score equal to the threshold is toxic; empty tables give empty results; extra columns are ignored by
`score_toxicity` and kept by `drop_toxic`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestar.llm.common import as_text, fold, give_back, table, text_of
from lodestar.session import materialize

SAMPLE_ROWS = 20_000
MINED_STEMS = 60
THRESHOLD = 0.7
#: A label is right this often at least; two voters are linked from this conditional mutual information on.
LABEL_TRUST = 0.9
LEAST_LINK = 1e-4
#: Steps of the draw of samples.
DRAWS = 1 << 40

#: Words of abuse by kind and language, one voter each.
LEXICONS = {
    "mind": "idiot idiots moron morons stupid dumb imbecile fool fools dimwit brainless dunce halfwit cretin",
    "worth": "worthless pathetic loser losers useless pitiful inferior coward cowards",
    "filth": "trash scum disgusting garbage filth filthy vermin vile repulsive rotten parasite parasites",
    "mock": "clown clowns ridiculous laughable joke buffoon jerk jerks creep weirdo",
    "german": "idioten dummkopf trottel abschaum wertlos widerlich versager blödmann erbärmlich dumm",
    "french": "idiote imbécile crétin abruti ordure minable stupide débile dégoûtant raclure",
    "spanish": "idiota estúpido estúpida imbécil basura patético payaso escoria inútil asqueroso",
}
_SHOUT = re.compile(r"[A-ZÀ-Þ]{4,}")
_ADDRESS = re.compile(r"\b(?:you|your|du|tu|eres|vous) (?:are |all |a |bist |es |êtes )?(?:\w+ )?(\w+)", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


def mined_stems(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """(stems, misleading words), from labelled training rows, of which at most SAMPLE_ROWS are looked at.

    Stems are the first 4 to 8 letters of words, or whole words, that go with label 1: present in at least 4 and 2 % of
    the toxic rows, and 20 times as often as in clean ones (to which two are added). Those that fewest clean rows have come
    first, and a stem that extends or begins another is left out; at most 20 * MINED_STEMS stems reach the driver. Words of the fixed lexicons that are found in clean rows, and
    not 20 times as often in toxic ones, mislead here: they mean something else in these texts."""
    known = docs.join(labels, "doc_id").where(fold("doc_id", 3) != 1)
    size = known.count()
    share = int(min(1, SAMPLE_ROWS / max(size, 1)) * DRAWS)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS)) < share).select("toxic", "text")
    known = materialize(known, "toxicity-sample")  # read by three jobs, joined once
    words = F.array_distinct(F.split(F.lower(text_of()), r"[^\p{L}]+"))
    stems = F.transform(
        F.filter(words, lambda w: F.length(w) > 3),
        lambda w: F.transform(F.sequence(F.lit(4), F.least(F.lit(8), F.length(w))), lambda n: F.substring(w, F.lit(1), n)),
    )
    listed = F.lit(sorted({w for words in LEXICONS.values() for w in words.split()}))
    bad, good = (float(x or 0) for x in known.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    counted = [F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")]
    odds = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 2) / (good + 1))

    counts = known.select("toxic", F.explode(F.array_distinct(F.flatten(stems))).alias("stem")).groupBy("stem").agg(*counted)
    found = counts.where((F.col("bad") >= max(4, 0.02 * bad)) & (odds >= 20))
    kept: list[str] = []
    for r in found.orderBy(F.desc(F.col("bad") - 5 * F.col("good")), F.length("stem"), "stem").limit(20 * MINED_STEMS).collect():
        if len(kept) < MINED_STEMS and not any(r.stem.startswith(x) or x.startswith(r.stem) for x in kept):
            kept.append(r.stem)
    fixed = known.select("toxic", F.explode(F.array_intersect(words, listed)).alias("word")).groupBy("word").agg(*counted)
    return kept, [r.word for r in fixed.where((F.col("good") > 0) & (odds < 20)).orderBy("word").collect()]


class Voters:
    """Which voters fire on a text, and by how many different words."""

    def __init__(self, mined: list[str], misleading: list[str]):
        self.lists = [frozenset(v.split()).difference(misleading) for v in LEXICONS.values()]
        self.names = [*LEXICONS, "mined", "mined twice", "shouting", "exclaiming", "addressed"]
        self.of_word: dict[str, list[int]] = {}
        for i, words in enumerate(self.lists):
            for word in words:
                self.of_word.setdefault(word, []).append(i)
        self.of_stem = dict.fromkeys(mined, len(self.lists))
        self.starts = frozenset(stem[:4] for stem in mined)

    def hits(self, word: str) -> list[int]:
        out = list(self.of_word.get(word, ()))
        if word[:4] in self.starts:
            out += [self.of_stem[word[:n]] for n in range(4, 9) if n <= len(word) and word[:n] in self.of_stem]
        return out

    def counts(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(self.names), "f4")
        if not text:
            return out
        of_word, starts = self.of_word, self.starts
        for word in set(_WORD.findall(text.lower())):
            if word in of_word or word[:4] in starts:
                for i in self.hits(word):
                    out[i] += 1
        out[len(self.lists) + 1] = max(0, out[len(self.lists)] - 1)
        at = len(self.names) - 3
        out[at] = max(0, len(_SHOUT.findall(text)) - 4)
        out[at + 1] = text.count("!!")
        if out[:at].any():
            out[at + 2] = sum(bool(self.hits(m.lower())) for m in _ADDRESS.findall(text))
        return out


def features(counts: np.ndarray) -> np.ndarray:
    """Fired or not, and the logarithm of the count, of every voter; then whether any lexicon fired, and how many."""
    fired = counts > 0
    lexical = fired[:, : len(LEXICONS) + 2]
    return np.concatenate((fired, np.log1p(counts), lexical.any(1, keepdims=True), lexical.sum(1, keepdims=True)), axis=1).astype("f8")


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Kinds of documents that the label model tells apart, by class: clean ones without and with votes, toxic ones with few
#: and with many votes.
KINDS = np.array([0, 0, 1, 1])


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


class LabelModel:
    """A generative model of the votes: a document is toxic or not, and of one of the KINDS of its class; given the kind,
    a voter fires with a probability that depends on its parent's vote, if it has a parent.

    The parents are a forest of the pairs that are most informative about each other given the kind (their conditional
    mutual information, LEAST_LINK at least), so that voters which repeat one another don't count twice. A label is one
    more voter, which is right with LABEL_TRUST at least. All is fitted by expectation-maximisation: with the forest
    fixed, a round never lowers the objective, and rounds go on until it stands still; the forest is drawn anew a few
    times from the posteriors so found."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 300):
        """votes: patterns x voters, 0 or 1; labels: -1 unknown, 0, 1; weights: documents with that pattern."""
        self.labels, self.rate = labels, (weights @ votes + 0.5) / (weights.sum() + 1)
        lexical = votes[:, : len(LEXICONS) + 2].sum(1)
        p = np.where(labels == 1, 0.95, np.where(labels == 0, 0.05, np.where(lexical > 0, 0.9, 0.02)))
        many, some = np.where(lexical > 2, 0.9, 0.1), np.where(votes.any(1), 0.9, 0.1)
        of_kind = np.stack(((1 - p) * (1 - some), (1 - p) * some, p * (1 - many), p * many), 1)
        self.objective: list[list[float]] = []
        for share in (0.1, 1, 1):  # first the labelled documents lead
            self.weights = np.where(labels >= 0, weights, weights * share)
            self.parent = self.forest(votes, of_kind)
            steps: list[float] = []
            for _ in range(rounds):
                self.maximise(votes, of_kind)
                both = self.by_kind(votes) + self.label_part()[:, KINDS]
                whole = _log_sum(both)
                of_kind = np.exp(both - whole[:, None])
                steps.append(float(self.weights @ whole) + self.log_prior())
                if len(steps) > 1 and steps[-1] - steps[-2] < 1e-8 * abs(steps[-2]):
                    break
            self.objective.append(steps)

    def forest(self, votes: np.ndarray, of_kind: np.ndarray) -> np.ndarray:
        """Each voter's parent, -1 for none: a maximum spanning forest by conditional mutual information."""
        size = votes.shape[1]
        gain = np.zeros((size, size))
        total = self.weights.sum()
        for w in self.weights * of_kind.T:
            mass = w.sum()
            if mass < 1e-9:
                continue
            one = w @ votes / mass
            both = (votes * w[:, None]).T @ votes / mass
            rows, cols = one[:, None], one[None, :]
            cells = [(both, rows * cols), (rows - both, rows * (1 - cols)), (cols - both, (1 - rows) * cols), (1 - rows - cols + both, (1 - rows) * (1 - cols))]
            for found, apart in cells:
                found = np.clip(found, 0, 1)
                gain += mass / total * np.where(found > 0, found * np.log(np.maximum(found, 1e-300) / np.maximum(apart, 1e-300)), 0)
        parent, root = np.full(size, -1), list(range(size))

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        near: list[list[int]] = [[] for _ in range(size)]
        pairs = [(gain[i, j], i, j) for i in range(size) for j in range(i + 1, size) if gain[i, j] >= LEAST_LINK]
        for _, i, j in sorted(pairs, reverse=True):
            if find(i) != find(j):
                root[find(i)] = find(j)
                near[i].append(j)
                near[j].append(i)
        seen: set[int] = set()
        for start in range(size):
            open_ = [(start, -1)] if start not in seen else []
            while open_:
                at, above = open_.pop()
                seen.add(at)
                parent[at] = above
                open_ += [(x, at) for x in near[at] if x not in seen]
        return parent

    def maximise(self, votes: np.ndarray, of_kind: np.ndarray) -> None:
        """Probabilities from the posteriors; each with the weight of one vote at the voter's overall rate."""
        size = len(KINDS)
        self.mix = (self.weights @ of_kind + 1) / (self.weights.sum() + size)
        self.fires = np.empty((size, 2, votes.shape[1]))  # kind, vote of the parent, voter
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        for k in range(size):
            w = self.weights * of_kind[:, k]
            for v in (0, 1):
                held = above == v
                self.fires[k, v] = (w @ (votes * held) + self.rate) / (w @ held + 1)
        known, said = self.labels >= 0, self.labels == 1
        right, of = [], []
        for y in (0, 1):
            w = self.weights * of_kind[:, KINDS == y].sum(1) * known
            right.append(w @ (said if y else ~said) + 2 * LABEL_TRUST)
            of.append(w.sum() + 2)
        self.trust = np.clip(np.array(right) / np.array(of), LABEL_TRUST, 1 - 1e-6)

    @property
    def prior(self) -> float:
        return float(self.mix[KINDS == 1].sum())

    def by_kind(self, votes: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of the votes together with each kind."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(int)
        out = np.empty((len(votes), len(KINDS)))
        for k in range(len(KINDS)):
            fire = self.fires[k][above, np.arange(votes.shape[1])]
            out[:, k] = np.where(votes > 0, np.log(fire), np.log1p(-fire)).sum(1) + np.log(self.mix[k])
        return out

    def joint(self, votes: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of the votes together with each class."""
        of = self.by_kind(votes)
        return np.stack([_log_sum(of[:, KINDS == y]) for y in (0, 1)], 1)

    def label_part(self) -> np.ndarray:
        known, said = self.labels >= 0, self.labels == 1
        miss = np.where(said, np.log(1 - self.trust[0]), np.log(self.trust[0]))
        hit = np.where(said, np.log(self.trust[1]), np.log(1 - self.trust[1]))
        return np.stack((miss, hit), 1) * known[:, None]

    def log_prior(self) -> float:
        out = (self.rate * np.log(self.fires) + (1 - self.rate) * np.log1p(-self.fires)).sum()
        out += np.log(self.mix).sum()
        return float(out + 2 * (LABEL_TRUST * np.log(self.trust) + (1 - LABEL_TRUST) * np.log1p(-self.trust)).sum())

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being toxic, from votes alone."""
        both = self.joint(votes)
        return _sigmoid(both[:, 1] - both[:, 0])


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weights of a linear classifier for soft labels by Newton's method; the last is the intercept."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    beta = np.zeros(x.shape[1])
    total = max(weights.sum(), 1e-9)
    for _ in range(rounds):
        p = _sigmoid(x @ beta)
        slope = x.T @ (weights * (p - y)) / total + ridge * beta
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / total + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta


class ToxicityModel:
    """What scoring needs: the mined stems and the classifier's weights. Small, whatever the input."""

    def __init__(self, mined: list[str], misleading: list[str], beta: np.ndarray):
        self.mined, self.misleading, self.beta, self.voters = mined, misleading, beta, None

    def score(self, texts: list[str | None]) -> np.ndarray:
        self.voters = self.voters or Voters(self.mined, self.misleading)
        if not texts:
            return np.empty(0)
        x = features(np.array([self.voters.counts(t) for t in texts]))
        return _sigmoid(x @ self.beta[:-1] + self.beta[-1])


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on docs and the labels of rows outside fold 1 of 3."""
    labels = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    docs = docs.select("doc_id", "text")
    mined, misleading = mined_stems(docs, labels)
    size = len(Voters(mined, misleading).names)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(mined, misleading)
        for pdf in batches:
            counts = np.array([voters.counts(t) for t in pdf["text"]]).reshape(-1, size)
            bits = ["".join("1" if c else "0" for c in row) for row in counts]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "votes": bits, "counts": list(counts), "draw": pdf["draw"]})
        give_back()

    rows = docs.select(as_text().alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS)).alias("draw"))
    voted = rows.mapInPandas(vote, "doc_id string, votes string, counts array<float>, draw long").withColumn(
        "train", fold("doc_id", 3) != 1
    )
    known = F.when(F.col("train"), F.coalesce("toxic", F.lit(-1))).otherwise(F.lit(-1))
    # one row per vote pattern, with the label if it may be learned from, and the smallest draws as the sample
    patterns = (
        voted.join(labels.select(as_text().alias("doc_id"), "toxic"), "doc_id", "left")
        .groupBy("votes", known.alias("label"))
        .agg(F.count("*").alias("n"), F.sum(F.when(F.col("train"), 1).otherwise(0)).alias("train"))
        .collect()
    )
    if not patterns:
        return ToxicityModel(mined, misleading, np.zeros(2 * size + 3))
    votes = np.array([[c == "1" for c in r.votes] for r in patterns], "f8")
    model = LabelModel(votes, np.array([r.label for r in patterns]), np.array([r.n for r in patterns], "f8"))
    trained, fired = sum(r.train for r in patterns), sum(r.train for r in patterns if "1" in r.votes)
    # Half of the sample are rows with a vote; rows without one are all alike to the classifier.
    share = int(min(1, SAMPLE_ROWS / 2 / max(fired, 1)) * DRAWS)
    sample = voted.where(F.col("train") & F.col("votes").contains("1") & (F.col("draw") < share)).select("votes", "counts").collect()
    x = features(np.array([r.counts for r in sample] + [[0] * size], "f4"))
    v = np.array([[c == "1" for c in r.votes] for r in sample] + [[0] * size], "f8")
    weights = np.ones(len(x))
    weights[-1] = max(1, (trained - fired) * max(len(sample), 1) / max(fired, 1))
    return ToxicityModel(mined, misleading, logistic(x, model.posterior(v), weights))


def _scorer(docs: DataFrame, model: ToxicityModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        found = pd.Series(shared.value.score(texts.tolist()), dtype="float64")
        give_back()
        return found

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    score = _scorer(docs, learn(docs, labels))
    scored = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic; all columns stay."""
    return docs.where(_scorer(docs, learn(docs, labels))(F.col("text")) < THRESHOLD)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
