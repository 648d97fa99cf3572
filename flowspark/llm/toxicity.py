"""Toxicity by weak supervision.

Many voters look at a document: one per word of a fixed lexicon, patterns, and counts of words mined from labelled rows.
A generative label model, fitted by expectation maximisation to the votes of all documents outside the held-out fold,
estimates how often each voter fires in either class and how voters correlate within a class; correlated voters share
their weight. A linear classifier on words is then trained on the posterior labels of a bounded sample and scores
every text. Labels of held-out rows are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, fold, free_name, table, written
from .registry import query

# Insults in four languages.
LEXICON = (
    "arschloch bastard bitch clown crap depp disgusting dumb dummkopf estúpida estúpido fool fuck garbage hate idiot "
    "idiota idiote imbecile imbécile imbécil jerk kill loser miststück moron nazi pathetic pig retard scum shit shut "
    "slut stupid stupide trash trottel ugly useless vermin whore worthless asqueroso basura connard salope"
).split()

#: Labelled rows that words are mined from and that the classifier is fitted to, at most.
SAMPLE = 8_000
#: Mined voters, and words of the classifier, at most; documents of the sample a word must stand in.
MINED, WORDS, LEAST = 160, 2_000, 5
EM_ROUNDS, PASSES, RIDGE = 12, 150, 1.0
UNIT = 1 << 30

LETTERS = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "second person insult": re.compile(r"\b(?:you|du|tu|ihr|vous)\b[^.!?\n]{0,24}\b(?:" + "|".join(LEXICON) + r")\b"),
    "insult before exclamation": re.compile(r"\b(?:" + "|".join(LEXICON) + r")\b\W{0,3}!"),
}
#: Voters on how many different mined words stand in a text without an insult of the lexicon.
MINED_COUNTS = ("one mined word", "two mined words", "three mined words or more")


def words_in(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


class Voters:
    """The voters that fire on a text: insults one by one, patterns, and the number of different mined words.

    Mined words of one language stand in the same texts, so they vote by their number rather than one by one; the last
    voter fires if no other one does.
    """

    def __init__(self, mined: list[str]):
        self.insults = {w: i for i, w in enumerate(LEXICON)}
        self.mined = set(mined) - self.insults.keys()
        self.names = [*LEXICON, "two insults or more", *PATTERNS, *MINED_COUNTS, "silence"]

    def fired(self, text: str, words: set[str] | None = None) -> list[int]:
        words = words_in(text) if words is None else words
        found = sorted(self.insults[w] for w in words & self.insults.keys())
        n = len(LEXICON)
        if found:
            lower = text.lower()
            patterns = [n + 1 + k for k, p in enumerate(PATTERNS.values()) if p.search(lower)]
            found += ([n] if len(found) > 1 else []) + patterns
        elif mined := len(words & self.mined):
            found = [n + len(PATTERNS) + min(mined, len(MINED_COUNTS))]
        return found or [len(self.names) - 1]


class LabelModel:
    """Two classes, conditionally independent voters up to a weight that correlated voters share."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray):
        """Starts from the labelled rows' votes, which also stay half of the evidence in every round."""
        share = np.stack([labels == 0, labels == 1]).astype(float)
        self.anchor_n, self.anchor = share.sum(axis=1), share @ votes
        self.weight = np.ones(votes.shape[1])
        self.settle(self.anchor_n, self.anchor)

    def settle(self, n: np.ndarray, fired: np.ndarray) -> None:
        self.prior = float(np.clip(n[1] / n.sum(), 1e-4, 0.5))
        self.rate = np.clip((fired + 0.5) / (n[:, None] + 10.0), 1e-5, 1 - 1e-5)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.rate / (1 - self.rate))
        base = (np.log(1 - self.rate) * self.weight).sum(axis=1)
        odds = votes @ (self.weight * (logs[1] - logs[0])) + base[1] - base[0]
        odds += np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def update(self, n: np.ndarray, fired: np.ndarray, pairs: np.ndarray) -> None:
        """From sums over documents by class: their number, votes and products of votes."""
        total = n.sum()
        if total <= 0:
            return
        scale = total / self.anchor_n.sum()
        self.settle(n + scale * self.anchor_n, fired + scale * self.anchor)
        share = pairs / np.maximum(n, 1e-9)[:, None, None]
        mean = fired / np.maximum(n, 1e-9)[:, None]
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        same = (share - mean[:, :, None] * mean[:, None, :]) / (spread[:, :, None] * spread[:, None, :])
        self.correlation = np.clip((same * (n / total)[:, None, None]).sum(axis=0), -1, 1)
        np.fill_diagonal(self.correlation, 1)
        self.weight = 1 / np.maximum(self.correlation, 0).sum(axis=1)


def vote_table(docs: DataFrame, voters: Voters, key: str, text: str) -> DataFrame:
    """(fired, n): how many documents have each set of votes; summed within tasks, then between them."""
    slim = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    schema = arrow_schema(docs.sparkSession, "fired array<int>, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, ...], int] = {}
            for t in batch.column(0).to_pylist():
                votes = tuple(voters.fired(t))
                counts[votes] = counts.get(votes, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(k) for k in counts], schema.field(0).type), pa.array(list(counts.values()), pa.int64())],
                schema=schema,
            )

    return slim.mapInArrow(run, "fired array<int>, n bigint").groupBy("fired").agg(F.sum("n").alias("n"))


def vote_matrix(fired: list[list[int]], voters: int) -> np.ndarray:
    out = np.zeros((len(fired), voters))
    for i, row in enumerate(fired):
        out[i, row] = 1
    return out


def fit_label_model(votes: DataFrame, model: LabelModel) -> LabelModel:
    """Expectation maximisation; each round one job that sums by class over all vote sets."""
    voters = len(model.weight)
    size = 1 + voters + voters * voters

    for _ in range(EM_ROUNDS):
        now = model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, size))
            for batch in batches:
                v = vote_matrix(batch.column(0).to_pylist(), voters)
                n = batch.column(1).to_numpy()
                toxic = now.posterior(v)
                for c, share in enumerate((1 - toxic, toxic)):
                    w = n * share
                    total[c] += np.concatenate([[w.sum()], w @ v, (v.T @ (v * w[:, None])).ravel()])
            keep = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(total.ravel()[keep])], names=["i", "x"])

        rows = votes.mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(2 * size)
        for r in rows:
            total[r["i"]] = r["x"]
        total = total.reshape(2, size)
        model.update(total[:, 0], total[:, 1 : 1 + voters], total[:, 1 + voters :].reshape(2, voters, voters))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(k, t, y, words) of at most ``SAMPLE`` labelled rows outside the held-out fold, chosen by a hash of the key.

    Labels beside a null or with other values than 0 and 1 are left out; of several labels of a key the largest counts.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(key)) != 0))
        .groupBy(F.col(key).alias("k"))
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(SAMPLE)
    )
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = slim.join(F.broadcast(known), "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").cast("int").alias("y"))

    @F.arrow_udf("array<string>")
    def distinct_words(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(words_in(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return written(rows.withColumn("words", distinct_words("t")), "toxic-sample")


def mined_words(sample: DataFrame, clean_rows: int, toxic_rows: int) -> list[str]:
    """Words that stand in toxic rows far more often than in others, the strongest first, ties by the word."""
    counts = sample.select("y", F.explode("words").alias("w")).groupBy("w").agg(
        F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic")
    )
    strong = counts.where((F.col("toxic") >= LEAST) & (F.col("toxic") / (F.col("toxic") + F.col("clean")) >= 0.7))
    weak = F.col("clean") / max(1, clean_rows) - F.col("toxic") / max(1, toxic_rows)
    return [r["w"] for r in strong.select(weak.alias("o"), "w").orderBy("o", "w").limit(MINED).collect()]


def telling_words(sample: DataFrame, targets: list[tuple], mean: float) -> list[str]:
    """Words whose presence tells the posterior classes apart, the strongest first, ties by the word.

    ``targets`` are (key, posterior in units of 2**-30), so that their sums are exact in any order.
    """
    kind = sample.schema["k"].dataType.simpleString()
    target = sample.sparkSession.createDataFrame(targets, f"k {kind}, target bigint")
    each = sample.join(F.broadcast(target), "k").select("target", F.explode("words").alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("have"), (F.sum("target") / float(UNIT)).alias("bad"))
    spread = F.sqrt(F.col("have") * mean * (1 - mean) + 1e-9)
    z = F.abs(F.col("bad") - F.col("have") * mean) / spread
    found = counts.where(F.col("have") >= LEAST).select((-z).alias("o"), "w").where("o <= -4")
    return [r["w"] for r in found.orderBy("o", "w").limit(WORDS).collect()]


class WordClassifier:
    """Logistic regression on the presence of words and voters."""

    def __init__(self, weights: dict[str, float], votes: np.ndarray, bias: float):
        self.weights, self.votes, self.bias = weights, votes, bias

    def score(self, words: set[str], fired: list[int]) -> float:
        odds = self.bias + sum(self.votes[i] for i in fired)
        odds += sum(self.weights[w] for w in sorted(words & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def fit_classifier(names: list[str], present: list[list[int]], fired: list[list[int]], target: np.ndarray, voters: int) -> WordClassifier:
    """Fitted to posterior labels by gradient steps; ``present`` are the places in ``names`` of each row's words."""
    n = len(fired)
    mean = max(target.sum(), 1e-9) / max(n, 1)
    rows, columns = [], []
    for i, (words, votes) in enumerate(zip(present, fired)):
        mine = votes + [voters + w for w in words]
        rows += [i] * len(mine)
        columns += mine
    r, c = np.array(rows, np.int64), np.array(columns, np.int64)
    size = voters + len(names)
    weight, bias = np.zeros(size), float(np.log(max(mean, 1e-3) / (1 - min(mean, 0.999))))
    speed, first, second, b1, b2 = 0.1, np.zeros(size + 1), np.zeros(size + 1), 0.9, 0.99
    for t in range(1, PASSES + 1 if n else 1):
        odds = np.bincount(r, weight[c], n) + bias
        error = 1 / (1 + np.exp(-np.clip(odds, -50, 50))) - target
        slope = np.append(np.bincount(c, error[r], size) + RIDGE * weight, error.sum()) / n
        first, second = b1 * first + (1 - b1) * slope, b2 * second + (1 - b2) * slope**2
        step = speed * (first / (1 - b1**t)) / (np.sqrt(second / (1 - b2**t)) + 1e-8)
        weight -= step[:-1]
        bias -= step[-1]
    return WordClassifier(dict(zip(names, weight[voters:].tolist())), weight[:voters], float(bias))


def prior_classifier(voters: Voters) -> WordClassifier:
    """Without labelled rows: an insult of the lexicon counts as toxic."""
    votes = np.array([6.0] * len(LEXICON) + [0.0] * (len(voters.names) - len(LEXICON)))
    return WordClassifier({}, votes, -3.0)


def learnt_classifier(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[Voters, WordClassifier]:
    """Of the sampled rows, only keys, votes and the places of chosen words come to the driver."""
    sample = labelled_sample(docs, labels, key, text, label)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        voters = Voters([])
        return voters, prior_classifier(voters)
    voters = Voters(mined_words(sample, sizes[0], sizes[1]))
    votes = written(vote_table(docs.where(fold(F.col(key)) != 0), voters, key, text), "toxic-votes")

    @F.arrow_udf("array<int>")
    def fires(texts: pa.Array, words: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), words.to_pylist())
        return pa.array([voters.fired(t, set(w)) for t, w in rows], pa.list_(pa.int32()))

    rows = sample.select("k", "y", fires("t", "words").alias("fired")).orderBy("k").collect()
    fired, marks = [r["fired"] for r in rows], np.array([r["y"] for r in rows], np.int64)
    matrix = vote_matrix(fired, len(voters.names))
    model = fit_label_model(votes, LabelModel(matrix, marks))
    target = model.posterior(matrix)
    units = np.rint(target * UNIT).astype(np.int64).tolist()
    names = telling_words(sample, [(r["k"], u) for r, u in zip(rows, units)], max(target.sum(), 1e-9) / len(rows))
    place = {w: i for i, w in enumerate(names)}

    @F.arrow_udf("array<int>")
    def present(words: pa.Array) -> pa.Array:
        return pa.array([[place[w] for w in row if w in place] for row in words.to_pylist()], pa.list_(pa.int32()))

    held = sample.select("k", present("words").alias("p")).orderBy("k").collect()
    return voters, fit_classifier(names, [r["p"] for r in held], fired, target, len(voters.names))


def score_column(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Column:
    """A struct (score, predicted) of each row's text, learnt by ``key``."""
    voters, classifier = learnt_classifier(docs, labels, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast((voters, classifier))
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32())])

    @F.arrow_udf("struct<score:double,predicted:int>")
    def scored(texts: pa.Array) -> pa.Array:
        voters, classifier = shared.value
        out = []
        for t in texts.to_pylist():
            found = words_in(t)
            p = classifier.score(found, voters.fired(t, found))
            out.append({"score": p, "predicted": int(p >= 0.5)})
        return pa.array(out, kind)

    return scored(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """(key, held_out, score, predicted) per row of ``docs``.

    Only the text enters a score: null and empty texts score as texts in which no voter fires. A null key is held out.
    Repeated rows score alike. Without a labelled row of each class outside the held-out fold, the lexicon alone
    decides.
    """
    name = free_name(docs, "scored")
    scored = docs.withColumn(name, score_column(docs, labels, key, text, label))
    return scored.select(
        key, (fold(F.col(key)) == 0).alias("held_out"), F.col(name)["score"].alias("score"), F.col(name)["predicted"].alias("predicted")
    )


@query()
def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; each row is judged by its own text, in a narrow pass."""
    return docs.where(score_column(docs, labels, key, text, "toxic")["predicted"] == 0)
