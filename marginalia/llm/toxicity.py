"""Toxicity by class-conditional Kneser-Ney models of words' characters.

Two interpolated Kneser-Ney models of order ORDER, one of toxic and one of ordinary words, back off to
one shared model of lower order with continuation counts over both, so a rare expression that
neither class knows scores zero and one that shares a stem with known ones inherits its score. The
two log-likelihoods are compared per character: of the whole document and of its most toxic word, as one expression in a long text
hardly moves the former. A logistic curve maps the two to 0 to 1.

Fitted on a bounded sample (parameters `per_class`, `calibration` and `longest`); everything else covers all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, held_out, slices

ORDER, DISCOUNT, UNIFORM = 6, 0.75, 1 / 256
WORD = re.compile(r"[^\W_]+")
MEMO = 150_000
#: Bytes of text whose words are Python objects at once, about.
SLICE = 1_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class ToxicityModel:
    """gram: log ratio of a seen context and character; context: that of a seen context before any other character."""

    gram: dict[str, float]
    context: dict[str, float]
    order: int
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        """Log-likelihood ratio per character: positive for words more likely to be toxic."""
        gram, context, back = self.gram, self.context, self.order - 1
        s, total = f"^{word}$", 0.0
        for end in range(1, len(s)):
            start = end - back if end > back else 0
            got = gram.get(s[start : end + 1])
            total += context.get(s[start:end], 0.0) if got is None else got
        return total / (len(s) - 1)

    def features(self, words: list[str]) -> tuple[float, float]:
        """Toxic less ordinary log-likelihood per character of (the most toxic word, the whole document); zeros without words."""
        if not words:
            return 0.0, 0.0
        memo = self.memo
        got = list(map(memo.get, words))
        if None in got:
            if len(memo) > MEMO:
                memo.clear()
            for i, (w, g) in enumerate(zip(words, got, strict=True)):
                if g is None:
                    g = memo.get(w)
                    got[i] = memo.setdefault(w, self.word(w)) if g is None else g
        ratios, chars = np.array(got), np.fromiter(map(len, words), np.float64, len(words)) + 1  # the end of a word counts too
        return float(ratios.max()), float(ratios @ chars / chars.sum())

    def score(self, features: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * features[0] + self.curve[2] * features[1]
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def grams(counts: Counter[str], order: int) -> Counter[str]:
    out: Counter[str] = Counter()
    for w, n in counts.items():
        s = f"^{w}$"
        for end in range(1, len(s)):
            out[s[max(0, end - order + 1) : end + 1]] += n
    return out


class KneserNey:
    """Probabilities of a character after others in ordinary (0) and toxic (1) words, both backing off to one shared model."""

    def __init__(self, ordinary: Counter[str], toxic: Counter[str], order: int = ORDER):
        self.order = order
        self.counts = [grams(c, order) for c in (ordinary, toxic)]
        self.continuations: Counter[str] = Counter()  # distinct left neighbours, over both classes
        pending, seen = set(chain(*self.counts)), set()
        while pending:
            seen |= pending
            shorter = set()
            for s in pending:
                if len(s) > 1:
                    self.continuations[s[1:]] += 1
                    shorter.add(s[1:])
            pending = shorter - seen
        self.after = [self._after(c) for c in self.counts]
        self.total, self.kinds = self._after(self.continuations)
        self._known: dict[str, float] = {}

    @staticmethod
    def _after(counts: Counter[str]) -> tuple[Counter[str], Counter[str]]:
        """By context: how often and how many kinds of characters follow."""
        total, kinds = Counter(), Counter()
        for s, n in counts.items():
            total[s[:-1]] += n
            kinds[s[:-1]] += 1
        return total, kinds

    def shared(self, s: str) -> float:
        """Probability of the last character of s after the others by distinct left neighbours."""
        if (p := self._known.get(s)) is None:
            h = s[:-1]
            lower = self.shared(s[1:]) if h else UNIFORM
            n = self.total.get(h, 0)
            p = self._known[s] = (max(self.continuations.get(s, 0) - DISCOUNT, 0.0) + DISCOUNT * self.kinds[h] * lower) / n if n else lower
        return p

    def backoff(self, label: int, h: str) -> float:
        """The mass that a class leaves to the shared model after h: all of it where it has not seen h."""
        total, kinds = self.after[label]
        return DISCOUNT * kinds[h] / total[h] if h in total else 1.0

    def probability(self, label: int, s: str) -> float:
        """Probability of the last character of s after the others in words of a class."""
        h, (total, _) = s[:-1], self.after[label]
        own = max(self.counts[label].get(s, 0) - DISCOUNT, 0.0) / total[h] if h in total else 0.0
        return own + self.backoff(label, h) * self.shared(s[1:])


def kneser_ney(ordinary: Counter[str], toxic: Counter[str], order: int = ORDER) -> ToxicityModel:
    """The model from word counts (documents with the word) of the two classes. What neither has seen has the ratio of what they leave to the shared model."""
    both = KneserNey(ordinary, toxic, order)
    seen = set(both.counts[0]) | set(both.counts[1])
    gram = {s: math.log(both.probability(1, s) / both.probability(0, s)) for s in seen}
    context = {h: math.log(both.backoff(1, h) / both.backoff(0, h)) for h in {s[:-1] for s in seen}}
    return ToxicityModel(gram, context, order)


def fitted_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; too few classes: a flat curve."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return (math.log(p / (1 - p)) if len(y) else -1.0, 0.0, 0.0)
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * np.array([0, w[1], w[2]])
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag([1e-9, ridge, ridge])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit_toxicity(documents: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 2000, calibration: int = 3000, longest: int = 200_000) -> ToxicityModel:
    """Learns from labelled rows for which may_learn (over doc_id) is true.

    The sample: of the labels with 0 or 1, ordered by a hash of doc_id, at most per_class of each
    class for the counts and at most `calibration` others, in their natural proportion,
    for the curve; texts of more than `longest` characters do not count among them, so what reaches the driver is bounded.
    Labels that are null or contradict each other for one doc_id are not used. Text counts
    once per document and word, so neither long nor repeated texts outweigh others by much. Without labels: a flat curve.
    """
    spark = documents.sparkSession
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & may_learn).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).filter("toxic = __most").drop("__most")
    order = F.xxhash64("doc_id")
    clean = clean.withColumn("__fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)))
    parts = [clean.filter((F.col("__fold") != 0) & (F.col("toxic") == y)).orderBy(order).limit(per_class) for y in (0, 1)]
    parts.append(clean.filter(F.col("__fold") == 0).orderBy(order).limit(calibration))
    picked = [[(r["doc_id"], r["toxic"]) for r in p.select("doc_id", "toxic").collect()] for p in parts]  # at most 2 * per_class + calibration rows
    use = [(i, y, 0) for i, y in picked[0] + picked[1]] + [(i, y, 1) for i, y in picked[2]]
    if not use:
        return ToxicityModel({}, {}, ORDER, fitted_curve(np.zeros((0, 2)), np.zeros(0)))
    columns = zip(("doc_id", "__toxic", "__fold"), zip(*use, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)
    chosen = spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, values, kind in columns}))  # a list would start workers of another kind
    texts = documents.select("doc_id", "text").filter(F.coalesce(F.char_length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen), "doc_id").select("__toxic", "__fold", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter[str]] = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                for y, fold, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if fold == 0:
                        tally[y].update(set(words_of(text)))
        for y, c in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["toxic", "word", "n"])

    counted = texts.mapInArrow(freeing(count), "toxic int, word string, n long").groupBy("toxic", "word").agg(F.sum("n").alias("n"))
    tally = [Counter(), Counter()]
    for batch in counted.toArrow().to_batches():
        for y, w, n in zip(*(batch.column(c).to_pylist() for c in ("toxic", "word", "n")), strict=True):
            tally[y][w] += n
    model = kneser_ney(*tally)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(y, *shared.value.features(words_of(t))) for part in slices(batch, 2, SLICE) for y, fold, t in zip(*(c.to_pylist() for c in part.columns), strict=True) if fold == 1]
            yield pa.RecordBatch.from_pylist([{"y": y, "a": a, "b": b} for y, a, b in rows], schema=pa.schema([("y", pa.int32()), ("a", pa.float64()), ("b", pa.float64())]))

    got = texts.mapInArrow(freeing(measure), "y int, a double, b double").collect()  # at most a row for each calibration document
    x = np.array([[r["a"], r["b"]] for r in got]).reshape(-1, 2)
    model.curve = fitted_curve(x, np.array([r["y"] for r in got], dtype=float))
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with a double score from 0 to 1 over the whole text; an existing column of that name is replaced.

    Null and empty texts and texts without words get the curve's value at zero. Rows are scored one by one.
    """
    kept = [c for c in df.columns if c.lower() != score.lower()]
    at = [c.lower() for c in kept].index(text.lower())
    out = [i for i, c in enumerate(kept) if keep is None or c in keep]
    src = df.select(*kept)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(m.features(words_of(t))) for part in slices(batch, at, SLICE) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), pa.array(scores, pa.float64())], names=[*(kept[i] for i in out), score])
        m.memo.clear()  # the worker may go on to other stages

    return src.mapInArrow(freeing(run), src.select(*(kept[i] for i in out), F.lit(0.0).alias(score)).schema)


def op10_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents, repeated rows each; null and empty texts are scored at the curve's zero."""
    model = fit_toxicity(documents, labels, ~held_out(F.col("doc_id")))
    # only the score comes back from Python beside the id: texts are not sent twice
    scored = score_toxicity(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, model: ToxicityModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that score below `least`, with all their columns. Null and empty texts are scored like others; rows are judged one by one."""
    at = documents.columns.index(text)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, at, SLICE):
                yield part.filter(pa.array([m.score(m.features(words_of(t))) < least for t in part.column(at).to_pylist()], pa.bool_()))
        m.memo.clear()  # the worker may go on to other stages

    return documents.mapInArrow(freeing(run), documents.schema)
