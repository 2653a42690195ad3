"""Language by multinomial naive Bayes over hashed character n-grams.

Words are runs of letters and marks, lower-cased, with a mark for the space at either end; their n-grams of 1 to ORDER characters are hashed
into BUCKETS features. Counts by language cover all rows that may be learnt from and are summed by Spark; the matrix of
log-probabilities is broadcast. A slice of documents is scored as two sparse products: distinct words by buckets with that matrix, then
documents by distinct words. A word's n-grams are thus looked up once a slice, and no Python object is made for a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, held_out, slices
from .tokens import BASE, INVERSE, buffers, mixed, powers

ORDER, BUCKETS, SMOOTHING = 4, 1 << 15, 0.5
#: Bound of the broadcast matrix: MAX_LANGS * BUCKETS doubles, 64 MB. More languages are an error.
MAX_LANGS = 256
UNKNOWN = "und"
#: Bytes of text in a slice, about.
SLICE = 4_000_000


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and whether it stands in words (letters and marks)."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    return letter, letter | np.array([k == "M" for k in kinds])


@dataclass
class Words:
    """A slice's words: the document of each, its number among the distinct ones; the distinct ones' features; which documents have a letter."""

    document: np.ndarray
    number: np.ndarray
    bucket: np.ndarray
    begin: np.ndarray
    lettered: np.ndarray

    @property
    def distinct(self) -> int:
        return len(self.begin)


def buckets(points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words in a row, where each word's begin) of words given as code points one after the other and their lengths."""
    ends = np.cumsum(length + 2)
    padded = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(padded), bool)
    inner[ends - 1] = inner[ends - length - 2] = False
    padded[inner] = points
    left = np.repeat(ends, length + 2) - np.arange(len(padded))  # characters from here to the word's end
    hashes, of = [], []
    h = np.zeros(len(padded), np.uint64)
    for n in range(1, ORDER + 1):
        h = (h[: len(padded) - n + 1] * np.uint64(BASE)) + padded[n - 1 :] + np.uint64(1)
        at = np.nonzero(inner if n == 1 else left[: len(h)] >= n)[0]
        hashes.append((mixed(h[at] + np.uint64(n)) >> np.uint64(40)) % np.uint64(BUCKETS))
        of.append(at)
    order = np.argsort(np.concatenate(of), kind="stable")
    where = np.concatenate(of)[order]
    return np.concatenate(hashes)[order].astype(np.int64), np.searchsorted(where, ends - length - 2)


def words_of(texts: pa.Array) -> Words:
    letter, inside = characters()
    data, offsets = buffers(pc.utf8_lower(texts))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    has = np.concatenate([[0], np.cumsum(letter[points])])[bounds]
    word = np.zeros(len(points) + 2, bool)
    word[1:-1] = inside[points]
    fresh = np.zeros(len(points) + 1, bool)
    fresh[bounds] = True
    first = np.nonzero(word[1:-1] & (~word[:-2] | fresh[:-1]))[0]
    last = np.nonzero(word[1:-1] & (~word[2:] | fresh[1:]))[0] + 1
    n = len(points)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(BASE, n))])
    keys = mixed((sums[last] - sums[first]) * powers(INVERSE, n + 1)[first] + (last - first).astype(np.uint64))
    _, index, number = np.unique(keys, return_index=True, return_inverse=True)
    length = (last - first)[index]
    places = np.repeat(first[index] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    bucket, begin = buckets(points[places].astype(np.uint64), length)
    return Words(np.searchsorted(bounds, first, "right") - 1, number, bucket, begin, np.diff(has) > 0)


@dataclass
class LanguageModel:
    """Log-probabilities (language by bucket) and log-priors of languages in the order of their names."""

    langs: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document by language: log of prior and likelihood, whether the document has a letter)."""
        words = words_of(texts)
        out = np.empty((len(texts), len(self.langs)))
        for k, row in enumerate(self.matrix):
            each = np.add.reduceat(row[words.bucket], words.begin) if words.distinct else np.empty(0)
            out[:, k] = self.prior[k] + np.bincount(words.document, each[words.number], len(texts))
        return out, words.lettered

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, its probability) of each text; ties go to the first name."""
        scores, lettered = self.scores(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = scores.argmax(axis=1)
        share = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if seen else UNKNOWN for b, seen in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, share, 0.0)


def count_features(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket and n: how often a language's texts have each feature; bucket -1 counts texts with a letter. Rows without text or language count nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                words, names = words_of(part.column(0)), part.column(1).to_pylist()
                known = {name: i for i, name in enumerate(dict.fromkeys(names))}
                of = np.array([known[name] for name in names], np.int64)
                spread = np.diff(words.begin, append=len(words.bucket))
                for name, i in known.items():
                    own = np.bincount(words.number[of[words.document] == i], minlength=words.distinct)
                    have = tally.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    have[:-1] += np.bincount(words.bucket, np.repeat(own, spread), BUCKETS).astype(np.int64)
                    have[-1] += np.count_nonzero(words.lettered[of == i])
        for name, n in tally.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = documents.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(freeing(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_language(documents: DataFrame, text: str = "text", lang: str = "lang", max_langs: int = MAX_LANGS) -> LanguageModel:
    """A model of all rows with text and language. The driver gets one number for each language and bucket at most; more than max_langs languages are an error.

    Languages none of whose texts has a letter are not learnt; without any, every text is `und`.
    """
    counted = count_features(documents, text, lang).persist()
    try:
        names = sorted(r["lang"] for r in counted.filter("bucket = -1").select("lang").limit(max_langs + 1).collect())
        if len(names) > max_langs:
            raise ValueError(f"more than {max_langs} languages")
        counts, prior = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
        got = counted.toArrow()
    finally:
        counted.unpersist()
    at = {name: i for i, name in enumerate(names)}
    for batch in got.to_batches():
        which = np.array([at.get(name, -1) for name in batch.column("lang").to_pylist()], np.int64)
        bucket, n = batch.column("bucket").to_numpy(), batch.column("n").to_numpy()
        use = (which >= 0) & (bucket >= 0)
        counts[which[use], bucket[use]] = n[use]
        use = (which >= 0) & (bucket < 0)
        prior[which[use]] = n[use]
    matrix = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return LanguageModel(names, matrix, np.log(prior / prior.sum()) if names else prior)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with lang_pred and score, the probability of lang_pred.

    Texts that are null or without letters are `und` with score 0. Rows are judged one by one, so repeated rows need no care;
    existing columns of the two names are replaced. An empty table gives no rows.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    src = df.select(*kept, F.col(text).alias("lang_pred"))  # the text stands where its language will
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept), SLICE):
                langs, share = shared.value.judge(part.column(len(kept)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(share)], names=[*kept, "lang_pred", "score"])

    return src.mapInArrow(freeing(run), src.withColumn("score", F.lit(0.0)).schema)


def op13_language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learnt from the rows that are not held out; see `identify` for nulls and repeated rows."""
    rest = held_out(F.col("doc_id"))
    model = fit_language(documents.filter(~rest).select("text", "lang"))
    return identify(documents.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", rest.alias("held_out"), "lang_pred", "score")
