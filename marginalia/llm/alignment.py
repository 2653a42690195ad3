"""Alignment of two tokenizers over the same texts, and how often their tokens meet.

1. A slice of documents is encoded both ways. The tokens' byte ends are cumulative sums; the ends that both share cut the
   slice into groups, a token's group is found by binary search, and the tokens that overlap are expanded by repetition. All
   this is array work over the slice.
2. A slice's distinct pairs with their document counts are summed by Spark in two stages, first by (pair, salt), then by
   pair, so a pair that stands in every slice is never one task's rows.
3. Counts go back to the slices that hold the pair, one row for each pair and slice, and meet the slice's documents there.

Documents travel once, with their pairs as places in the slice's list of pairs. Nothing is broadcast: the table of pairs is joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PRE_TOKEN, TrieBPE, byte_alphabet
from .common import freeing, slices, staged

#: Bytes of text in a slice, about (a longer text is a slice of its own), and the salts of a pair's first sum.
SLICE, SALTS = 2_000_000, 16
#: Ids below it; a pair is a * IDS + b.
IDS = 1 << 20
#: Runs of white space that the fast encoder's pattern engine has no stack for.
LONG_SPACE = re.compile(r"\s{1000}")
SPACE_MARK = "▁"


class ByteLevel:
    """Encodes space + text by a byte-level BPE vocabulary (a tokenizers JSON file); strings of special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], {c: b for b, c in byte_alphabet().items()}
        special = {a["content"] for a in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        made = [ranks[b"".join(bytes(to_byte[c] for c in half) for half in (m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.path = path
        self.bytes_of = [b""] * (1 + max(ranks.values()))
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.fast = tiktoken.Encoding("plain", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.slow: TrieBPE | None = None

    def encode(self, texts: list[str]) -> list:
        return [self._long(" " + t) if LONG_SPACE.search(t) else self.fast.encode_ordinary(" " + t) for t in texts]

    def _long(self, text: str) -> np.ndarray:
        if self.slow is None:
            self.slow = TrieBPE(self.path)
            self.slow.added_re = None
        return self.slow.encode_batch([text])[0]


class Pieces:
    """Encodes texts by a sentencepiece model, which puts the space before them itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(self.model.get_piece_size())
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i in kinds for p in (self.model.id_to_piece(i),)]

    def encode(self, texts: list[str]) -> list:
        return self.model.encode(texts, num_threads=1)


class Side:
    """One tokenizer's ids: their widths, their bytes and their decimal text with what follows it inside and at the end of a group."""

    def __init__(self, encoder: ByteLevel | Pieces, inside: str, last: str):
        self.encode = encoder.encode
        self.size = len(encoder.bytes_of)
        if self.size > IDS:
            raise ValueError(f"{self.size} ids are more than {IDS}")
        self.width = np.array([len(b) for b in encoder.bytes_of], np.int64)
        self.raw = pa.array(encoder.bytes_of, pa.large_binary())
        self.shown = pa.array([f"{i}{x}" for x in (inside, last) for i in range(self.size)], pa.large_string())

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return _bytes(self.raw.take(pa.array(ids)))


def _bytes(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(2, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)


class Aligner:
    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces):
        self.a, self.b = Side(a, ",", "|"), Side(b, ",", ";")
        self.shown = pa.concat_arrays([self.a.shown, self.b.shown])

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where a text is empty or either side's bytes are not those of space + text."""
        use = [i for i, t in enumerate(texts) if t]
        none = np.empty(0, np.int64)
        out: tuple[list, list] = ([none] * len(texts), [none] * len(texts))
        if not use:
            return out
        some = [texts[i] for i in use]
        coded = [[np.asarray(ids, np.int64) for ids in side.encode(some)] for side in (self.a, self.b)]
        raw = [np.frombuffer(f" {t}".encode(), np.uint8) for t in some]
        whole = np.concatenate(raw)
        same = all(np.array_equal(side.bytes(np.concatenate(ids)), whole) and all(side.width[i].sum() == len(r) for i, r in zip(ids, raw, strict=True)) for side, ids in zip((self.a, self.b), coded, strict=True))
        for k, i in enumerate(use):
            if same or all(np.array_equal(side.bytes(ids[k]), raw[k]) for side, ids in zip((self.a, self.b), coded, strict=True)):
                out[0][i], out[1][i] = coded[0][k], coded[1][k]
        return out

    def align(self, texts: list[str]) -> dict[str, object]:
        """By text: n_a, n_b, n_groups, n_links, groups as text, and `keys`, `times`: text << 40 | pair and how often it is linked there, sorted."""
        of_a, of_b = self.encoded(texts)
        n = len(texts)
        n_a, n_b = np.array([len(x) for x in of_a], np.int64), np.array([len(x) for x in of_b], np.int64)
        a, b = np.concatenate([*of_a, np.empty(0, np.int64)]), np.concatenate([*of_b, np.empty(0, np.int64)])
        width = self.a.width[a]
        end_a, end_b = np.cumsum(width), np.cumsum(self.b.width[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        # groups as text: a group's tokens of a, then those of b
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=len(cuts)))])
        until_a = np.cumsum(np.bincount(group_a, minlength=len(cuts)))
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + before_b[group_a]] = a + self.a.size * (cuts[group_a] == end_a)
        shown[np.arange(len(b)) + until_a[group_b]] = 2 * self.a.size + b + self.b.size * (cuts[group_b] == end_b)
        line = self.shown.take(pa.array(shown))
        data = _bytes(line).tobytes()
        places = np.frombuffer(line.buffers()[1], np.int64)[: len(line) + 1] if len(line) else np.zeros(1, np.int64)
        stops = places[np.cumsum(n_a + n_b)].tolist()
        groups = [data[i : j - 1].decode() if j > i else "" for i, j in zip([0, *stops], stops, strict=False)]
        # links: a token of a meets the tokens of b from the first that ends behind its begin to the first that ends at its end or behind it
        first = np.searchsorted(end_b, end_a - width, "right")
        many = np.searchsorted(end_b, end_a) - first + 1
        where = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        keys = np.repeat((np.repeat(np.arange(n), n_a) << 40) + a * IDS, many) + b[where]
        keys, times = np.unique(keys, return_counts=True)
        text = keys >> 40
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(np.repeat(np.arange(n), n_a)[np.searchsorted(end_a, cuts)], minlength=n),
            "n_links": np.bincount(text, times, n).astype(np.int64),
            "groups": groups,
            "keys": keys,
            "times": times,
        }


def packed(x: np.ndarray) -> bytes:
    """Small numbers in as few bytes each as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n]).astype(np.int64) if n else np.empty(0, np.int64)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(ByteLevel(path_a), Pieces(path_b))


#: A row for each document (pairs and docs are null) and one for each slice (only slice, pairs and docs are set).
ALIGNED = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_pairs int, places binary, times binary, pairs array<long>, docs array<long>"
_KINDS = pa.schema([("slice", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("n_pairs", pa.int32()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])


def aligned(documents: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """ALIGNED: each document's tokens and groups (`a1,a2|b1;a3|b2`), and each slice's distinct pairs (a << 20 | b) with the number of its documents that hold them.

    Texts that are null, empty or changed by either tokenizer have no tokens: zeros and empty groups. A row for each row,
    repeated ones too; other columns than doc_id and the text are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                got = both.align([t or "" for t in part.column(1).to_pylist()])
                keys, rows = got["keys"], part.num_rows
                pairs, places, docs = np.unique(keys & ((1 << 40) - 1), return_inverse=True, return_counts=True)
                bounds = np.searchsorted(keys >> 40, np.arange(rows + 1))
                spans = list(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))
                own = [
                    pa.array([number] * rows, pa.int64()),
                    part.column(0),
                    *(pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(got["groups"], pa.string()),
                    pa.array(np.diff(bounds), pa.int32()),
                    pa.array([packed(np.diff(places[i:j], prepend=0)) for i, j in spans], pa.binary()),
                    pa.array([packed(got["times"][i:j]) for i, j in spans], pa.binary()),
                    pa.nulls(rows, pa.list_(pa.int64())),
                    pa.nulls(rows, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(own, schema=_KINDS)
                yield pa.RecordBatch.from_pylist([{"slice": number, "pairs": pairs, "docs": docs}], schema=_KINDS)
                number += 1
        aligner.cache_clear()  # the worker may go on to other stages

    return documents.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(freeing(run), ALIGNED)


def pairs_of(table: DataFrame) -> DataFrame:
    """slice, place, pair and docs of each distinct pair of each slice of an ALIGNED table."""
    each = table.filter("pairs IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x"))
    return each.select("slice", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (no pair of the same id of a has more).

    Summed by pair and salt, then by pair. The pairs of one id of a are at most as many as there are ids of b.
    """
    salted = pairs.groupBy("pair", F.pmod("slice", F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counted = salted.groupBy("pair").agg(F.sum("docs").alias("count"))
    own = Window.partitionBy(F.shiftright("pair", 20))
    return counted.withColumn("best", F.col("count") == F.max("count").over(own))


def _judged(docs: pa.Table, known: pa.Table) -> pa.Table:
    """n_best and count_sum of a slice's documents from the counts of its pairs, in any order."""
    places = known.column("place").to_numpy()
    count, best = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    count[places], best[places] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
    rows = []
    for n, where, times in zip(*(docs.column(c).to_pylist() for c in ("n_pairs", "places", "times")), strict=True):
        at, t = np.cumsum(unpacked(where, n)), unpacked(times, n)
        rows.append((int(t @ best[at]), int(t @ count[at])))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    found = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
    return pa.table([*kept.columns, *found, docs.column("groups_sha256")], names=[*kept.column_names, "n_best", "count_sum", "groups_sha256"])


def op11_token_alignment(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document; see `aligned` for nulls, repeated rows and empty tables."""
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    digest = F.when(F.col("groups") == "", "").when(F.col("groups").isNotNull(), F.sha2("groups", 256)).alias("groups_sha256")
    table = staged(aligned(documents, path_a, path_b).select("*", digest).drop("groups"), "aligned")
    pairs = pairs_of(table)
    known = pairs.join(pair_counts(pairs), "pair").select(F.col("slice").alias("of"), "place", "count", "best")
    docs = table.filter("pairs IS NULL").drop("pairs", "docs")
    return docs.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(_judged, out)
