"""Stupid-backoff scores of documents by n-gram counts of the whole corpus, each document's own counts left out.

    S(w | u v) = c(u v w) / c(u v)   if c(u v w) > 0, else 0.4 S(w | v)
    S(w | v)   = c(v w) / c(v)       if c(v w) > 0,   else 0.4 S(w)
    S(w)       = max(c(w), 0.4) / N

All counts c and N (words) are those of the other documents, so an n-gram that only the document itself has
backs off. The relational plan, with n-grams as 64-bit hashes:

1. Documents are dealt into chunks by hash and travel there once, compressed. A chunk explodes its n-grams of one order
   into a sorted list of distinct hashes with counts, cut by ranges of the hash: the parts of the count table.
2. Each part adds up the counts of equal hashes over all chunks and joins the sums back to the chunks' lists. As hashes and
   lists are sorted, the sums come back as bare numbers in the list's order.
3. The next order is exploded only where both n-grams that an n-gram holds stand in other documents; nowhere else can it.
4. A chunk looks its words' counts up and sums the logarithms for each document.

Rows of the shuffles are packed: the n-grams that a chunk sends to a part of the count table are one list, of some six bytes for each n-gram,
and less than one for each sum. Empty lists are not sent, so there are never more of them than exploded n-grams (pairs of chunk and
n-gram), however many chunks and parts there are. No n-gram is hot: a chunk sends each of its n-grams once. Chunks and parts
grow in number with the corpus, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, staged
from .tokens import buffers, inner_windows, window_hashes, word_hashes

BACKOFF = 0.4
#: Bytes of text in a chunk, about, and of the text whose n-grams a part of the count table holds.
CHUNK_BYTES, PART_BYTES = 8_000_000, 16_000_000


ZSTD = pa.Codec("zstd", compression_level=6)


def _squeezed(raw: bytes) -> bytes:
    return np.int64([len(raw)]).tobytes() + ZSTD.compress(raw, asbytes=True)


def _restored(blob: bytes) -> bytes:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return ZSTD.decompress(blob[8:], n, asbytes=True) if n else b""


def pack_hashes(sorted_hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences of six bytes, of which the highest, mostly small, is compressed; larger differences follow in full."""
    d = np.diff(sorted_hashes, prepend=np.uint64(0))
    large = np.nonzero(d >= np.uint64(1 << 48))[0]
    octets = np.ascontiguousarray(d).view(np.uint8).reshape(-1, 8)
    top = _squeezed(octets[:, 5].tobytes())
    return b"".join([np.int64([len(d), len(large), len(top)]).tobytes(), octets[:, :5].tobytes(), large.astype(np.int64).tobytes(), d[large].tobytes(), top])


def unpack_hashes(blob: bytes) -> np.ndarray:
    n, m, _ = np.frombuffer(blob, np.int64, 3).tolist()
    d = np.zeros((n, 8), np.uint8)
    d[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 24).reshape(n, 5)
    d[:, 5] = np.frombuffer(_restored(blob[24 + 5 * n + 16 * m :]), np.uint8)
    d = d.view(np.uint64).ravel()
    d[np.frombuffer(blob, np.int64, m, 24 + 5 * n)] = np.frombuffer(blob, np.uint64, m, 24 + 5 * n + 8 * m)
    return np.cumsum(d, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as single bytes; 255 stands for a larger one, which follows in full; compressed."""
    large = counts >= 255
    return np.int64([len(counts)]).tobytes() + _squeezed(np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    raw = _restored(blob[8:])
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], np.int64)
    return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


class Chunk:
    """The words of a chunk's texts and, for each order, the distinct n-grams and each position's place among them."""

    def __init__(self, texts: pa.Array):
        self.words, self.bounds = word_hashes(*buffers(texts))
        self.text_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def grams(self, order: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, their counts, positions of the n-grams' last words, places of those n-grams)."""
        starts = np.nonzero(inner_windows(self.bounds, order, len(self.words)))[0]
        last = starts + order - 1
        if alive is not None:
            starts, last = starts[alive[last]], last[alive[last]]
        hashes = window_hashes(self.words, order)[starts]
        distinct, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        return distinct, counts, last, place

    def others(self, order: int, sums: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """For each position the count in other documents of the n-gram that ends there; 0 where there is none."""
        distinct, _, last, place = self.grams(order, alive)
        out = np.zeros(len(self.words), np.int64)
        if len(place):
            _, own, times = np.unique(self.text_of[last] * np.int64(len(distinct)) + place, return_inverse=True, return_counts=True)
            out[last] = sums[place] - times[own]
        return out


def open_places(counts: np.ndarray) -> np.ndarray:
    """Positions whose n-gram, and that of the word before, stand in other documents: only there can the next order."""
    return (counts > 0) & (np.concatenate([[0], counts[:-1]]) > 0) if len(counts) else np.zeros(0, bool)


LISTS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
LISTS_DDL = "part long, chunk long, kind int, hashes binary, counts binary"
SUMS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("sums", pa.binary())])
SUMS_DDL = "chunk long, kind int, part long, sums binary"


def _lists(chunk: int, kind: int, distinct: np.ndarray, counts: np.ndarray, parts: int) -> list[dict]:
    cuts = np.searchsorted(part_of(distinct, parts), np.arange(parts + 1, dtype=np.uint64))
    return [
        {"part": p, "chunk": chunk, "kind": kind, "hashes": pack_hashes(distinct[a:b]), "counts": pack_counts(counts[a:b])}
        for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        if a < b
    ]


def _sums_of(table: pa.Table, kind: int) -> np.ndarray:
    """A chunk's sums of one kind, in the order of its hashes."""
    rows = sorted((p, s) for k, p, s in zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["sums"].to_pylist(), strict=True) if k == kind)
    return np.concatenate([unpack_counts(s) for _, s in rows]) if rows else np.empty(0, np.int64)


def _add_up(table: pa.Table) -> pa.Table:
    """One part of the count table: sums over all chunks, in each chunk's own order. Rows without hashes pass through."""
    out = []
    rows = table.to_pylist()
    for kind in sorted({r["kind"] for r in rows if r["hashes"]}):
        own = [r for r in rows if r["kind"] == kind and r["hashes"]]
        lists, counts = [unpack_hashes(r["hashes"]) for r in own], [unpack_counts(r["counts"]) for r in own]
        _, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)[place]  # exact below 2**53
        ends = np.cumsum([len(x) for x in lists])
        out += [{"chunk": r["chunk"], "kind": kind, "part": r["part"], "sums": pack_counts(t)} for r, t in zip(own, np.split(total, ends[:-1]), strict=True)]
    out += [{"chunk": r["chunk"], "kind": r["kind"], "part": r["part"], "sums": r["counts"]} for r in rows if not r["hashes"]]
    return pa.Table.from_pylist(out, SUMS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of a batch: ids and one compressed string of the texts with their lengths."""
    for batch in batches:
        chunk = np.asarray(batch.column(0))
        order = np.argsort(chunk, kind="stable")
        cuts = np.nonzero(np.diff(chunk[order], prepend=-1, append=-1))[0]
        rows: dict[str, list] = {"chunk": [], "ids": [], "lengths": [], "size": [], "texts": []}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.take(pa.array(order[a:b]))
            data, offsets = buffers(part.column(2))
            raw = data[offsets[0] : offsets[-1]].tobytes()
            for name, value in (("chunk", int(chunk[order[a]])), ("ids", part.column(1)), ("lengths", np.diff(offsets).astype(np.int64).tobytes()), ("size", len(raw)), ("texts", ZSTD.compress(raw, asbytes=True))):
                rows[name].append(value)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in rows["ids"]])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(rows["ids"]) if rows["ids"] else batch.column(1).slice(0, 0))
        yield pa.RecordBatch.from_arrays([pa.array(rows["chunk"], pa.int64()), ids, pa.array(rows["lengths"], pa.binary()), pa.array(rows["size"], pa.int64()), pa.array(rows["texts"], pa.binary())], names=list(rows))


def _chunk(table: pa.Table) -> tuple[int, pa.Array, Chunk]:
    """(number, ids, words) of a chunk from its packed rows."""
    ids = table["ids"].combine_chunks().flatten()
    lengths = np.concatenate([np.frombuffer(x, np.int64) for x in table["lengths"].to_pylist()])
    raw = b"".join(ZSTD.decompress(t, n, asbytes=True) if n else b"" for n, t in zip(table["size"].to_pylist(), table["texts"].to_pylist(), strict=True))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return table["chunk"][0].as_py(), ids, Chunk(pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(raw)))


def stupid_backoff(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_words long, log_score (sum of natural logarithms) of every row by all rows' n-grams up to order 3.

    Words are what stands between ASCII white space, with A-Z folded. Null, empty and blank texts: no words and
    a score of 0. Each row is a document of its own, repeated ids and texts too. A corpus of one document has
    N = 1 left. An empty table gives an empty table. Texts are read whole.
    """
    size = documents.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))))).first()[0] or 0
    chunks, parts = int(size // CHUNK_BYTES) + 1, int(size // PART_BYTES) + 1
    id_type = documents.schema[id_col].dataType.simpleString()
    dealt = documents.select(F.pmod(F.xxhash64(id_col, text), F.lit(chunks)).alias("chunk"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    texts = dealt.mapInArrow(freeing(_packed), f"chunk long, ids array<{id_type}>, lengths binary, size long, texts binary").groupBy("chunk")

    def first(table: pa.Table) -> pa.Table:
        chunk, _, c = _chunk(table)
        return pa.Table.from_pylist(_lists(chunk, 1, *c.grams(1)[:2], parts), LISTS)

    def following(order: int):
        def explode(table: pa.Table, sums: pa.Table) -> pa.Table:
            chunk, _, c = _chunk(table)
            have = {k: _sums_of(sums, k) for k in range(1, order)}
            counts = c.others(1, have[1])
            for k in range(2, order):
                counts = c.others(k, have[k], open_places(counts))
            rows = _lists(chunk, order, *c.grams(order, open_places(counts))[:2], parts)
            rows += [{"part": chunk % parts, "chunk": chunk, "kind": k, "hashes": None, "counts": pack_counts(s)} for k, s in have.items()]
            return pa.Table.from_pylist(rows, LISTS)

        return explode

    def third(table: pa.Table, sums: pa.Table) -> pa.Table:
        _, ids, c = _chunk(table)
        one = c.others(1, _sums_of(sums, 1))
        two = c.others(2, _sums_of(sums, 2), open_places(one))
        three = c.others(3, _sums_of(sums, 3), open_places(two))
        one_before, two_before = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (one, two))
        by_three, by_two = three > 0, (three == 0) & (two > 0)
        by_one = ~by_three & ~by_two
        place = np.arange(len(c.words)) - c.bounds[:-1][c.text_of]
        steps = np.where(by_three, 0, np.where(by_two, np.minimum(place - 1, 1), np.minimum(place, 2)))  # times backed off
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(by_three, np.log(three) - np.log(two_before), np.where(by_two, np.log(two) - np.log(one_before), np.log(np.maximum(one, BACKOFF))))
        logs = logs + steps * np.log(BACKOFF)
        n = len(c.bounds) - 1
        add = lambda x: np.bincount(c.text_of, weights=x, minlength=n)
        return pa.table({"id": ids, "n_words": pa.array(np.diff(c.bounds), pa.int64()), "logs": pa.array(add(logs), pa.float64()), "by_one": pa.array(add(by_one).astype(np.int64))})

    lists = texts.applyInArrow(first, LISTS_DDL)
    for order in (2, 3):
        sums = lists.groupBy("part").applyInArrow(_add_up, SUMS_DDL)
        lists = texts.cogroup(sums.groupBy("chunk")).applyInArrow(following(order), LISTS_DDL)
    all_sums = lists.groupBy("part").applyInArrow(_add_up, SUMS_DDL)
    scored = staged(texts.cogroup(all_sums.groupBy("chunk")).applyInArrow(third, f"id {id_type}, n_words long, logs double, by_one long"), "lm-scores")
    total = scored.agg(F.sum("n_words")).first()[0] or 0
    rest = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    return scored.select(F.col("id").alias(id_col), "n_words", (F.col("logs") - F.col("by_one") * F.log(rest)).alias("log_score"))


def op7_lm_score(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score (null without words); rounded."""
    out = stupid_backoff(documents)
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), mean.alias("mean_log_score"))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM words),
g AS (
  SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM places),
c AS (
  SELECT doc_id, i,
    count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, doc_id) AS c1,
    CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, doc_id) END AS c2,
    CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, doc_id) END AS c3,
    greatest(count(*) OVER () - count(*) OVER (PARTITION BY doc_id), 1) AS rest FROM g),
b AS (SELECT *, lag(c1) OVER w AS p1, lag(c2) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3) - ln(p2)
    WHEN c2 > 0 THEN ln(c2) - ln(p1) + least(i - 2, 1) * ln(0.4)
    ELSE ln(greatest(c1, 0.4)) - ln(rest) + least(i - 1, 2) * ln(0.4) END AS x FROM b),
d AS (SELECT doc_id, count(*) AS n_words, sum(x) AS log_score FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::bigint AS n_words, round(coalesce(log_score, 0), 4) AS log_score, round(log_score / n_words, 6) AS mean_log_score
FROM documents LEFT JOIN d USING (doc_id)"""
