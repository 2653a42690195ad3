"""Benchmark decontamination by greedy string tiling.

1. Seeds: a document's runs of `min_match` words that also stand in a benchmark item.
2. For each document and item that share a seed, running Karp-Rabin: look for the longest common runs of
   unmarked words, mark them as tiles, go on with shorter ones down to min_match.
3. A pair counts if tiles cover at least `coverage` of the item's words. Tiles lie in any order, so
   passages whose sentences were moved are caught too.

Words are runs of lower-cased ASCII letters and digits and of characters beyond ASCII; common
punctuation beyond ASCII parts words too. They are compared as 64-bit hashes, so step 1 is a few
array operations over a whole batch, and only documents that share a seed are looked at one by one.
The benchmark goes to all executors only up to `broadcast_limit` characters; a larger one is dealt
into blocks of that size, and each block makes its own pass over the documents, one after the other, so that one block at a time is with the executors.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import shared_folder
from .common import dropped, freeing, fresh, slices, staged
from .tokens import ALNUM, buffers, inner_windows, window_hashes, word_hashes

#: Fixed value: punctuation beyond ASCII, as a pattern.
PUNCTUATION = "[\\x{2010}-\\x{203a}\\x{3000}-\\x{303f}\u00a0\u00a1\u00ab\u00bb\u00bf\u00b7]"
MIN_MATCH, COVERAGE, BROADCAST_LIMIT = 5, 0.6, 32_000_000
#: Bytes of text whose words are arrays at once, about.
SLICE = 500_000


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, where each text's words begin)."""
    return word_hashes(*buffers(pc.replace_substring_regex(pc.utf8_lower(texts), PUNCTUATION, " ")), in_word=ALNUM)


def greedy_tiles(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first; ties: first in the item, then in the text.

    Negative ids in text match nothing. Running Karp-Rabin: windows of the search length are compared by
    hash, equal ones are extended word by word; a match of over twice the length restarts the search there.
    """
    used_item, used_text = np.zeros(len(item), bool), text < 0
    tiles: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(item), len(text)) // 2)
    while True:
        found: list[tuple[int, int, int]] = []
        longest = size
        in_item, in_text = _free_windows(used_item, size), _free_windows(used_text, size)
        if len(in_item) and len(in_text):
            where: dict[int, list[int]] = defaultdict(list)
            for p, h in zip(in_item.tolist(), window_hashes(item.astype(np.uint64), size)[in_item].tolist(), strict=True):
                where[h].append(p)
            hashes = window_hashes(text.astype(np.uint64), size)[in_text]
            keys = np.fromiter(where, np.uint64, len(where))
            keep = np.isin(hashes, keys)
            for t, h in zip(in_text[keep].tolist(), hashes[keep].tolist(), strict=True):
                for p in where[h]:
                    if p and t and not used_item[p - 1] and not used_text[t - 1] and item[p - 1] == text[t - 1]:
                        continue  # part of a longer match, which the window before has found
                    n = 0
                    while p + n < len(item) and t + n < len(text) and not used_item[p + n] and not used_text[t + n] and item[p + n] == text[t + n]:
                        n += 1
                    if n >= size:
                        found.append((n, p, t))
                        longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for n, p, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not used_item[p : p + n].any() and not used_text[t : t + n].any():
                used_item[p : p + n] = used_text[t : t + n] = True
                tiles.append((p, t, n))
            else:
                again = True  # what a tile leaves of it may still be long enough
        if again:
            continue
        if size == min_match:
            return tiles
        size = max(min_match, size // 2)


def _free_windows(used: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of `size` words none of which is used."""
    if len(used) < size:
        return np.empty(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(used)])
    return np.nonzero(taken[size:] == taken[:-size])[0]


@dataclass
class Benchmark:
    """Items as arrays of word hashes, and which items have each seed."""

    item_ids: list[int]
    items: list[np.ndarray]
    min_match: int

    @classmethod
    def of(cls, rows: list[tuple[int, str]], min_match: int) -> Benchmark:
        words, bounds = hashed(pa.array([t for _, t in rows], pa.large_string()))
        return cls([i for i, _ in rows], [words[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], min_match)

    def __post_init__(self) -> None:
        # an item of fewer words than a match needs is one seed as a whole
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.width = np.minimum(self.lengths, self.min_match)
        self.sizes = sorted(set(self.width[self.width > 0].tolist()))
        #: By seed length: sorted seeds, where each one's items begin, the items, at how many places of the item the seed stands.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.maybe: dict[int, np.ndarray] = {}
        for k in self.sizes:
            own = np.nonzero(self.width == k)[0]
            windows = [np.unique(window_hashes(self.items[i], k), return_counts=True) for i in own.tolist()]
            hashes, of, times = np.concatenate([w for w, _ in windows]), np.repeat(own, [len(w) for w, _ in windows]), np.concatenate([n for _, n in windows])
            order = np.argsort(hashes, kind="stable")
            keys, starts = np.unique(hashes[order], return_index=True)
            self.seeds[k] = (keys, np.append(starts, len(order)), of[order], times[order])
            # most windows are ruled out by one look at a table of bits
            self.maybe[k] = np.zeros(1 << 20, bool)
            self.maybe[k][keys >> np.uint64(44)] = True

    def shared(self, words: np.ndarray, bounds: np.ndarray, coverage: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, places of the item's seeds) where the seeds can cover enough of the item.

        Shared seeds that stand at n places of the item, repeats counted, cover at most n times their length of it. So a seed that
        most texts and items share makes no pair to be looked at by itself.
        """
        for k in self.sizes:
            keys, starts, items, times = self.seeds[k]
            hashes = window_hashes(words, k)
            at = np.nonzero(self.maybe[k][hashes >> np.uint64(44)] & inner_windows(bounds, k, len(words)))[0]
            seed = np.searchsorted(keys, hashes[at])
            seed[seed == len(keys)] = 0
            hit = keys[seed] == hashes[at]
            at, seed = at[hit], seed[hit]
            many = starts[seed + 1] - starts[seed]
            which = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[seed], many)
            item, place = items[which], np.repeat(at, many)
            pair = (np.searchsorted(bounds, place, "right") - 1) * len(self.items) + item
            order = np.lexsort((which, pair))  # a seed and its item are one number in which
            once = order[(np.diff(pair[order], prepend=-1) != 0) | (np.diff(which[order], prepend=-1) != 0)]
            found, first = np.unique(pair[once], return_index=True)
            n = np.add.reduceat(times[which[once]], first) if len(found) else first
            found = found[n * k / self.lengths[found % len(self.items)] >= coverage]
            use = np.isin(pair, found)
            if not use.any():
                continue
            order = np.lexsort((place[use], pair[use]))
            pair, place = pair[use][order], place[use][order]
            cuts = np.nonzero(np.diff(pair, prepend=-1))[0].tolist()
            for a, b in zip(cuts, [*cuts[1:], len(pair)], strict=True):
                yield int(pair[a]) // len(self.items), int(pair[a]) % len(self.items), place[a:b]

    def matches(self, texts: pa.Array, coverage: float) -> dict[int, list[tuple[int, float, list[tuple[int, int, int]]]]]:
        """By position in texts: (item_id, share of the item's words, tiles) of each item covered by at least `coverage`."""
        words, bounds = hashed(texts)
        out: dict[int, list] = defaultdict(list)
        for text, item, starts in self.shared(words, bounds, coverage):
            x = self.items[item]
            k = int(self.width[item])
            where = np.unique((starts[:, None] + np.arange(k)).ravel())  # only words of shared seeds can lie in tiles
            numbers, ids = np.unique(x, return_inverse=True)
            # a gap between kept words becomes one word that matches nothing
            slot = np.arange(len(where)) + np.cumsum(np.concatenate([[False], np.diff(where) > 1]))
            short = np.full(int(slot[-1]) + 1, -1, np.int64)
            back = np.zeros(len(short), np.int64)
            short[slot], back[slot] = np.searchsorted(numbers, words[where]), where - bounds[text]
            tiles = greedy_tiles(ids, short, k)
            share = sum(n for _, _, n in tiles) / len(x)
            if share >= coverage:
                out[text].append((self.item_ids[item], share, [(p, int(back[t]), n) for p, t, n in tiles]))
        return out


MATCHES = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<item_start:int,text_start:int,length:int>>>>"


def find_contamination(documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The columns `keep` of each document that covers a benchmark item, and matches (see MATCHES, starts in words).

    Documents or items without words match nothing. Each row of documents is judged by itself and each row
    of the benchmark with its own item_id, so repeated rows and ties stay. A null item_id is kept as null.
    A column named matches is replaced. Empty tables give no rows.
    """
    keep = [c for c in keep if c != "matches"]
    src = documents.select(*keep, F.col(text).alias(fresh("text", keep)))
    schema = src.drop(src.columns[-1]).withColumn("matches", F.lit(None).cast(MATCHES)).schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("text_start", pa.int32()), ("length", pa.int32())])))]))

    def pass_over(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in batches:
                for part in slices(batch, len(keep), SLICE):
                    hits = bench.matches(part.column(len(keep)), coverage)
                    rows = sorted(hits)
                    found = [[{"item_id": a, "coverage": b, "tiles": [dict(zip(("item_start", "text_start", "length"), x, strict=True)) for x in c]} for a, b, c in sorted(hits[i], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))] for i in rows]
                    if rows:
                        some = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(found, kind)], names=[*keep, "matches"])

        return src.mapInArrow(freeing(run), schema)

    out = None
    for shared, last in _broadcasts(benchmark, min_match, broadcast_limit):
        more = pass_over(shared)
        if not last:
            more = staged(more, "contamination")  # the next block's broadcast comes when this one's has gone
            shared.unpersist(blocking=True)
        out = more if out is None else out.unionByName(more)
    return out


def _broadcasts(benchmark: DataFrame, min_match: int, limit: int) -> Iterator[tuple[Broadcast, bool]]:
    """Each block of the benchmark as a broadcast, and whether it is the last one."""
    context = benchmark.sparkSession.sparkContext
    n, blocks = _blocks(benchmark.select("item_id", "text"), limit)
    for i, block in enumerate(blocks):
        yield context.broadcast(Benchmark.of(block, min_match)), i == n - 1


def _blocks(benchmark: DataFrame, limit: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks, and the items in blocks of about `limit` characters at most, one block on the driver at a time. A single longer item is a block."""
    size = F.char_length(F.coalesce("text", F.lit(""))) + 1
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    n = 1 if total <= limit else -(-2 * total // limit)
    dealt = benchmark.withColumn("__b", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    if n > 1:  # each block reads its own files
        dealt = dealt.select("__b", "item_id", "text")
        path = f"{shared_folder(benchmark.sparkSession).rstrip('/')}/marginalia/benchmark-{uuid.uuid4().hex}"
        dealt.repartition("__b").write.partitionBy("__b").parquet(path)
        dealt = benchmark.sparkSession.read.schema("item_id long, text string, __b long").parquet(path)
    return n, ([(r["item_id"], r["text"]) for r in dealt.filter(F.col("__b") == b).collect()] for b in range(n))


def op3_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it covers: doc_id, item_id, coverage, n_tiles, n_words in tiles."""
    found = find_contamination(documents, benchmark, ["doc_id"])
    each = found.select("doc_id", F.explode("matches").alias("m"))
    return each.select(
        "doc_id",
        "m.item_id",
        "m.coverage",
        F.size("m.tiles").cast("long").alias("n_tiles"),
        F.aggregate("m.tiles", F.lit(0).cast("long"), lambda a, t: a + t["length"]).alias("n_words"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The documents that cover no benchmark item: the same columns, repeated rows kept.

    Judged row by row, without a join back by doc_id, in one pass for each block of the benchmark; null texts stay.
    """
    at = documents.columns.index("text")

    def pass_over(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at, SLICE):
                    clean = np.ones(part.num_rows, bool)
                    clean[list(shared.value.matches(part.column(at), coverage))] = False
                    yield part.filter(pa.array(clean))

        return docs.mapInArrow(freeing(run), documents.schema)

    kept, before = documents, None
    for shared, last in _broadcasts(benchmark, MIN_MATCH, limit):
        kept = pass_over(kept, shared)
        if not last:
            kept = staged(kept, "decontaminated")  # the next block's broadcast comes when this one's has gone
            shared.unpersist(blocking=True)
            if before is not None:
                dropped(before)
            before = kept
    return kept
