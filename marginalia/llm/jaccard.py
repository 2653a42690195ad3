"""Exact Jaccard self-join of texts' word n-grams.

1. Each text becomes a set of shingles (64-bit hashes) with a 128-bit fingerprint and tile keys; texts with equal sets are
   one class from here on.
2. Tiles: sizes are dealt into bands, and a pair belongs to the band of its smaller set. Two sets that are
   similar enough differ in at most d elements (d: the band's bound), so of d + 1 parts or more, dealt by hash, that are not empty one is
   equal in both. A tile is a band and an equal part. A passage that many texts share fills no tile by itself, as
   its shingles fall into different parts, beside each text's own.
3. Tiles that share members form a group. Each set is sent once, to its group, and its pairs are decided there: a bitmap of DENSITY or
   more hashed bits for each element of a set gives an upper bound of the overlap from bit counts; pairs that pass it and that
   the links so far leave apart are decided by intersecting the sorted arrays.
4. A group beyond GROUP_ROWS sets or GROUP_ELEMENTS elements goes tile by tile: first each tile's first member with all others, then all
   pairs that these links leave in different components: in turns, BLOCK members outside the tile's largest component meet all others,
   which are dealt into parts. A turn's rows follow the members; only a tile of more than BLOCK such members needs another.
5. Components of the links, with a class as one vertex.

Nothing is capped or sampled: the pigeonhole in 2 and the bound in 3 lose no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freeing, slices, staged
from .components import connected_components
from .tokens import buffers, inner_windows, mixed, window_hashes, word_hashes

DENSITY, BAND, SLACK = 4, 1.6, 1.15
#: Ids that go to all executors at most; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets that a task remembers in order to emit the keys of equal sets once.
REMEMBERED = 300_000
#: Bounds of what one worker holds at once: sets and elements of a group, and about the members of a tile's part and the pivots that meet them.
GROUP_ROWS, GROUP_ELEMENTS, BLOCK = 1024, 2_000_000, 1024


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after another, where each text's set begins)."""
    words, bounds = word_hashes(*buffers(texts))
    n = np.diff(bounds)
    grams = window_hashes(words, size)
    inside = inner_windows(bounds, size, len(words))
    sets: list[np.ndarray] = []
    for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), n.tolist(), strict=True):
        if k >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        else:  # fewer words: the whole sequence as one
            sets.append(window_hashes(words[a:b], k) if k else np.empty(0, np.uint64))
    assert int(inside.sum()) == int(np.maximum(n - size + 1, 0).sum())
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), offsets


class Bands:
    """Size bands and, for each, the most elements in which two linked sets can differ."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        self.percent = percent
        edges = [1]
        ratio = max(BAND, 100 / percent * 1.05)
        while edges[-1] <= largest:
            edges.append(int(edges[-1] * ratio) + 1)
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        # |x| <= |y| <= 100 |x| / p and 100 |x & y| >= p |x | y| give a difference of at most (100 - p) (|x| + |y|) / (100 + p)
        self.most = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
        self.parts = np.ceil((self.most + 1) * SLACK).astype(np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1

    def smaller_partner(self, sizes: np.ndarray) -> np.ndarray:
        """Band of the smallest set that can be linked to a set of this size."""
        return self.of(np.maximum(-(-sizes * self.percent // 100), 1))


def tile_keys(flat: np.ndarray, offsets: np.ndarray, band: np.ndarray, wanted: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all sets one after another, where each set's keys begin) for the tiles of `band`; none where not wanted."""
    n = np.diff(offsets)
    use = wanted & (n > 0) & (bands.most[band] > 0)  # a band without a difference links equal sets only
    parts = np.where(use, bands.parts[band], 0)
    base = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(n)), n)
    live = use[owner]
    elements, owner = flat[live], owner[live]
    slot = base[owner] + (elements % parts[owner].astype(np.uint64)).astype(np.int64)
    total = int(parts.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, slot, mixed(elements ^ np.uint64(0x5851F42D4C957F2D)))
    filled = np.bincount(slot, minlength=total) > 0 if total else np.zeros(0, bool)
    whose = np.repeat(np.arange(len(n)), parts)
    count = np.bincount(whose, weights=filled, minlength=len(n)) if total else np.zeros(len(n))
    # sets with too few filled parts for the pigeonhole show their empty ones too
    shown = filled | (count <= bands.most[band])[whose]
    place = (np.arange(total) - base[whose]).astype(np.uint64)
    keys = mixed(sums + mixed(place * np.uint64(0x9E3779B97F4A7C15) + band[whose].astype(np.uint64) + np.uint64(1)))
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(whose[shown], minlength=len(n)), out=starts[1:])
    return keys[shown], starts


def fingerprints(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat + np.uint64(salt)))])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def bitmaps(flat: np.ndarray, offsets: np.ndarray, like: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of all bitmaps one after another, where each begins). Lengths are powers of two, so a longer one folds onto a
    shorter; by each set's own size or, for all alike, for a set of `like` elements."""
    n = np.diff(offsets)
    sized = n if like is None else np.full(len(n), like)
    words = 1 << np.maximum(np.ceil(np.log2(np.maximum(sized * DENSITY / 64, 1))).astype(np.int64), 2)
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(words, out=starts[1:])
    owner = np.repeat(np.arange(len(n)), n)
    h = mixed(flat + np.uint64(0xA0761D6478BD642F)) & (words[owner].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    out = np.zeros(int(starts[-1]), np.uint64)
    np.bitwise_or.at(out, starts[owner] + (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out, starts


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def may_link(x: np.ndarray, nx: int, ys: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether bit counts allow the links of one bitmap with each of several: an element whose bit the other lacks is in one set only."""
    over = np.minimum(nx - np.bitwise_count(x & ~ys).sum(1).astype(np.int64), ny - np.bitwise_count(ys & ~x).sum(1).astype(np.int64))
    return over * (100 + percent) >= (nx + ny) * percent


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """A table for each run of rows that are equal in the first `keys` columns (longs), however batches cut it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != v for c, v in zip(cols, last, strict=True))
        last = [c[-1] for c in cols]
        cuts = [0, *[i for i in np.nonzero(change)[0].tolist() if i], batch.num_rows]
        if change[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64), pa.int64()))


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _sketches(documents: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """id, n and the set's fingerprint f0, f1 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                flat, offsets = shingle_sets(part.column(1), size)
                f0, f1 = fingerprints(flat, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(f0), pa.array(f1)], names=["id", "n", "f0", "f1"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(freeing(run), "id long, n long, f0 long, f1 long")


def _keyed(documents: DataFrame, id_col: str, text: str, size: int, percent: int) -> DataFrame:
    """key, id: the tile keys of each row with an id, unless the task has seen an equal set before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            for part in slices(batch, 1):
                flat, offsets = shingle_sets(part.column(1), size)
                n, ids = np.diff(offsets), np.asarray(part.column(0))
                fresh = np.zeros(len(n), bool)
                for i, key in enumerate(np.stack(fingerprints(flat, offsets), axis=1).view("V16").ravel().tolist()):
                    if key not in seen:
                        fresh[i] = True
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(key)
                own = np.maximum(bands.of(n), 0)
                below = np.maximum(bands.smaller_partner(n), 0)
                for keys, starts in (tile_keys(flat, offsets, own, fresh, bands), tile_keys(flat, offsets, below, fresh & (below < own), bands)):
                    whose = np.repeat(ids, np.diff(starts))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(whose)], names=["key", "id"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL").mapInArrow(freeing(run), "key long, id long")


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows whose key has another id, from rows sorted by key and id; one row is held over, whatever a key's rows."""
    held = None  # the last row, and whether it has gone out
    for batch in batches:
        if not batch.num_rows:
            continue
        k, v = (np.asarray(c) for c in batch.columns)
        sent = False
        if held is not None:
            k, v, sent = np.concatenate([[held[0]], k]), np.concatenate([[held[1]], v]), held[2]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
        k, v = k[first], v[first]
        same = k[1:] == k[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        keep[0] &= not sent
        held = (k[-1], v[-1], bool(keep[-1]) or (sent and len(k) == 1))
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(v[keep])], names=["key", "id"])


def linked_rows(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) of a group's rows that are not their own component; rows of one id are one."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, n))
    ids, n, sets = ids[order], n[order], [sets[i] for i in order.tolist()]
    label = np.unique(ids, return_inverse=True)[1]
    bands = Bands(percent, int(n[-1]))
    band = bands.of(n)
    ends = np.searchsorted(n, 100 * n // percent, "right")
    for b in np.unique(band).tolist():
        lo, hi = np.searchsorted(band, b), np.searchsorted(band, b, "right")
        top = int(ends[hi - 1])  # sizes differ by less than a band's ratio from here on
        offsets = np.concatenate([[0], np.cumsum(n[lo:top])])
        bits = bitmaps(np.concatenate(sets[lo:top]), offsets, like=int(n[top - 1]))[0].reshape(top - lo, -1)
        for i in range(lo, hi):
            js = np.arange(i + 1, ends[i])
            js = js[label[js] != label[i]]
            if len(js):
                js = js[may_link(bits[i - lo], n[i], bits[js - lo], n[js], percent)]
            for j in js.tolist():
                if label[j] != label[i]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
    # labels count distinct ids upwards, so the least label of a component is that of its least id
    least = np.unique(ids)[label]
    out = np.unique(np.stack([ids, least], axis=1)[ids != least], axis=0)
    return out[:, 0], out[:, 1]


def _decided(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_runs(batches, 1):
            a, b = linked_rows(group["id"].to_numpy(), _unpacked(group["shingles"]), percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _possible(pairs: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that bit counts allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            keep = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            xs, ys = batch.column(3), batch.column(5)
            for i in np.nonzero(keep)[0].tolist():
                x, y = np.asarray(xs[i].values).view(np.uint64), np.asarray(ys[i].values).view(np.uint64)
                w = min(len(x), len(y))
                keep[i] = may_link(folded(x, w), na[i], folded(y, w)[None, :], nb[i : i + 1], percent)[0]
            yield batch.select([0, 1]).filter(pa.array(keep))

    left, right = small.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), small.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "xa", "nb", "xb").mapInArrow(freeing(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by sorted-array intersection. Only sets of some pair are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                keep = np.zeros(part.num_rows, bool)
                for i, (x, y) in enumerate(zip(_unpacked(part.column(2)), _unpacked(part.column(3)), strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield part.select([0, 1]).filter(pa.array(keep))

    pairs = staged(pairs, "jaccard-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets.join(_everywhere(asked), "id", "left_semi")
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(freeing(run), "a long, b long")


def _everywhere(ids: DataFrame) -> DataFrame:
    """ids as one side of a join: sent to all executors if there are BROADCAST_IDS at most."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _part_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of a part's own rows with pivots, its own or visiting ones, with different labels that the bit counts allow."""
        for group in sorted_runs(batches, 2):
            own, pivot, ids, label, n = (group[c].to_numpy() for c in ("own", "pivot", "id", "label", "n"))
            bits = [np.asarray(b.values).view(np.uint64) for c in group["bits"].chunks for b in c]
            least = min(map(len, bits))
            bits = np.stack([folded(b, least) for b in bits])
            for p in np.nonzero(pivot)[0].tolist():
                # two pivots meet in the part of the larger id
                qs = np.nonzero(own & (label != label[p]) & (100 * np.minimum(n, n[p]) >= percent * np.maximum(n, n[p])) & (~pivot | (ids > ids[p])))[0]
                qs = qs[may_link(bits[p], n[p], bits[qs], n[qs], percent)] if len(qs) else qs
                if len(qs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[qs], ids[p])), pa.array(np.maximum(ids[qs], ids[p]))], names=["a", "b"])

    return run


def _meetings(rest: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(tile, part, id, label, own, pivot of one turn; tile, id that are left for later turns) of rest (tile, id, label).

    Tiles of one label are settled. In each other one the rows outside its most frequent label, BLOCK of them or about so many, are pivots:
    they go to all parts of BLOCK rows of the tile and leave it after the turn. So a turn has about twice as many rows as rest, or fewer.
    """
    labels = rest.groupBy("tile", "label").agg(F.count("*").alias("n"))
    tiles = labels.groupBy("tile").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    parts, turns = F.ceil(F.col("size") / BLOCK).cast("long"), F.ceil((F.col("size") - F.col("top.n")) / BLOCK).cast("long")
    tiles = staged(tiles.select("tile", F.col("top.label").alias("main"), parts.alias("parts"), turns.alias("turns")), "jaccard-open")
    rows = rest.join(_everywhere(tiles), "tile").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.withColumn("pivot", (F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.col("turns")) == 0))
    visits = rows.filter("pivot AND parts > 1").withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1))).withColumn("part", (F.col("part") + F.col("step")) % F.col("parts"))
    sent = [x.select("tile", "part", "id", "label", F.lit(own).alias("own"), "pivot") for x, own in ((rows, True), (visits, False))]
    return sent[0].union(sent[1]), rows.filter("turns > 1 AND NOT pivot").select("tile", "id")


def _links_by_tiles(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """vertex, component of what the members of tiles (tile, rep, first) are linked to; sets: id, n, bits, shingles of all members."""
    small = sets.select("id", "n", "bits")
    stars = tiles.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = staged(_verified(_possible(stars, small, percent), sets, percent).distinct(), "jaccard-links")
    found = staged(connected_components(links), "jaccard-found")
    # what is left of each tile without its first member, where links have not joined it
    left, turn = tiles.filter("rep <> first").select("tile", F.col("rep").alias("id")), 0
    while True:
        labels = found.select(F.col("vertex").alias("id"), "component")
        rest = staged(left.join(labels, "id", "left").select("tile", "id", F.coalesce("component", "id").alias("label")), "jaccard-rest")
        if turn:
            dropped(left)
        if rest.isEmpty():
            dropped(rest)
            return found
        rows, later = _meetings(rest, turn)
        met = rows.join(small, "id").select("tile", "part", "id", "label", "own", "pivot", "n", "bits")
        late = met.repartition("tile", "part").sortWithinPartitions("tile", "part").mapInArrow(freeing(_part_pairs(percent)), "a long, b long").distinct()
        more = staged(_verified(late, sets, percent).distinct(), "jaccard-more")
        if not more.isEmpty():
            links = links.union(more)
            found = staged(connected_components(links), "jaccard-found")
        left, turn = staged(later, "jaccard-left"), turn + 1
        dropped(rest)


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles long, component_id long (smallest id reachable by links, itself included).

    Two rows link when 100 * |A & B| >= percent * |A | B| over their sets of shingles of `size` words. Null or empty
    texts and texts without words: no shingles, linked with nothing. A null id has a null component and is in no
    link. Rows that share an id are one vertex, each with its own count. An empty table gives an empty table. Texts are read whole.
    """
    sketch = staged(_sketches(documents, id_col, text, size), "jaccard-sketch")
    named = sketch.filter("n > 0 AND id IS NOT NULL")
    # a table of its own, so that both sides of the join are shuffled and a hot class can be split
    classes = staged(named.groupBy("f0", "f1", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "jaccard-classes")
    vertices = staged(named.join(classes, ["f0", "f1", "n"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "n"), "jaccard-vertices")

    keyed = _keyed(documents, id_col, text, size, percent)
    shared = staged(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(freeing(_shared_keys), "key long, id long"), "jaccard-keys")
    # ids become their classes' representatives; tiles with one class or with the same classes as another go
    members = staged(shared.join(vertices.select("id", "rep").distinct(), "id").select(F.col("key").alias("tile"), "rep").distinct(), "jaccard-members")
    dropped(shared, classes)
    same = ("size", "first", "s0", "s1")
    hashes = [(F.xxhash64("rep", F.lit(i)) % (1 << 31)).alias(f"h{i}") for i in (0, 1)]  # sums of so many bits do not overflow
    tiles = members.select("tile", "rep", *hashes).groupBy("tile").agg(F.count("*").alias("size"), F.min("rep").alias("first"), F.sum("h0").alias("s0"), F.sum("h1").alias("s1")).filter("size > 1")
    tiles = staged(tiles.groupBy(*same).agg(F.min("tile").alias("tile")).select("tile", "first"), "jaccard-distinct")
    members = staged(members.join(tiles, "tile").select("tile", "rep", "first"), "jaccard-tiles")
    dropped(tiles)

    groups = connected_components(members.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")))
    weights = vertices.groupBy("id").agg(F.sum("n").alias("n"))
    groups = staged(groups.select(F.col("vertex").alias("id"), F.col("component").alias("group")).join(weights, "id"), "jaccard-groups")
    sizes = groups.groupBy("group").agg((F.count("*") > GROUP_ROWS).alias("many"), (F.sum("n") > GROUP_ELEMENTS).alias("long"))
    groups = staged(groups.join(sizes, "group").select("id", "group", F.expr("many OR long").alias("large")), "jaccard-group-sizes")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                flat, offsets = shingle_sets(part.column(2), size)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _packed(flat, offsets)], names=["group", "id", "shingles"])

    def with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                flat, offsets = shingle_sets(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), _lists(*bitmaps(flat, offsets)), _packed(flat, offsets)], names=["id", "n", "bits", "shingles"])

    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sent = texts.join(_everywhere(groups.filter("NOT large").select("id", "group")), "id").select("group", "id", "text").mapInArrow(freeing(as_sets), "group long, id long, shingles binary")
    found = staged(sent.repartition("group").sortWithinPartitions("group").mapInArrow(freeing(_decided(percent)), "vertex long, component long"), "jaccard-found")
    large = groups.filter("large").select("id")
    if not large.isEmpty():
        sets = staged(texts.join(_everywhere(large), "id", "left_semi").mapInArrow(freeing(with_bits), "id long, n long, bits array<long>, shingles binary"), "jaccard-sets")
        by_tiles = members.join(_everywhere(large.select(F.col("id").alias("first"))), "first", "left_semi").select("tile", "rep", "first")
        found = found.union(_links_by_tiles(staged(by_tiles, "jaccard-large"), sets, percent))
        dropped(sets)
    dropped(groups, members)

    by_vertex = vertices.select("id", "rep").distinct().join(found, F.col("rep") == F.col("vertex"), "left").select("id", F.coalesce("component", "rep").alias("component"))
    # ids with several texts tie their classes together
    twice = by_vertex.groupBy("id").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    if not twice.filter("c0 <> c1").isEmpty():
        ties = twice.filter("c0 <> c1").select(F.col("id").alias("a"), F.col("c0").alias("b")).union(by_vertex.select(F.col("id").alias("a"), F.col("component").alias("b")))
        again = connected_components(ties).select(F.col("vertex").alias("id"), F.col("component").alias("c0"))
        twice = twice.select("id").join(again, "id", "left")
    final = twice.select("id", F.col("c0").alias("component"))
    out = sketch.select("id", "n").join(final, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def near_distinct(documents: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: of the smallest id's rows the first by a hash of all its columns. Rows without an id or shingles stay."""
    found = staged(jaccard_components(documents, id_col, text, size, percent), "jaccard-components")
    gone = staged(found.filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct(), "jaccard-gone")
    kept = documents.join(_everywhere(gone), id_col, "left_anti").select(*documents.columns)
    many = found.filter(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)).groupBy(id_col).count().filter("count > 1").select(id_col)
    many = staged(many.join(gone, id_col, "left_anti"), "jaccard-repeated")
    if many.isEmpty():
        return kept
    many = _everywhere(many)
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    told = F.xxhash64(*[c for c, kind in documents.dtypes if "map<" not in kind])
    one = kept.filter(worded).join(many, id_col, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*documents.columns), told).alias("__row")).select("__row.*")
    return kept.filter(~worded).union(kept.filter(worded).join(many, id_col, "left_anti").select(*documents.columns)).union(one.select(*documents.columns))


def op6_jaccard(documents: DataFrame) -> DataFrame:
    """Components of all documents by 4-word shingles and a similarity of 0.85 or more."""
    return jaccard_components(documents, size=4, percent=85)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, y FROM reach JOIN edges ON r = x)
SELECT doc_id, n AS n_shingles, min(r) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n"""
