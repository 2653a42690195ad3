"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors become one class with a count of copies.
2. Centroids come from spherical k-means on a bounded sample, one for each SHARD_ROWS rows of the shards; every class goes to
   the shards of its nearest centroids, so shards overlap. Beyond MAX_CENTROIDS there are two levels: as many
   coarse centroids as the square root, and in each coarse cell its own fine ones, fitted on a bounded sample of the cell.
   A shard beyond BLOCK_ROWS is dealt into blocks, so no task holds more than two.
3. Each block builds its graph by insertion in random order: a row searches the graph so far greedily, what it met is robust-pruned to DEGREE
   neighbours, and they get reversed edges, pruned again where they are too many.
4. The adjacency lists of all shards are united: a vector has one list, of all its homes. A shard is searched over the united lists, and
   where these lead out of it to vectors close by, those come along, so links between vectors without a common home are met too.
5. Each vector searches once, in its nearest shard: greedily with a beam from the medoids and its own list, then on from all that lies
   within the range (and SLACK around it) until nothing new turns up. What it meets is verified in double precision. Tasks return a
   row for each vector: its number of links and its root in the spanning forest of the task's links.
6. Recall is audited against brute force for each of `audit` queries, or of classes found to be linked if none of these has
   a link. Its mean must reach `target` among the queries of each order of magnitude of links, so a hot cluster outweighs no
   sparse pair. Below it the search is run again with more homes and a wider beam, twice, then block by block without a graph;
   the figures are logged, and a run that stays below it fails.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, freeing, staged
from .components import connected_components

logger = logging.getLogger(__name__)

SHARD_ROWS, BLOCK_ROWS, MAX_CENTROIDS, SAMPLE_PER_CENTROID = 1200, 3000, 4096, 20
DEGREE, ALPHA, MEDOIDS, BUILD_BEAM, BATCH, BEAM, SLACK = 24, 1.2, 16, 48, 128, 32, 0.05


def usable(v: Column) -> Column:
    """Vectors with components that are all finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from rows spread over the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1)
        centroids[length > 0] = sums[length > 0] / length[length > 0, None]
    return centroids


def greedy(graph: np.ndarray, entries: np.ndarray, x32: np.ndarray, q32: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(the beam's vertices, -1 where it is not full, and their similarities) of a search for each query from the entries."""
    nq, n = len(q32), len(x32)
    seen = np.zeros((nq, n), bool)
    ids = np.full((nq, beam), -1, np.int64)
    sims = np.full((nq, beam), -2, np.float32)
    take = min(len(entries), beam)
    ids[:, :take], sims[:, :take] = entries[:take], q32 @ x32[entries[:take]].T
    seen[:, entries] = True
    done = ids < 0
    active = np.arange(nq)
    while len(active):
        best = np.argmax(np.where(done[active], np.float32(-3), sims[active]), axis=1)
        going = ~done[active, best]
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        nbr = graph[ids[active, best]]
        new = (nbr >= 0) & ~seen[active[:, None], nbr]
        r, c = np.nonzero(new)
        seen[active[r], nbr[r, c]] = True
        got = np.full(nbr.shape, -2, np.float32)
        got[r, c] = np.einsum("id,id->i", q32[active[r]], x32[nbr[r, c]])
        every = np.concatenate([sims[active], got], axis=1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(z, top, 1) for z in (np.concatenate([ids[active], np.where(new, nbr, -1)], axis=1), every, np.concatenate([done[active], ~new], axis=1)))
    return ids, sims


def robust_prune(rows: np.ndarray, cand: np.ndarray, x32: np.ndarray) -> np.ndarray:
    """DEGREE of each row's candidates (-1: none): the nearest stays and rules out those that it is much closer to, and so on."""
    out = np.full((len(rows), DEGREE), -1, np.int64)
    away = 1 - np.einsum("rcd,rd->rc", x32[cand], x32[rows])
    away[(cand < 0) | (cand == rows[:, None])] = np.inf
    at = np.arange(len(rows))
    for k in range(DEGREE):
        pick = np.argmin(away, axis=1)
        live = np.isfinite(away[at, pick])
        if not live.any():
            break
        chosen = cand[at, pick]
        out[live, k] = chosen[live]
        between = 1 - np.einsum("rcd,rd->rc", x32[cand], x32[chosen])
        away[(ALPHA * between <= away) | (cand == chosen[:, None])] = np.inf
    return out


def robust_graph(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency lists padded with -1, entries from which every vertex can be reached) over unit vectors x, built by insertion."""
    n = len(x)
    x32 = x.astype(np.float32)
    graph = np.full((n, DEGREE), -1, np.int64)
    first = int(np.argmax(x @ x.sum(0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[first], order[order != first]])
    at, entry = 1, np.array([first])
    while at < n:
        rows = order[at : at + min(at, BATCH)]
        cand = greedy(graph, entry, x32, x32[rows], BUILD_BEAM)[0]
        if len(rows) > 1:  # rows of one batch do not find each other in the graph
            among = x32[rows] @ x32[rows].T
            np.fill_diagonal(among, -2)
            k = min(8, len(rows) - 1)
            cand = np.concatenate([cand, rows[np.argpartition(-among, k - 1, axis=1)[:, :k]]], axis=1)
        graph[rows] = robust_prune(rows, cand, x32)
        # reversed edges, pruned where they are too many
        a, b = np.repeat(rows, DEGREE), graph[rows].ravel()
        a, b = a[b >= 0], b[b >= 0]
        have = graph[b] == a[:, None]
        a, b = a[~have.any(1)], b[~have.any(1)]
        where = np.argsort(b, kind="stable")
        a, b = a[where], b[where]
        targets, begin, many = np.unique(b, return_index=True, return_counts=True)
        if len(targets):
            more = np.full((len(targets), int(many.max())), -1, np.int64)
            more[np.repeat(np.arange(len(targets)), many), np.arange(len(b)) - np.repeat(begin, many)] = a
            graph[targets] = robust_prune(targets, np.concatenate([graph[targets], more], axis=1), x32)
        at += len(rows)
    entries = [first]
    far = 1 - x32 @ x32[first]
    while len(entries) < min(MEDOIDS, n):
        entries.append(int(np.argmax(far)))
        far = np.minimum(far, 1 - x32 @ x32[entries[-1]])
    # what the medoids do not reach becomes an entry itself
    seen = np.zeros(n, bool)
    front = np.unique(entries)
    entries = front.tolist()
    seen[front] = True
    while True:
        while len(front):
            nxt = np.unique(graph[front])
            nxt = nxt[nxt >= 0]
            front = nxt[~seen[nxt]]
            seen[front] = True
        lost = np.nonzero(~seen)[0]
        if not len(lost):
            return graph, np.array(entries)
        entries.append(int(lost[0]))
        front = lost[:1]
        seen[front] = True


def range_search(lists: tuple[np.ndarray, np.ndarray], entries: np.ndarray, x: np.ndarray, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vertex) with a similarity of about `least` or more, to be verified. lists: (starts, vertices).

    own: the queries' vertices, if they are of the graph; their lists start the range beside what the entries lead to.
    """
    x32, q32 = x.astype(np.float32), queries.astype(np.float32)
    nq, n = len(q32), len(x32)
    starts, vertices = lists
    width = np.diff(starts)
    graph = np.full((n, max(int(width.max()) if n else 0, 1)), -1, np.int64)
    graph[np.repeat(np.arange(n), width), np.arange(len(vertices)) - np.repeat(starts[:-1], width)] = vertices
    reach = least - SLACK
    hit, grown = np.zeros((nq, n), bool), np.zeros((nq, n), bool)
    for lo in range(0, nq, 512):
        ids, sims = greedy(graph, entries, x32, q32[lo : lo + 512], beam)
        q, k = np.nonzero((ids >= 0) & (sims >= reach))
        hit[lo + q, ids[q, k]] = True
    if own is not None:
        hit[np.arange(nq), own] = True
    tried = hit.copy()
    while True:  # expand the range
        q, v = np.nonzero(hit & ~grown)
        if not len(q):
            break
        grown[q, v] = True
        for lo in range(0, len(q), 20_000):
            at = v[lo : lo + 20_000]
            n_of = width[at]
            who = np.repeat(q[lo : lo + 20_000], n_of)
            part = vertices[np.arange(int(n_of.sum())) - np.repeat(np.cumsum(n_of) - n_of, n_of) + np.repeat(starts[at], n_of)]
            ok = ~tried[who, part]
            key = np.unique(who[ok] * n + part[ok])
            who, part = key // n, key % n
            tried[who, part] = True
            for k in range(0, len(who), 100_000):
                a, b = who[k : k + 100_000], part[k : k + 100_000]
                near = np.einsum("id,id->i", q32[a], x32[b]) >= reach
                hit[a[near], b[near]] = True
    return np.nonzero(hit)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position in each position's component."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return unit(np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks]).reshape(-1, dim)) if len(column) else np.zeros((0, dim))


def _ragged(lists: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64), pa.int64()))


def _built(dim: int, least: float):
    def build(table: pa.Table) -> pa.Table:
        """Of a block's rows: each with its list, the part of the list within the range, and whether it is an entry."""
        x = _matrix(table["v"], dim)
        ids = table["id"].to_numpy()
        graph, entries = robust_graph(x)
        lists, near = [], []
        for i, row in enumerate(graph):
            row = row[row >= 0]
            lists.append(ids[row])
            near.append(ids[row[x[row] @ x[i] >= least - SLACK]])
        entry = np.zeros(len(ids), bool)
        entry[entries] = True
        return pa.table({"shard": table["shard"], "block": table["block"], "id": table["id"], "first": table["first"], "list": _ragged(lists), "near": _ragged(near), "entry": pa.array(entry)})

    return build


def _linked(ids: np.ndarray, copies: np.ndarray, asked: np.ndarray, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, both: np.ndarray | None) -> pa.Table:
    """id, links, root from pairs (query a, vertex b), verified. both: the queries' vertices; pairs among them count both ways."""
    keep = np.concatenate([np.einsum("id,id->i", y[a[k : k + 200_000]], x[b[k : k + 200_000]]) >= least for k in range(0, len(a), 200_000)]) if len(a) else np.zeros(0, bool)
    keep &= asked[a] != ids[b]
    a, b = a[keep], b[keep]
    if both is not None:
        query_at = np.full(len(ids), -1, np.int64)
        query_at[both] = np.arange(len(both))
        back = query_at[b] >= 0
        key = np.unique(np.concatenate([a * len(ids) + b, query_at[b[back]] * len(ids) + both[a[back]]]))
        a, b = key // len(ids), key % len(ids)
    links = np.bincount(a, weights=copies[b], minlength=len(asked)).astype(np.int64)
    names, place = np.unique(np.concatenate([asked, ids]), return_inverse=True)
    qa, vb = place[: len(asked)][a], place[len(asked) :][b]
    roots = _roots(len(names), qa, vb)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, place[: len(asked)], links)
    linked = np.unique(np.concatenate([qa, vb]))
    return pa.table({"id": names[linked], "links": total[linked], "root": names[roots[linked]]})


def _searched(dim: int, least: float, beam: int, exact: bool):
    def search(table: pa.Table) -> pa.Table:
        """Of a shard's blocks i (queries) and j (graph, with what its lists lead to): id, links (copies of the classes linked), root."""
        role = table["role"].to_numpy()
        order = np.lexsort((table["id"].to_numpy(), role == QUERY))
        table, role = table.take(pa.array(order)), role[order]
        n = int((role != QUERY).sum())
        x = _matrix(table["v"], dim)
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        own = np.nonzero(table["first"].to_numpy(zero_copy_only=False))[0] if table["i"][0] == table["j"][0] else None
        asked = own if own is not None else np.arange(n, len(ids))
        if exact:
            a, b = np.nonzero(x[asked] @ x[:n].T >= least - 1e-9)
        else:
            flat = table["list"].combine_chunks()
            lengths = np.asarray(flat.value_lengths().fill_null(0), np.int64)[:n]
            targets = np.asarray(flat.flatten())[: int(lengths.sum())]  # queries of another block stand behind, without lists
            place = np.minimum(np.searchsorted(ids[:n], targets), max(n - 1, 0))
            here = ids[place] == targets
            source = np.repeat(np.arange(n), lengths)[here]
            u, v = np.concatenate([source, place[here]]), np.concatenate([place[here], source])
            key = np.unique(u * n + v)
            lists = (np.searchsorted(key, np.arange(n + 1) * n), key % n) if n else (np.zeros(1, np.int64), key)
            entries = np.nonzero(table["entry"].to_numpy(zero_copy_only=False)[:n])[0]
            a, b = range_search(lists, entries, x[:n], x[asked], least, beam, own) if len(asked) and n else (np.empty(0, np.int64),) * 2
        return _linked(ids[:n], copies[:n], ids[asked], x[:n], x[asked], a, b, least, own)

    return search


MEMBER, HALO, QUERY = 0, 1, 2


def _nearest(x: np.ndarray, centroids: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centroids of each row, the nearest first."""
    m = min(m, len(centroids))
    out = []
    for k in range(0, len(x), 1024):
        sims = x[k : k + 1024] @ centroids.T
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        out.append(np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, m), np.int64)


def _placed(batch: pa.RecordBatch, near: np.ndarray, first: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row of the batch for each of its homes; first: rows whose nearest home is their first one."""
    m = near.shape[1]
    whole = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), m)))
    flags = np.zeros(near.shape, bool)
    flags[:, :1] = first[:, None]
    return pa.RecordBatch.from_arrays([*whole.columns, pa.array(near.ravel().astype(np.int64)), pa.array(flags.ravel())], names=names)


ROWS = "id long, copies long, v array<double>"


def _homes(classes: DataFrame, n: int, dim: int, overlap: int, used: list[DataFrame]) -> DataFrame:
    """id, copies, v, shard, first: a row for each of a class's homes; first marks its nearest. used: gets the staged tables behind it."""
    spark = classes.sparkSession
    wanted = max(1, -(-n * overlap // SHARD_ROWS))
    two = wanted > MAX_CENTROIDS
    k = int(np.ceil(np.sqrt(wanted))) if two else wanted
    share = min(1.0, max(k * SAMPLE_PER_CENTROID, 1000) / n)  # at most about 20 * MAX_CENTROIDS rows; no task orders all
    sample = classes.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").toArrow()
    rows = _matrix(sample["v"], dim)
    if not len(rows):  # a few rows, all beyond the threshold
        rows = _matrix(classes.select("v").limit(1).toArrow()["v"], dim)
    shared = spark.sparkContext.broadcast(fit_centroids(rows, min(k, len(rows))))
    some = 2 if two else overlap

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(np.asarray(batch.column(2).flatten(), dtype=np.float64).reshape(batch.num_rows, dim))
                yield _placed(batch, _nearest(x, shared.value, some), np.ones(len(x), bool), ["id", "copies", "v", "shard", "first"])

    placed = classes.select("id", "copies", "v").mapInArrow(freeing(homes), f"{ROWS}, shard long, first boolean")
    if not two:
        return placed
    coarse = staged(placed.withColumnRenamed("shard", "cell"), "graph-cells")
    used.append(coarse)
    cells = coarse.groupBy("cell").agg(F.count("*").alias("rows"))  # at most the square root of all shards
    sparse = F.pmod(F.xxhash64("id", F.lit("fine")), F.greatest(F.lit(1), F.floor(F.col("rows") / (F.ceil(F.col("rows") / SHARD_ROWS) * SAMPLE_PER_CENTROID)))) == 0

    def fit(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"], dim)
        fine = fit_centroids(x, int(min(len(x), -(-table["rows"][0].as_py() // SHARD_ROWS))))
        return pa.table({"cell": table["cell"].slice(0, 1), "fine": pa.array([fine.tobytes()], pa.binary())})

    fine = staged(coarse.join(F.broadcast(cells), "cell").filter(sparse).select("cell", "rows", "v").groupBy("cell").applyInArrow(fit, "cell long, fine binary"), "graph-fine")
    used.append(fine)

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column(3))
            for c in np.unique(cell).tolist():
                part = batch.filter(pa.array(cell == c))
                x = unit(np.asarray(part.column(2).flatten(), dtype=np.float64).reshape(part.num_rows, dim))
                near = _nearest(x, np.frombuffer(part.column(5)[0].as_py()).reshape(-1, dim), -(-overlap // 2))
                yield _placed(part.select([0, 1, 2]), near + (c << 32), np.asarray(part.column(4)), ["id", "copies", "v", "shard", "first"])

    return coarse.select(*["id", "copies", "v", "cell", "first"]).join(fine, "cell").select("id", "copies", "v", "cell", "first", "fine").mapInArrow(freeing(refined), f"{ROWS}, shard long, first boolean")


def _search(classes: DataFrame, n: int, dim: int, least: float, overlap: int, beam: int, used: list[DataFrame], exact: bool = False) -> DataFrame:
    """id, links, root of linked classes, from one search for each class over the united lists of all shards. used: gets the staged tables behind it."""
    if exact:
        rows = classes.select("id", "copies", "v", F.lit(0).cast("long").alias("shard"), F.lit(True).alias("first"))
    else:
        rows = _homes(classes, n, dim, overlap, used)
    rows = staged(rows, "graph-shards")
    sizes = staged(rows.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "graph-sizes")
    used += [rows, sizes]
    rows = rows.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    none = F.array().cast("array<long>")
    if exact:
        members = rows.select("shard", "block", "blocks", "id", "copies", "v", "first", F.lit(True).alias("entry"), none.alias("list"))
        halo = members.limit(0)
    else:
        built = rows.select("shard", "block", "id", "v", "first").groupBy("shard", "block").applyInArrow(_built(dim, least), "shard long, block int, id long, first boolean, list array<long>, near array<long>, entry boolean")
        built = staged(built, "graph-built")
        united = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # DEGREE for each home at most
        united = staged(united.join(classes.select("id", "copies", "v"), "id"), "graph-united")
        held = built.select("shard", "block", "id", "first", "entry").join(united, "id").join(sizes, "shard")
        held = staged(held, "graph-held")
        used += [built, united, held]
        members = held.select("shard", "block", "blocks", "id", "copies", "v", "first", "entry", "list")
        out = held.select("shard", "block", "blocks", F.explode("near").alias("id")).groupBy("shard", "id").agg(F.min("block").alias("block"), F.first("blocks").alias("blocks"))
        out = out.join(built.select("shard", "id"), ["shard", "id"], "left_anti")
        halo = out.join(united, "id").select("shard", "block", "blocks", "id", "copies", "v", F.lit(False).alias("first"), F.lit(False).alias("entry"), "near")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    graph = members.withColumn("role", F.lit(MEMBER)).union(halo.withColumn("role", F.lit(HALO)))
    graph = graph.withColumn("i", F.explode(every)).withColumn("j", F.col("block"))
    others = members.filter("first AND blocks > 1").withColumns({"list": none, "role": F.lit(QUERY)}).withColumn("j", F.explode(every)).filter("j <> block").withColumn("i", F.col("block"))
    columns = ["shard", "i", "j", "role", "id", "copies", "v", "first", "entry", "list"]
    return graph.select(*columns).union(others.select(*columns)).groupBy("shard", "i", "j").applyInArrow(_searched(dim, least, beam, exact), "id long, links long, root long")


def brute_force_links(classes: DataFrame, queries: int, dim: int, least: float, among: DataFrame | None = None) -> DataFrame:
    """id, links of the `queries` classes (of those with an id in `among`) first in a hash's order, by comparing them with all classes."""
    picked = (classes if among is None else classes.join(among, "id", "left_semi")).orderBy(F.xxhash64("id", F.lit("audit"))).limit(queries).select("id", "v").collect()
    ids = np.array([r["id"] for r in picked], np.int64)
    shared = classes.sparkSession.sparkContext.broadcast((ids, unit(np.array([r["v"] for r in picked], dtype=np.float64).reshape(len(picked), dim)) if len(picked) else np.zeros((0, dim))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = unit(np.asarray(batch.column(2).flatten(), dtype=np.float64).reshape(batch.num_rows, dim))
                copies = np.asarray(batch.column(1))
                for k in range(0, len(x), 4096):
                    close = q @ x[k : k + 4096].T >= least
                    close &= own[:, None] != np.asarray(batch.column(0))[None, k : k + 4096]
                    total += close @ copies[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], names=["id", "links"])

    return classes.select("id", "copies", "v").mapInArrow(freeing(run), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def recall(truth: dict[int, int], got: dict[int, int]) -> tuple[float, float, float]:
    """Mean and worst recall of the queries that have links, and the lowest mean among those with a like number of them (by powers of two)."""
    by_size: dict[int, list[float]] = defaultdict(list)
    for i, n in truth.items():
        if n:
            by_size[n.bit_length()].append(min(1.0, got.get(i, 0) / n))
    each = [r for rs in by_size.values() for r in rs]
    return (sum(each) / len(each), min(each), min(sum(rs) / len(rs) for rs in by_size.values())) if each else (1.0, 1.0, 1.0)


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.9, overlap: int = 3, beam: int = BEAM, audit: int = 1000, target: float = 0.98) -> DataFrame:
    """id_col, n_links (other rows linked directly), component_id (smallest id reachable, itself included), kept.

    Rows link at a cosine of `least` or more in double precision. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, nor do vectors of different lengths link. A null id has a null component,
    links with nothing and is not kept. Equal vectors are linked; rows that repeat an id are vectors of their own with
    one id. An empty table gives an empty table.
    """
    good = staged(df.select(F.col(id_col).cast("long").alias("id"), F.when(usable(F.col(vector)) & F.col(id_col).isNotNull(), F.col(vector).cast("array<double>")).alias("v")), "graph-input")
    # 0.0 for -0.0, so that equal numbers group
    grouped = good.filter("v IS NOT NULL").groupBy(F.transform("v", lambda x: x + 0.0).alias("v")).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    all_classes = staged(grouped.select(F.col("rep").alias("id"), "copies", "v", F.size("v").alias("dim")), "graph-classes")
    # an id that has several vectors stands for several classes; each is told apart by its vector
    members = good.filter("v IS NOT NULL").select("id", F.transform("v", lambda x: x + 0.0).alias("v")).join(all_classes.select("v", F.col("id").alias("rep"), "copies"), "v").select("id", "rep", "copies")
    parts = []
    for row in all_classes.groupBy("dim").count().orderBy("dim").collect():  # one row for each length of vectors
        dim, n = row["dim"], row["count"]
        classes = all_classes.filter(F.col("dim") == dim)
        truth = {r["id"]: r["links"] for r in brute_force_links(classes, audit, dim, least).collect()}  # at most `audit` rows
        for wide in (1, 2, 4, 0):
            used: list[DataFrame] = []
            found = staged(_search(classes, n, dim, least, wide * overlap, wide * beam, used, exact=not wide), "graph-links")
            dropped(*used)
            asked = truth if any(truth.values()) else {r["id"]: r["links"] for r in brute_force_links(classes, audit, dim, least, found.select("id")).collect()} if audit else {}
            got = {r["id"]: r["n"] for r in found.filter(F.col("id").isin(list(asked))).groupBy("id").agg(F.sum("links").alias("n")).collect()} if asked else {}
            mean, worst, lowest = recall(asked, got)
            how = f"{wide * overlap} homes, beam {wide * beam}" if wide else "blocks without a graph"
            logger.warning("vectors of length %d, %s: recall of %d audited queries with links: mean %.4f, worst %.4f, lowest mean by number of links %.4f", dim, how, sum(x > 0 for x in asked.values()), mean, worst, lowest)
            if lowest >= target:
                break
        else:
            raise RuntimeError(f"recall {lowest:.4f} of vectors of length {dim} stays below {target}")
        parts.append(found)
    empty = df.sparkSession.range(0).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root"))
    found = empty
    for p in parts:
        found = found.union(p)
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_rep = members.join(totals.withColumnRenamed("id", "rep"), "rep", "left").join(joined.withColumnRenamed("vertex", "rep"), "rep", "left")
    per_row = by_rep.groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = good.select("id").join(per_row, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op5_graph_dedup(embeddings: DataFrame) -> DataFrame:
    return near_duplicate_vectors(embeddings)


OP5_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, y FROM reach JOIN links ON r = x),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(any_value(n), 0)::bigint AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN counts USING (vec_id) GROUP BY vec_id"""
