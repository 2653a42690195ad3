"""Small tests of the ten operators and the pipeline: brute force, round trips, nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import bpe, chat, components, decontaminate, graph_dedup, html_text, jaccard, lm_score, queries, sharding, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = queries.vocabulary_path("byte_bpe_50k.json")
TABLES = "documents embeddings pages benchmark labels conversations".split()


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"ids": F.lit("x"), "shard": F.lit("y"), "score": F.lit("z"), "component_id": F.lit(1), "matches": F.lit(2)}) if extra else df


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.execute(queries.sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())


# sharding


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        index = sharding.hilbert_index(list(cells.T), bits)
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 7, 50])
def test_shards_hold_the_rows_law(spark, n):
    df = docs(spark, [None if i % 9 == 0 else "é" * (i % 5) for i in range(n)], extra=True)
    df = df.union(df) if n else df
    rows = sharding.op1_hilbert_sharding(df).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 2 * n and (not n or max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1)
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for r in rows:
        t = (None if r["doc_id"] % 9 == 0 else "é" * (r["doc_id"] % 5)) or ""
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode())) and r["grown_shard"] is None


def test_cells_keep_the_order_of_values(spark):
    """Brute force: cells of strings and numbers rise with the values, each distinct value has its own if there are few, and nulls are cell 0."""
    names = [None, "é", "a", "b", "B", "zz", "", "src10", "src2"]
    df = spark.createDataFrame([(names[i % 9], None if i % 7 == 0 else i * i) for i in range(500)], "s string, x long")
    s, x = sharding.quantised(df, [sharding.Dimension("s"), sharding.Dimension("x", numeric=True)], 4)
    rows = df.select("s", "x", s.alias("cs"), x.alias("cx")).collect()
    cell = {r["s"]: r["cs"] for r in rows}
    assert len({(r["s"], r["cs"]) for r in rows}) == 9 and cell[None] == 0
    by_value = [cell[v] for v in sorted((v for v in names if v is not None), key=lambda v: v.encode())]
    assert by_value == [2 * i for i in range(8)]
    numbers = sorted((r["x"], r["cx"]) for r in rows if r["x"] is not None)
    assert [c for _, c in numbers] == sorted(c for _, c in numbers) and all(r["cx"] == 0 for r in rows if r["x"] is None)
    depth = Counter(c for _, c in numbers)
    assert len(depth) == 16 and max(depth.values()) - min(depth.values()) <= 4
    many = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("s"))
    assert len(sharding.value_cuts(many, "s", 16)) == 15


def test_shards_prune_strings(spark):
    """Files that a predicate on lang or source reads: the shards with the value and at most one more; equal texts lie together."""
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"__rank": F.lit(7), "_range": F.lit(8), "place": F.lit(9)})
    dims = [sharding.Dimension("source"), sharding.Dimension("lang"), sharding.Dimension("n_chars", numeric=True)]
    out = sharding.hilbert_shards(df, dims, 8, ["text", "doc_id"]).cache()
    assert {(r["__rank"], r["_range"], r["place"]) for r in out.select("__rank", "_range", "place").distinct().collect()} == {(7, 8, 9)}
    stats = [F.min(c).alias(f"min_{c}") for c in ("source", "lang")] + [F.max(c).alias(f"max_{c}") for c in ("source", "lang")]
    manifest = out.groupBy("shard").agg(*stats).cache()
    few = 0
    for c in ("source", "lang"):
        for (v,) in out.select(c).distinct().collect():
            holds = {r["shard"] for r in out.filter(F.col(c) == v).select("shard").distinct().collect()}
            read = {r["shard"] for r in sharding.shards_to_read(manifest, c, v, v).collect()}
            assert holds <= read
            few += len(read) <= len(holds) + 1 and len(read) < 8
    assert few >= 0.8 * (out.select("source").distinct().count() + out.select("lang").distinct().count())


def test_written_shards_and_manifest(spark, tmp_path):
    dims = [sharding.Dimension("m", numeric=True), sharding.Dimension("n", numeric=True)]
    df = spark.range(4096).select("id", (F.col("id") % 64).alias("m"), F.floor(F.col("id") / 64).alias("n"))
    out = sharding.hilbert_shards(df, dims, 8, ["id"])
    manifest = sharding.write_shards(out, str(tmp_path / "s"), dims)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4096
    for c in ("m", "n"):
        wanted = {r["shard"] for r in out.filter(f"{c} BETWEEN 10 AND 12").collect()}
        read = {r["shard"] for r in sharding.shards_to_read(manifest, c, 10, 12).collect()}
        assert wanted <= read and len(read) <= 5


# encoding

ODD = ["", "  ", "a\n\n b  c \t d", "it's we'll I'D 'stale", "<|endoftext|>hi<|endoftext|>", "日本語 ½²³ ٣٤ x\x1c\x1d y", "🙂🙂", "ab" * 400, "\r\n\r\n", "\x85a\xa0b", "_a_b_. _", "é”. x"]


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCAB)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab cdeé\n'st1ñ.漢 \t_-<|") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = docs(spark, [*texts, None], extra=True)
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, VOCAB).collect()}
    for i, t in enumerate([*texts, ""]):
        want = lib.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == want, repr(t)
        assert got[i]["decoded"] == lib.decode(want, skip_special_tokens=False)
    r = bpe.op2_bpe(df, VOCAB).filter("doc_id = 3").first()
    want = lib.encode(ODD[3], add_special_tokens=False).ids
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(ODD[3].encode()).hexdigest())
    assert bpe.op2_bpe(docs(spark, []), VOCAB).count() == 0


def test_memo_may_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    coder = bpe.TrieBPE(VOCAB)
    texts = ["one two three four five six", "seven eight one two", "one"]
    assert [coder.decode(i) for i in coder.encode_batch(texts)] == texts
    assert coder.decode(np.array([447], np.int32)) == b"\xe2\x80".decode("utf-8", "replace")


def test_memo_emptied_between_batches_that_share_a_word(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    coder = bpe.TrieBPE(VOCAB)
    for texts in (["one two"], ["one three four five six seven", "two"], ["seven one two", "eight"]):
        assert [coder.decode(i) for i in coder.encode_batch(texts)] == texts


# decontamination


def brute_tiles(item, text, least):
    used_i, used_t, tiles = [False] * len(item), [x < 0 for x in text], []
    while True:
        best, top = [], least
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and not used_i[p + n] and not used_t[t + n] and item[p + n] == text[t + n]:
                    n += 1
                if n > top:
                    best, top = [(p, t, n)], n
                elif n == top:
                    best.append((p, t, n))
        if not best:
            return sum(n for _, _, n in tiles)
        for p, t, n in best:
            if not any(used_i[p : p + n]) and not any(used_t[t : t + n]):
                used_i[p : p + n] = used_t[t : t + n] = [True] * n
                tiles.append((p, t, n))


def test_tiles_equal_brute_force():
    rng = random.Random(3)
    for _ in range(1000):
        item = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
        text = [rng.randrange(-1, 3) for _ in range(rng.randrange(1, 16))]
        least = rng.randrange(1, 4)
        tiles = decontaminate.greedy_tiles(np.array(item), np.array(text), least)
        assert sum(n for _, _, n in tiles) == brute_tiles(item, text, least)
        assert all(item[p : p + n] == text[t : t + n] for p, t, n in tiles)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_LIMIT, 60])
def test_contamination(spark, limit):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    moved = "eight nine ten eleven twelve thirteen and then: One, two THREE four five six seven"
    texts = [f"before {item} after", moved, "one two three four five six and no more of it", None, "", "nothing at all", "x " * 3000 + item]
    bench = spark.createDataFrame([(1, item), (2, "zwei drei"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    out = decontaminate.find_contamination(docs(spark, texts, extra=True), bench, ["doc_id"], broadcast_limit=limit).collect()
    got = sorted((r["doc_id"], m["item_id"], m["coverage"]) for r in out for m in r["matches"])
    assert got == [(i, j, 1.0) for i in (0, 1, 6) for j in (1, 5)]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs(spark, [*texts, "um zwei drei"]), bench).orderBy("doc_id").collect()] == [2, 3, 4, 5]
    assert decontaminate.op3_decontamination(docs(spark, []), bench).count() == 0
    assert decontaminate.op3_decontamination(docs(spark, texts), bench.limit(0)).count() == 0


def brute_matches(items, text, least, coverage):
    """Items covered by greedy tiles over the whole text, and by how many words."""
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    names = {}
    number = lambda ws: [names.setdefault(w, len(names)) for w in ws]
    found = {}
    for i, item in enumerate(items):
        a, b = number(words(item)), number(words(text))
        covered = brute_tiles(a, b, min(least, len(a))) if a and b else 0
        if a and covered >= coverage * len(a):
            found[i] = covered
    return found


@pytest.mark.parametrize("kinds", [12, 3, 2, 1])
def test_matches_equal_brute_force(kinds):
    """The whole operator on random texts of few words: common seeds, moved and repeated passages, short, equal and self-repeating items."""
    rng = random.Random(11)
    line = [f"c{i}" for i in range(6)] if kinds > 3 else ["w0"] * 3
    for _ in range(60):
        items = []
        for _ in range(rng.randrange(1, 8)):
            own = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(0, 14))] * rng.choice([1, 1, 2])
            items.append(" ".join(own + line if rng.random() < 0.5 else own))
        items.append(items[0])
        texts = []
        for _ in range(6):
            parts = [rng.choice(items).split() for _ in range(rng.randrange(0, 4))]
            parts = [p[rng.randrange(3) :] for p in parts] + [line, [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(6))]]
            rng.shuffle(parts)
            texts.append(" ".join(w for p in parts for w in p))
        bench = decontaminate.Benchmark.of(list(enumerate(items)), 5)
        got = bench.matches(pa.array(texts), 0.6)
        for at, text in enumerate(texts):
            want = brute_matches(items, text, 5, 0.6)
            assert {i: sum(n for _, _, n in tiles) for i, _, tiles in got.get(at, [])} == want
            for i, _, tiles in got.get(at, []):
                a, b = items[i].split(), text.split()
                assert all(a[p : p + n] == b[q : q + n] for p, q, n in tiles)


@pytest.mark.parametrize("item", ["ha " * 10, "buffalo " * 12, "a b " * 9, "one two three four five " * 4])
def test_items_that_repeat_themselves_are_found(spark, item):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [f"before {item} after", "nothing of it", item.strip(), f"before {item[: len(item) // 4]} after"]
    found = decontaminate.op3_decontamination(docs(spark, texts), bench).collect()
    assert {(r["doc_id"], r["coverage"]) for r in found} == {(0, 1.0), (2, 1.0)}
    for limit in (decontaminate.BROADCAST_LIMIT, 20):
        more = bench.union(spark.createDataFrame([(i, f"quite another passage of words {i}") for i in range(2, 6)], bench.schema))
        kept = decontaminate.decontaminated(docs(spark, texts).withColumn("__text", F.lit("x")), more, limit=limit)
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


# chat


def test_chats_round_trip(spark):
    turns = [("user", "a<|end|>\\"), ("user", "\\<|b"), ("assistant", "x\n"), (None, None), ("assistant", "<\\|"), ("assistant", ""), ("a<|text|>b", "t")]
    rows = [(7, i, r, t, 1) for i, (r, t) in enumerate(turns)] + [(8, 0, "user", "q", 1), (8, 0, "user", "q", 1), (None, 0, "assistant", "n", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(df).withColumns({"turns": chat.parse_chats(F.col("formatted")), "loss": chat.masked_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in got[7]["turns"]] == [(r or "", t or "") for r, t in turns]
    assert got[7]["loss"] == "x\n<\\|" and len(got[8]["turns"]) == 2 and got[8]["formatted"].count("<|start|>") == 1
    assert set(got) == {7, 8, None}
    assert chat.op4_chat_formatting(df.limit(0)).count() == 1


# embeddings


def test_graph_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:80] + rng.normal(size=(80, 16)) * 0.1, base[:1].repeat(40, 0), base[5:6] + rng.normal(size=(60, 16)) * 0.05])
    vectors = [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, kept string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    n = len(vectors)
    links = {i: set(np.nonzero(near[i])[0].tolist()) for i in range(len(x))} | {i: set() for i in range(len(x), n)}
    links[n - 2], links[n - 1] = {n - 1}, {n - 2}
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    got = {r["vec_id"]: r for r in graph_dedup.near_duplicate_vectors(df).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(label))
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(s) for i, s in links.items()}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert graph_dedup.op5_graph_dedup(df.limit(0)).count() == 0


def planted(rng, n, dim, near, noise=0.08):
    """(vectors with near ones planted, for each its links by brute force): most links stand alone, some in larger clusters."""
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    copies = base[rng.integers(0, n, near)] + rng.normal(size=(near, dim)) * noise * rng.uniform(0.2, 1, (near, 1))
    x = np.concatenate([base, copies, base[:1] + rng.normal(size=(near // 6, dim)) * 0.03])[rng.permutation(n + near + near // 6)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, (unit @ unit.T >= 0.9).sum(1) - 1


def test_recall_across_shards_and_blocks(spark, monkeypatch, caplog):
    """Each vector's links against brute force, over some 75 overlapping shards, of which the hot cluster's are split into blocks; one and two levels of centroids."""
    monkeypatch.setattr(graph_dedup, "SHARD_ROWS", 60)
    monkeypatch.setattr(graph_dedup, "BLOCK_ROWS", 100)
    x, true = planted(np.random.default_rng(3), 800, 32, 600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for most in (4096, 8):
        monkeypatch.setattr(graph_dedup, "MAX_CENTROIDS", most)
        caplog.clear()
        found = {r["vec_id"]: r["n_links"] for r in graph_dedup.op5_graph_dedup(df).collect()}
        assert "blocks without a graph" not in caplog.text
        linked = [i for i in range(len(x)) if true[i]]
        assert len(linked) > 500 and all(found[i] <= true[i] for i in found)
        assert np.mean([found[i] / true[i] for i in linked]) >= 0.98
        assert np.mean([found[i] / true[i] for i in linked if i % 20 == 0]) >= 0.9


def test_graph_is_sparse_and_searched():
    """Insertion keeps lists short, and the search finds by them what brute force finds, while it meets a part of all vectors."""
    x, true = planted(np.random.default_rng(4), 1500, 32, 700)
    x = graph_dedup.unit(x)
    graph, entries = graph_dedup.robust_graph(x)
    assert graph.shape[1] == graph_dedup.DEGREE and (graph >= 0).sum(1).mean() <= graph_dedup.DEGREE
    edges = {(i, int(j)) for i, row in enumerate(graph) for j in row if j >= 0}
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i != j}
    assert len(pairs & edges) < 0.8 * len(pairs)  # the search is needed
    source = np.array(sorted(edges | {(j, i) for i, j in edges}))
    lists = (np.searchsorted(source[:, 0], np.arange(len(x) + 1)), source[:, 1])
    a, b = graph_dedup.range_search(lists, entries, x, x, 0.9, graph_dedup.BEAM, np.arange(len(x)))
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(pairs & found) >= 0.98 * len(pairs)


def test_united_lists_lead_out_of_a_shard(monkeypatch):
    """A vector that lies in another shard only is met through the list of one that lies in both."""
    z = np.array([1.0, 0, 0])
    a, b = np.array([1.0, 0.2, 0]), np.array([1.0, -0.2, 0])
    rows = [(0, 1, z, True, True, [2, 3]), (0, 2, a, True, False, [1]), (1, 3, b, False, False, [1]), (0, 4, np.array([0, 0, 1.0]), True, False, [1])]
    names = ("role", "id", "v", "first", "entry", "list")
    table = lambda some: pa.table({k: pa.array([(c.tolist() if k == "v" else c) for c in col], {"list": pa.list_(pa.int64()), "v": pa.list_(pa.float64())}.get(k)) for k, col in zip(names, zip(*some, strict=True), strict=True)} | {k: pa.array([v] * len(some), pa.int64()) for k, v in (("copies", 5), ("i", 0), ("j", 0))})
    search = graph_dedup._searched(3, 0.9, 8, exact=False)
    got = {r["id"]: (r["links"], r["root"]) for r in search(table(rows)).to_pylist()}
    assert got == {1: (10, 1), 2: (10, 1), 3: (0, 1)}  # 2 and 3 share no shard; 3 searches in its own
    assert {r["id"]: r["links"] for r in search(table([r for r in rows if r[0] == 0])).to_pylist()} == {1: 5, 2: 5}


def test_audit_sees_sparse_pairs_beside_a_hot_cluster(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(100, 16))
    x = np.concatenate([rng.normal(size=(1, 16)) * 4 + rng.normal(size=(120, 16)) * 0.02, base, base + rng.normal(size=(100, 16)) * 0.02])
    search = graph_dedup._search

    def without_sparse(*a, exact):
        found = search(*a, exact=exact)
        return found if exact else found.filter("links > 50")

    monkeypatch.setattr(graph_dedup, "SHARD_ROWS", 60)
    monkeypatch.setattr(graph_dedup, "_search", without_sparse)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()
    assert [r["n_links"] for r in graph_dedup.near_duplicate_vectors(df).orderBy("vec_id").collect()] == true
    monkeypatch.setattr(graph_dedup, "_search", lambda *a, exact: search(*a, exact=exact).filter("links > 50"))
    with pytest.raises(RuntimeError, match="recall"):
        graph_dedup.near_duplicate_vectors(df)


@pytest.mark.parametrize("finish,hub", [(components.FINISH, components.HUB_EDGES), (0, components.HUB_EDGES), (0, 3), (20, 3)])
def test_components(spark, monkeypatch, finish, hub):
    monkeypatch.setattr(components, "FINISH", finish)
    monkeypatch.setattr(components, "HUB_EDGES", hub)
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict((r["vertex"], r["component"]) for r in components.connected_components(spark.createDataFrame(path, "a long, b long").repartition(5)).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 60)] + [(rng.randrange(60, 200), rng.randrange(60, 200)) for _ in range(90)] + [(500, 501), (501, 500), (7, 7)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    assert got == {v: forest.root(v) for v in forest.parent}


# shingles


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label, [len(s) for s in sets]


@pytest.mark.parametrize("rows", [jaccard.GROUP_ROWS, 3])
@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_equals_brute_force(spark, monkeypatch, size, percent, rows):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", rows)
    rng = random.Random(size)
    line = " ".join(f"l{i}" for i in range(12))
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c d e", "A b\x0bc d e"]
    for family in range(5):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 160))]
        for _ in range(14):
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(words) + (" " + line if rng.random() < 0.3 else ""))
    texts += texts[-3:]
    label, sizes = brute_components(texts, size, percent)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs(spark, texts, extra=True).repartition(3), size=size, percent=percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_jaccard_odd_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (3, t + " x"), (9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.jaccard_components(df).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 3), (9, 9)]
    assert sorted(r["doc_id"] or -1 for r in jaccard.near_distinct(df).collect()) == [-1, 3, 9]
    again = spark.createDataFrame([(3, t, "a"), (3, t, "b"), (3, None, "c"), (4, t, "d"), (None, t, "e"), (None, t, "e")], "doc_id long, text string, __row string")
    kept = jaccard.near_distinct(again).collect()
    assert len(kept) == 4 and {(r["doc_id"], r["text"]) for r in kept} == {(3, t), (3, None), (None, t)}
    assert jaccard.op6_jaccard(df.limit(0)).count() == 0


# language model


def test_packing():
    rng = np.random.default_rng(2)
    h = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2), np.arange(5, dtype=np.uint64), np.array([(1 << 64) - 1], np.uint64)]))
    assert (lm_score.unpack_hashes(lm_score.pack_hashes(h)) == h).all()
    c = np.array([0, 1, 254, 255, 256, 10**9])
    assert (lm_score.unpack_counts(lm_score.pack_counts(c)) == c).all()
    assert len(lm_score.unpack_hashes(lm_score.pack_hashes(h[:0]))) == len(lm_score.unpack_counts(lm_score.pack_counts(c[:0]))) == 0


def test_lists_never_outnumber_ngrams():
    grams = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2))
    for parts in (1, 7, 10**6):
        lists = lm_score._lists(0, 2, grams, np.ones(40, np.int64), parts)
        assert len(lists) <= min(parts, 40) and sum(len(lm_score.unpack_hashes(r["hashes"])) for r in lists) == 40


def test_backoff_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 200)
    monkeypatch.setattr(lm_score, "PART_BYTES", 300)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 25))) for _ in range(30)] + [None, "Q unseen words", ""]
    words = [(t or "").lower().split() for t in texts]
    grams = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in (1, 2, 3)] for w in words]
    want = []
    for w, own in zip(words, grams, strict=True):
        rest = [sum((g[n] for g in grams), Counter()) for n in range(3)]
        for n in range(3):
            rest[n].subtract(own[n])
        total, score = max(sum(rest[0].values()), 1), 0.0
        for i in range(len(w)):
            scale, x = 1.0, None
            for n in range(min(i, 2), 0, -1):
                if rest[n][tuple(w[i - n : i + 1])] > 0:
                    x = rest[n][tuple(w[i - n : i + 1])] / rest[n - 1][tuple(w[i - n : i])]
                    break
                scale *= 0.4
            score += math.log(scale * (x if x is not None else max(rest[0][(w[i],)], 0.4) / total))
        want.append(score)
    got = {r["doc_id"]: r for r in lm_score.stupid_backoff(docs(spark, texts)).collect()}
    for i, x in enumerate(want):
        assert got[i]["log_score"] == pytest.approx(x, abs=1e-9) and got[i]["n_words"] == len(words[i])
    assert lm_score.op7_lm_score(docs(spark, [])).count() == 0


def test_backoff_of_odd_rows(spark, monkeypatch):
    """Repeated rows, null and repeated ids, a long text, and columns with the names used inside."""
    long = "a b c d " * 20_000
    rows = [(1, "a b c", 7, 8), (1, "a b c", 7, 8), (None, "x y", 7, 8), (2, None, 7, 8), (3, long, 7, 8), (4, "a b c d", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, gram int")
    for size in (lm_score.CHUNK_BYTES, 10):
        monkeypatch.setattr(lm_score, "CHUNK_BYTES", size)
        got = sorted((r["doc_id"] or 0, r["n_words"], round(r["log_score"], 6)) for r in lm_score.stupid_backoff(df).collect())
        n = 3 + 3 + 2 + 80_000 + 4
        twice = math.log(20_002 / (n - 3)) + 2 * math.log(20_002 / 20_002)
        assert got[1] == (1, 3, round(twice, 6)) == got[2] and got[3] == (2, 0, 0.0) and got[0][:2] == (0, 2) and got[4][:2] == (3, 80_000)
        assert got[0][2] == round(math.log(0.4 / (n - 2)) + math.log(0.4 * 0.4 / (n - 2)), 6)


def test_word_hashes_equal_words(monkeypatch):
    texts = ["", None, "a", " a b  a\tB\n", "x" * 300 + " y", "é É a", "A B C"] * 3
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(tokens, "SLICE", size)
        hashes, bounds = tokens.word_hashes(*tokens.buffers(pa.array(texts)))
        names = {}
        for i, t in enumerate(texts):
            words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            own = hashes[bounds[i] : bounds[i + 1]].tolist()
            assert len(own) == len(words) and all(names.setdefault(w, h) == h for w, h in zip(words, own, strict=True))
        assert len(set(names.values())) == len(names)


# html


def test_article_text():
    page = '<html><head><title>T</title></head><body><header>H</header><div class="cookie-notice">C</div><main><h1>T &amp; x</h1><p>a<b>b</b> c<br>d<aside>S</aside><p>e &lt;tag&gt; 1 < 2<ul><li>l1<li>l2</ul><form><p>f</form><section id="comments"><p>c1</section><table><tr><td>1<td>2</table><script>var a="</p>";</script>tail</main><footer>F</footer>'
    text = lambda source: html_text.Page(source).text(html_text.Template())
    assert text(page) == "T & x\n\nab c d\n\ne <tag> 1 < 2\n\nl1\n\nl2\n\n1 2\n\ntail"
    assert text("<article><p>cut &am") == "cut &am"
    assert text("<article><p>cut <a hre") == "cut"
    assert text("<article><p title='a>b' x=\"<p>\">q<!-- <p>c</p> --></article>after") == "q"
    assert text("") == text("<p") == ""


def test_attributes_by_name_and_value():
    """Names and values inside other attributes rule nothing out, nor do single words of longer names."""
    kept = ['<p title="a hidden gem">', '<p data-id="ad">', '<div class="notice-board">', '<div id="social-history">', '<p data-a="display: none">', '<section id="ad-hoc-networks">', '<section id="related-work">', "<math>"]
    gone = ['<div class="ad-box wide">', '<div class="share">', "<p hidden>", '<p aria-hidden="true">', '<p style="color: red; display : none">', '<div role=navigation>', '<div id="ad_300x250">', '<div class="site-footer">']
    for wrap in ("<article>{}</article>", "<body>{}</body>"):
        for i, tag in enumerate(kept + gone):
            got = html_text.Page(wrap.format(f"<p>a</p>{tag}b")).text(html_text.Template())
            assert got.split() == (["a", "b"] if i < len(kept) else ["a"]), tag


@pytest.mark.parametrize("limit", [500_000, -1])
def test_template_words_go_where_no_article_is(spark, monkeypatch, limit):
    monkeypatch.setattr(html_text, "BROADCAST_TOKENS", limit)
    monkeypatch.setattr(html_text, "SITE_PAGES", 4)
    rows = [(i, f"https://H.example/{i}", f"<body><div>Site name and slogan</div><div><p>Text number {i} is unlike word{i}.</div>Same foot line {i}</body>") for i in range(6)]
    rows += [(9, "https://other.example/", "<body><p>Alone here</body>"), (10, None, None), (11, "https://h.example/11", "")]
    rows += [(20 + i, f"https://h.example/shop/{i}", f"<body><section class='shop'>Shop menu words</section><section>Ware {i} costs {i}{i} and comes in blue{i}.</section></body>") for i in range(3)]
    rows += [(30 + i, "https://copies.example/", "<body><p>All of this page stands on others</body>") for i in range(3)]
    df = spark.createDataFrame([(*r, "x", "mine", 1) for r in rows], "page_id long, url string, html string, text string, host string, site int")
    found = html_text.extract_text(df, ["page_id", "host", "site"]).collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert {(r["host"], r["site"]) for r in found} == {("mine", 1)}
    want = {i: f"Text number {i} is unlike word{i}." for i in range(6)} | {9: "Alone here", 10: "", 11: ""} | {20 + i: f"Ware {i} costs {i}{i} and comes in blue{i}." for i in range(3)}
    assert got == want | {30 + i: "All of this page stands on others" for i in range(3)}
    assert {r["page_id"]: r["text"] for r in html_text.op8_html_text(df).collect()} == got
    assert html_text.op8_html_text(df.limit(0)).count() == 0
    # without its template each of these pages has another text
    assert all(html_text.Page(h).text(html_text.Template()) != got[i] for i, _, h in rows if i < 6 or 20 <= i < 30)


@pytest.mark.parametrize("limit", [500_000, -1])
def test_template_blocks_inside_the_article(spark, monkeypatch, limit):
    monkeypatch.setattr(html_text, "BROADCAST_TOKENS", limit)
    notice = '<div class="x1">Sign up for our weekly letter</div>'
    page = lambda i: f"<body><article><p>Text number {i} is unlike word{i} and goes on for a while.{notice}<p>Its end is end{i}.</article></body>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(6)] + [(6 + i, f"https://copies.example/{i}", page(0)) for i in range(4)] + [(10, "https://alone.example/", page(10))]
    got = {r["page_id"]: r["text"] for r in html_text.op8_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i, middle: f"Text number {i} is unlike word{i} and goes on for a while.\n\n{middle}Its end is end{i}."
    whole = "Sign up for our weekly letter\n\n"
    assert got == {i: text(i, "") for i in range(6)} | {6 + i: text(0, whole) for i in range(4)} | {10: text(10, whole)}


def brute_templates(pages):
    """Classes of equal occurrence vectors, kept whole, in one order on all pages and uncrossed, straight from the definition."""
    sites = {}
    for url, source in pages:
        page = html_text.Page(source)
        sites.setdefault((html_text.host_of(url), page.layout()), []).append(page.tokens())
    out = set()
    for own in sites.values():
        vectors = {}
        for t in {t for tokens_ in own for t in tokens_}:
            vectors.setdefault(tuple(tokens_.count(t) for tokens_ in own), set()).add(t)
        classes = [c for v, c in vectors.items() if len(c) >= 3 and sum(n > 0 for n in v) >= max(3, len(own) / 2)]

        def rounds(c, tokens_):
            """Places of the class's tokens, a list for each repetition."""
            at = [i for i, t in enumerate(tokens_) if t in c]
            return [at[i : i + len(c)] for i in range(0, len(at), len(c))]

        def one_order(c):
            return len({tuple(tokens_[i] for i in r) for tokens_ in own for r in rounds(c, tokens_)}) == 1

        classes = [c for c in classes if one_order(c)]

        def cross(c, d):
            return any(a[0] < b[0] < a[-1] < b[-1] or b[0] < a[0] < b[-1] < a[-1] for tokens_ in own for a in rounds(c, tokens_) for b in rounds(d, tokens_))

        out |= {frozenset(c) for c in classes if not any(cross(c, d) and len(d) > len(c) for d in classes)}
    return out


def test_templates_equal_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for host in range(4):
        menu = [f"m{rng.randrange(30)}{i}" for i in range(5)]
        for i in range(rng.randrange(8, 16)):
            listed = "".join(f"<li><i>by</i> <b>item</b> <em>x{rng.randrange(99)}</em>" for _ in range(rng.randrange(1, 4)))
            swap = "<p>left one two</p><h2>right three four</h2>" if host == 1 and i % 2 else "<h2>right three four</h2><p>left one two</p>"
            side = "<section class='side'>extra box of words</section>" if rng.random() < 0.5 else ""
            pages.append((f"https://h{host}.example/{i}", f"<body><div>{' '.join(menu)} {i}</div>{swap}{side}<ul>{listed}</ul><article><p>own text {rng.random()}<p>same line</article><div>foot of site {host}</div></body>"))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {}
    for r in html_text.deduce_templates(df).collect():
        got.setdefault((r["site"], r["class"]), set()).add(r["token"])
    assert {frozenset(c) for c in got.values()} == brute_templates(pages) and len(got) > 4


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_repeated_blocks_of_an_article_are_its_own(spark, n):
    """Headings that all pages of a host repeat stay, whatever their number; what repeats before and behind goes where enough pages show it."""
    body = "".join(f"<h2>{h}</h2><p>Own words {{0}} of {h} and more.</p><p>As always here.</p>" for h in ("Introduction", "Method", "Conclusion"))
    page = "<body><article><p>Share now with all your friends</p><p>Second line on top</p>" + body + "<p>Thanks for your time here</p><p>See you again soon then</p></article></body>"
    rows = [(i, f"https://h.example/{i}", page.format(f"n{i}")) for i in range(n)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_text.op8_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(n):
        own = [x for h in ("Introduction", "Method", "Conclusion") for x in (h, f"Own words n{i} of {h} and more.", "As always here.")]
        around = [] if n >= html_text.MIN_PAGES else ["Share now with all your friends", "Second line on top"], [] if n >= html_text.MIN_PAGES else ["Thanks for your time here", "See you again soon then"]
        assert got[i] == [*around[0], *own, *around[1]]


def test_threads_of_readers_go_and_sections_of_that_name_stay():
    text = lambda source: html_text.Page(source).text(html_text.Template())
    thread = '<div class="discussion"><div class="entry"><p>I disagree</p></div><div class="entry"><p>Me too</p></div></div>'
    assert text(f"<body><h1>T</h1><p>Own</p>{thread}<p>End</p></body>") == "T\n\nOwn\n\nEnd"
    assert text('<body><p>Own</p><section id="discussion"><h2>Discussion</h2><p>We discuss.</p></section></body>') == "Own\n\nDiscussion\n\nWe discuss."
    assert text(f'<article><p>Own</p><section id="discussion"><div><p>We discuss.</p></div></section></article>{thread}') == "Own\n\nWe discuss."


def test_nested_classes_and_slots(spark):
    page = lambda i: "<body><div>Top line here</div><ul>" + "".join(f"<li><b>Name</b> n{i}x{j} <i>Price</i> {i}{j}</li>" for j in range(1 + i % 3)) + "</ul><div>End mark there</div></body>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(6)]
    found = html_text.deduce_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    held = {r["class"]: r["holder"] for r in found}
    root = [c for c, h in held.items() if h == 0]
    assert len(held) == 2 and len(root) == 1 and set(held.values()) == {0, root[0]}
    template = html_text.Template({r["token"]: r["class"] for r in found}, held)
    slots = html_text.Page(page(2)).slots(template)
    assert {text: of_template for _, text, of_template, _ in slots} == {"Top line here": True, "End mark there": True} | {f"Name n2x{j} Price 2{j}": False for j in range(3)}
    assert {held[c] for c, text, _, _ in slots if text.startswith("Name")} <= {0, root[0]}


def test_pages_that_differ_at_their_end(spark):
    """Equal beginnings do not make two pages one: each page has its own place in the vectors."""
    long = "<p>" + "same " * 2000
    rows = [("https://h.example/", f"<body>{long}<p>{'one two three' if i % 2 else 'four five six'}") for i in range(8)]
    sums = {}
    for batch in html_text._occurrences(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["url", "html"])])):
        for r in batch.to_pylist():
            sums[r["token"]] = (r["f0"], r["f1"], r["pages"])
    path = "/body/p:"
    assert sums[html_text.digest(path + "one")] == sums[html_text.digest(path + "two")] != sums[html_text.digest(path + "four")]


# urls


def test_urls(spark):
    seen = ["https://WWW.Example.COM/en/7?q#x", "http://a.com/en/", "http://com/en/x", "http://xcom/en/", "https://b.example.net/de/8", "https://b.example.net/de/9", None, "no scheme", "https://h:80?x/y", "http://a.org/es/1"]
    got = urls.op9_url_filter(spark.createDataFrame([(i, u, "c") for i, u in enumerate(seen)], "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [r["host"] for r in got[:2]] == ["www.example.com", "a.com"] and (got[8]["host"], got[8]["path"]) == ("h:80", "")
    assert [r["rule"] for r in got] == ["example.com/en/7", "com/en/", "com/en/", None, "example.net/de/8", "net/de/", None, None, None, "org/es/"]
    assert [r["verdict"] for r in got if r["rule"]] == ["allow", "block", "block", "block", "block", "block"]
    assert got[6]["path"] == got[7]["host"] == ""


def test_weights_and_learning(spark):
    native, plain = urls.trained_weights(spark), urls.plain_weights()
    assert np.allclose(native, plain, atol=1e-9)
    assert not {h for h, _, _ in urls.HELD_OUT} & {h for h, _, _ in urls.LABELLED}
    held = spark.createDataFrame([(f"https://{h}{p}", y) for h, p, y in urls.HELD_OUT], "url string, y int")
    assert urls.filter_urls(held, native, rules=()).filter("(verdict = 'block') = (y = 1)").count() >= 18  # of 20
    twice = held.withColumn("verdict", F.lit("mine")).union(held.withColumn("verdict", F.lit("mine")))
    assert urls.filter_urls(twice, native).count() == 40 and urls.filter_urls(twice.limit(0), native).count() == 0
    long = spark.createDataFrame([("https://library.example/" + "a/" * 100_000,)], "url string")
    assert urls.filter_urls(long, native, rules=()).first()["verdict"] == "allow"
    rows = spark.createDataFrame([(f"https://{h}{p}", y) for h, p, y in urls.LABELLED], "url string, y int")
    assert urls.filter_urls(rows, native, rules=()).filter("(verdict = 'block') <> (y = 1)").count() == 0
    new = spark.createDataFrame([("https://casino-jackpot.example/win/bonus",), ("https://library.example/article/history",)], "url string")
    assert [r["verdict"] for r in urls.filter_urls(new, native, rules=()).collect()] == ["block", "allow"]


# toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = "zorgle" + rng.choice(["ba", "ki", "to", "mu", "ren", "dal"])
        texts.append(" ".join(w).capitalize() + ".")
        labels.append((i, 1, int(bad)))
    texts += [None, "", "..."]
    labels += [(0, 1, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.op10_toxicity(docs(spark, texts, extra=True), table).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held) | {i for i in range(600, 603) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(got[i]["predicted"] == labels[i][2] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and all(got[i]["predicted"] == 0 for i in (600, 601, 602))
    assert toxicity.op10_toxicity(docs(spark, texts[:5]), table.limit(0)).count() == 5
    assert toxicity.op10_toxicity(docs(spark, []), table).count() == 0


def test_kneser_ney_sums_to_one():
    """Both classes and the shared model are distributions after every context; a document's ratio is that of its likelihoods."""
    ordinary, toxic = Counter({"aab": 3, "abc": 1, "": 1}), Counter({"abd": 2, "zab": 1})
    both = toxicity.KneserNey(ordinary, toxic, order=3)
    every = [chr(i) for i in range(256)]
    for h in {s[:-1] for c in both.counts for s in c} | {"qq", "a", "^"}:
        for label in (0, 1):
            assert sum(both.probability(label, h + c) for c in every) == pytest.approx(1)
        assert sum(both.shared(h + c) for c in every) == pytest.approx(1)
    model = toxicity.kneser_ney(ordinary, toxic, order=3)

    def likelihood(label, word):
        s = f"^{word}$"
        return sum(math.log(both.probability(label, s[max(0, end - 2) : end + 1])) for end in range(1, len(s)))

    words = ["abd", "aab", "zzz", "", "abc", "zabd"]
    for w in words:
        assert model.word(w) * (len(w) + 1) == pytest.approx(likelihood(1, w) - likelihood(0, w))
    chars = sum(len(w) + 1 for w in words)
    assert model.features(words)[1] == pytest.approx(sum(likelihood(1, w) - likelihood(0, w) for w in words) / chars)
    assert model.word("abd") > 0 > model.word("aab")


def test_toxicity_of_repeated_and_long_texts(spark):
    table = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    texts = [("vile scum " if i % 2 else "fine words ") + f"w{i}" for i in range(40)] + ["fine words " * 40_000, "fine words " * 40_000 + "scum"]
    df = docs(spark, texts, extra=True)
    got = [(r["doc_id"], r["score"]) for r in toxicity.op10_toxicity(df.union(df), table).collect()]
    assert len(got) == 84 and len(set(got)) == 42
    assert dict(got)[41] > dict(got)[40]
    model = toxicity.fit_toxicity(df, table, F.lit(True), longest=5)
    assert model.gram == {} and set(model.curve[1:]) == {0.0}


# pipeline


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    passage = bench.first()["text"]
    text = " ".join(f"wort{i % 83}x{i % 7}" for i in range(120))
    more = spark.createDataFrame([(900_001, text, "en", "s", 1), (900_002, text + " ende", "en", "s", 1), (900_003, "vorn " + passage + " und hinten", "en", "s", 1), (900_004, None, "en", "s", 1), (None, "kein name", None, None, None)], DOCS)
    now = d.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    ids = [sorted(r["doc_id"] or -1 for r in now.select("doc_id").collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append(sorted(r["doc_id"] or -1 for r in now.select("doc_id").collect()))
    assert 900_001 in ids[2] and 900_002 in ids[1] and 900_002 not in ids[2]
    assert 900_003 in ids[2] and 900_003 not in ids[3] and {900_004, -1} <= set(ids[3])
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sorted(r["doc_id"] or -1 for r in out) == ids[3] and all(r["round_trip"] for r in out)
    # near copies by brute force over what the first stage kept
    kept = corpus_pipeline.drop_toxic(spark, d, SF).select("doc_id", "text").orderBy("doc_id").collect()
    label, _ = brute_components([r["text"] for r in kept], 5, 80)
    want = [r["doc_id"] for i, r in enumerate(kept) if label[i] == i]
    got = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_toxic(spark, d, SF), SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == want


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty documents, empty side tables, extra columns with names used inside, repeated rows and null ids."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = [(1, "some words of a text that stands twice here", "en", "s", 1, 5, "x"), (1, "some words of a text that stands twice here", "en", "s", 1, 5, "x"), (None, "no id", None, None, None, 5, "x"), (2, None, "en", "s", 0, 5, "x"), (3, "", "en", "s", 0, 5, "x")]
    df = spark.createDataFrame(rows, DOCS + ", score int, __key string")
    for d in (SF, str(tmp_path)):
        for some in (df, df.limit(0)):
            now = some
            for _, stage in corpus_pipeline.STAGES[:-1]:
                now = stage(spark, now, d)
                assert now.columns == df.columns
            assert sorted((r["doc_id"] or 0) for r in now.collect()) == ([0, 1, 2, 3] if some is df else [])
            out = corpus_pipeline.STAGES[-1][1](spark, now, d).collect()
            assert len(out) == (4 if some is df else 0) and all(r["round_trip"] for r in out)


def test_long_and_repeated_rows(spark):
    """Operators that judge rows one by one, or whole texts, on texts of a megabyte and on rows that stand twice."""
    long = "word and more words. " * 50_000
    df = docs(spark, [long, "short text", "short text", None], extra=True)
    df = df.union(df)
    one = {r["doc_id"]: r for r in bpe.op2_bpe(df, VOCAB).collect()}
    assert one[0]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest() and one[1]["ids_sha256"] == one[2]["ids_sha256"]
    assert bpe.op2_bpe(df, VOCAB).count() == 8
    sizes = {r["doc_id"]: r["size"] for r in sharding.op1_hilbert_sharding(df).collect()}
    assert sizes == {0: len(long) + 1, 1: 11, 2: 11, 3: 1}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op6_jaccard(df).collect()}
    assert got == {0: (4, 0), 1: (1, 1), 2: (1, 1), 3: (0, 3)}
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", long if i == 0 else "<|end|>", 0) for i in range(3)] * 2, "conv_id long, turn long, role string, text string, formatted int")
    (chat_row,) = chat.op4_chat_formatting(turns).filter("conv_id = 1").collect()
    assert chat_row["n_turns"] == 6 and chat_row["loss_chars"] == 2 * (len(long) + len("<|end|>"))
    page = f"<article><p>{long}</article>"
    pages = spark.createDataFrame([(1, "https://h.example/", page), (1, "https://h.example/", page), (2, None, page)], "page_id long, url string, html string")
    assert [r["n_chars"] for r in html_text.op8_html_text(pages).collect()] == [len(long) - 1] * 3
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    bench = spark.createDataFrame([(7, passage), (7, passage)], "item_id long, text string")
    found = decontaminate.op3_decontamination(docs(spark, [long + passage, passage, "x"]).unionByName(docs(spark, [passage])), bench).collect()
    assert Counter(r["doc_id"] for r in found) == {0: 4, 1: 2}
